"""A bounded cache in front of a scorer: known keys are joined, others are scored once, and the least recently used go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.sources.commits import CommitLog, latest_by

#: Scores rows of distinct keys: a frame with ``key`` and what the score needs, to (key, value).
Scorer = Callable[[DataFrame], DataFrame]


class ScorerCache:
    """Scores by key in a table of a commit log, at most ``most`` after each call.

    A call commits new scores with the times at which known keys were used,
    and then, if there are too many, what the bound evicts: the keys of the
    oldest time, equal times by key from the end.
    """

    def __init__(self, log: CommitLog, value: str, most: int = 128, table: str = "cache"):
        self.log, self.most, self.table = log, most, table
        self.schema = f"key string, value {value}, used timestamp, gone boolean, seq long"

    def state(self) -> DataFrame:
        rows = self.log.read(self.table, self.schema).drop("commit")
        return latest_by(rows, ["key"]).filter("not gone").select("key", "value", "used")

    def call(self, requests: DataFrame, score: Scorer, now: Column) -> DataFrame:
        """Values of requests (key, ...): all their columns, ``value`` and ``hit``, whether it was known before.

        Each missing key is scored once, whatever the number of its requests.
        Null keys are neither scored nor kept: their value is null.
        """
        known = self.state()
        asked = requests.filter("key is not null").dropDuplicates(["key"])
        missing = asked.join(known.select("key"), "key", "left_anti")
        with self.log.commit() as c:
            row = lambda df, gone: df.select("key", "value", "used", F.lit(gone).alias("gone"), F.lit(c.number).cast("long").alias("seq"))
            scored = row(score(missing).select("key", "value").withColumn("used", now), False)
            touched = row(known.join(asked.select("key"), "key", "left_semi").withColumn("used", now), False)
            fresh = c.add(self.table, scored.withColumn("hit", F.lit(False)).unionByName(touched.withColumn("hit", F.lit(True))))
        held = self.state()
        over = held.join(held.orderBy(F.desc("used"), "key").limit(self.most).select("key"), "key", "left_anti")
        if not over.isEmpty():
            with self.log.commit() as c:
                c.add(self.table, over.select("key", "value", "used", F.lit(True).alias("gone"), F.lit(c.number).cast("long").alias("seq")))
        return requests.join(fresh.select("key", "value", "hit"), "key", "left")


def embedded(cache: ScorerCache, rows: DataFrame, text: str, embed: Callable[[DataFrame, str], DataFrame], now: Column) -> DataFrame:
    """``rows`` with ``embedding`` of a text column, equal texts embedded once and known ones not at all; ``hit`` tells which."""
    key = F.when(F.col(text).isNotNull(), F.sha2(F.col(text), 256))
    score = lambda df: embed(df.select(F.col("key").alias("id"), text), text).select(F.col("id").alias("key"), F.col("embedding").alias("value"))
    return cache.call(rows.withColumn("key", key), score, now).drop("key").withColumnRenamed("value", "embedding")


def judged_sets(cache: ScorerCache, pool: DataFrame, judge: Scorer, now: Column) -> DataFrame:
    """Scores of pools (query_id, query, id) by a judge of whole sets: (query_id, scores, status).

    The key is the query with its set of ids in any order; ``judge`` gets
    (key, query, ids) and returns a map of id to score.  The status is
    ``cache`` where the set was judged before, else ``ok``.
    """
    sets = pool.groupBy("query_id", "query").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    sets = sets.withColumn("key", T.set_hash(F.col("query"), F.transform("ids", lambda i: i.cast("string"))))
    out = cache.call(sets, judge, now)
    return out.select("query_id", F.col("value").alias("scores"), F.when(F.col("hit"), "cache").otherwise("ok").alias("status"))
