"""Full text: postings, all-of phrase match, any-of match and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as T

K1, B = 1.2, 0.75


def indexed_text():
    """What is indexed of a memory: content, tags and project."""
    return F.concat_ws(" ", "content", F.array_join("tags", " "), "project")


def postings(docs: DataFrame, key: str = "id", text=None) -> DataFrame:
    """(key, term, tf, positions): one row a term of a document."""
    rows = docs.select(key, F.posexplode(T.tokens(indexed_text() if text is None else text)).alias("pos", "term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "id", text=None, k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
    """Scores of (query_id, terms array) against documents: (query_id, key, score, hits).

    A document scores the sum over the query's distinct terms.  Documents
    without a term have no row.  Terms are joined by hash, queries broadcast
    only where Spark finds them small.  With ``only``, pairs (query_id, key),
    no others are scored; frequencies are always those of all documents.
    """
    p = docs.select(key, T.tokens(indexed_text() if text is None else text).alias("toks"))
    totals = p.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("mean_len"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    tf = p.select(key, F.size("toks").alias("len"), F.explode("toks").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    if only is not None:
        found = only.select("query_id", key).distinct().join(wanted, "query_id").join(tf, [key, "term"])
        scored = found.join(df, "term").crossJoin(F.broadcast(totals)).select("query_id", key, part.alias("part"))  # one row of totals
    else:
        scored = tf.join(df, "term").crossJoin(F.broadcast(totals)).select(key, "term", part.alias("part")).join(wanted, "term")
    return scored.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("hits"))


def match_all(docs: DataFrame, queries: DataFrame, key: str = "id", text=None) -> DataFrame:
    """(query_id, key) where every phrase of the query's tokens occurs; a token of several terms is a phrase.

    The documents of a query's rarest term are looked through for all its
    phrases, so frequent terms make no rows.
    """
    q = queries.select("query_id", F.filter(F.transform(T.query_phrases(F.col("query")), T.tokens), lambda p: F.size(p) > 0).alias("phrases")).filter("size(phrases) > 0")
    wanted = q.select("query_id", F.explode(F.array_distinct(F.flatten("phrases"))).alias("term"))
    toks = docs.select(key, T.tokens(indexed_text() if text is None else text).alias("toks"))
    has = toks.select(key, F.explode(F.array_distinct("toks")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = has.groupBy("term").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    rarest = rarest.filter("r.df > 0").select("query_id", "r.term").join(q, "query_id")
    maybe = has.join(rarest, "term").select("query_id", key, F.transform("phrases", lambda p: F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" "))).alias("phrases"))
    line = toks.select(key, F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" ")).alias("line"))
    return maybe.join(line, key).filter(F.forall("phrases", lambda p: F.col("line").contains(p))).select("query_id", key)
