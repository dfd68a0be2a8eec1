"""Pluggable models behind one interface, with offline deterministic defaults.

A scorer adds a column to a DataFrame; engines take any callable of the same
shape, so a remote model can be put in without a change elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as T

#: Adds ``embedding array<double>`` of a text column.
Embedder = Callable[[DataFrame, str], DataFrame]
#: A pair's verdict and confidence from two contents, the newer first: a struct (verdict, confidence).
PairClassifier = Callable[[Column, Column], Column]

DIMENSIONS = 1024


def hashed_embedding(df: DataFrame, text: str, dimensions: int = DIMENSIONS, into: str = "embedding", key: str = "id") -> DataFrame:
    """Hashed bag of words, counted by bucket: the offline embedder.

    ``df`` needs a unique ``key``.  A word's bucket is a hash of the word, so
    equal words meet in any process.  Texts without words get zeros.
    """
    word = F.explode(T.tokens(F.col(text)))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("int"), F.lit(dimensions))
    counts = df.select(key, word.alias("w")).groupBy(key, bucket.alias("bucket")).count()
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("count").cast("double")))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return df.join(maps.select(key, "m"), key, "left").withColumn(into, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dimensions)).otherwise(slots)).drop("m")


def cautious(verdict: Column, confidence: Column, newer: Column, older: Column) -> Column:
    """A model's verdict after the guards: series entries are unrelated, confidence is within 0..1, and replacing needs words of reversal."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    kept = F.when((verdict == "supersedes") & ~T.reversal(newer), "contradicts").otherwise(F.coalesce(verdict, F.lit("unrelated")))
    series = F.coalesce(T.series_pair(newer, older), F.lit(False))
    return F.when(series, F.struct(F.lit("unrelated").alias("verdict"), F.lit(1.0).alias("confidence"))).otherwise(F.struct(kept.alias("verdict"), conf.alias("confidence")))


def reversal_classifier(newer: Column, older: Column) -> Column:
    """The offline pair classifier: words of reversal make the newer content supersede, else the two are unrelated."""
    found = T.reversal(newer)
    return cautious(F.when(found, "supersedes").otherwise("unrelated"), F.when(found, 0.9).otherwise(0.5), newer, older)
