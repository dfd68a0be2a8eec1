"""Sinks: the derived tables of new memories, run logs, decision logs and rendered context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators import fts


def save_tables(rows: DataFrame, folder: str, vectors: DataFrame | None = None) -> None:
    """Append one batch of memories and the tables derived from it.

    Vectors are optional: rows without one are found by text alone.  Each
    table is appended whole or not at all; readers fold by id, so a batch
    that is written again after a failure does no harm.
    """
    rows.write.mode("append").parquet(f"{folder}/memories")
    fts.postings(rows).write.mode("append").parquet(f"{folder}/postings")
    if vectors is not None:
        vectors.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").write.mode("append").parquet(f"{folder}/vectors")


def run_log(df: DataFrame, path: str) -> None:
    """Append JSON lines."""
    df.write.mode("append").json(path)


def decision_log(df: DataFrame, path: str) -> None:
    """Append tab-separated lines."""
    df.write.mode("append").option("sep", "\t").csv(path)


def rendered(ranked: DataFrame, budget: int = 3000, group: str = "query_id", order: str = "pos") -> DataFrame:
    """One text a group of its lines (line), in order, while they fit the budget."""
    from mnemora.operators.recall import within_budget

    kept = within_budget(ranked, budget, F.length("line"), group, order)
    return kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda r: r["line"]), "\n").alias("context"))


def publish(df: DataFrame, folder: str, version: str) -> str:
    """Write a rebuilt table beside the old one and return its path; the old one is dropped only after readers moved."""
    path = f"{folder}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
