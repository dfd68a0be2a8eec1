"""The memory store's tables: schemas, validation, the latest-state fold, and the store mapped onto the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import scoring

TYPES = ["decision", "discovery", "pattern", "entity", "preference", "session", "tool"]
RELATIONS = ["supersedes", "contradicts", "relates_to", "part_of", "depends_on", "caused_by", "used_by"]
AS_OF = "2024-01-31 00:00:00"

MEMORY = "id string not null, content string not null, type string not null, tags array<string>, project string, metadata string, created_at timestamp, updated_at timestamp, access_count bigint, last_accessed timestamp, importance double"
RELATION = "source_id string not null, target_id string not null, relation_type string not null, weight double, created_at timestamp"
SESSION = "id string not null, project string, started_at timestamp, ended_at timestamp, summary string, memory_ids array<string>"
META = "key string not null, value string not null"
VECTOR = "memory_id string not null, embedding array<double>"


def validated(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the constraints (id, content, known type), and the quarantined rest."""
    good = F.col("id").isNotNull() & F.col("content").isNotNull() & F.coalesce(F.col("type").isin(TYPES), F.lit(False))
    return memories.filter(good), memories.filter(~good)


def latest(events: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The latest state of each key in an event log with an ``op`` column; deleted keys are gone."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 and op <> 'delete'").drop("_rn")


def content_id(content: Column, kind: Column, project: Column) -> Column:
    """A reproducible id: 12 hex digits of a hash of content, type and project."""
    return F.substring(F.md5(F.concat_ws("\x1f", content, kind, F.coalesce(project, F.lit("")))), 1, 12)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memories; every derived column is a function of doc_id and the row."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    sources = ["reflect", "manual", "mentor", "research", "wrap", "hook", "consolidation"]
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (i % 7).cast("int"))
    source = F.get(F.array(*[F.lit(s) for s in sources]), (i % 8).cast("int"))
    d = d.select(i.alias("id"), F.col("text").alias("content"), kind.alias("type"), F.when(i % 4 != 0, F.col("source")).alias("project"), F.array("lang", "source").alias("tags"), source.alias("meta_source"))
    back = lambda n: F.make_dt_interval(F.pmod(F.col("id"), F.lit(n)).cast("int"))
    return d.withColumns({"created_at": as_of() - back(120), "access_count": F.col("id") % 11, "last_accessed": F.when(F.col("id") % 5 != 0, as_of() - back(30)), "importance": F.when(F.col("id") % 13 != 0, scoring.initial_importance(F.col("type"), F.col("meta_source")))})


def memory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic edges: each document to half its id, and to one further on."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = F.lit(d.count())
    kind = F.get(F.array(*[F.lit(t) for t in RELATIONS]), (F.col("doc_id") % 7).cast("int"))
    tree = d.filter("doc_id > 0").select(F.col("doc_id").alias("source_id"), F.floor(F.col("doc_id") / 2).alias("target_id"), kind.alias("relation_type"))
    skip = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("source_id"), ((7 * F.col("doc_id") + 3) % n).alias("target_id"), kind.alias("relation_type"))
    return tree.unionByName(skip).filter("source_id != target_id").distinct().withColumn("weight", F.lit(1.0))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as sessions: the summary is the first user turn."""
    c = read(spark, sf_dir, "conversations")
    first = F.min_by("text", "turn")
    s = c.filter("role = 'user'").groupBy("conv_id").agg(first.alias("summary"), F.count("*").alias("turns"))
    i = F.col("conv_id")
    return s.select(i.alias("id"), F.when(i % 3 != 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("project"), (as_of() - F.make_dt_interval(F.pmod(i, F.lit(100)).cast("int"))).alias("started_at"), "summary", "turns")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as a judge's scores of 0 to 10; unlabelled memories have none."""
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return l.select(F.col("doc_id").alias("memory_id"), (7 * F.col("quality") + 3 * (1 - F.col("toxic"))).alias("score"))
