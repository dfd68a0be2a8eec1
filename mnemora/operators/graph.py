"""Graph operators over edge DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Connected components of edges (a, b): (node, component), the component being its least node.

    Alternates large-star and small-star steps until every node points at a
    root, which takes a number of rounds logarithmic in the longest chain.
    Each round is written to ``folder``, a directory that all executors share,
    so lineage stays short.  Self-loops and repeated edges do no harm; nulls
    are dropped.  Nodes without an edge are not in the result.
    """
    pair = F.struct(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).alias("e")
    e = _written(edges.dropna(subset=["a", "b"]).filter("a != b").select(pair).select("e.u", "e.v").distinct(), folder)
    # stars: each node has one root, which is no other's node
    while not e.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").isEmpty() or not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
        # large star: every greater neighbour of a node is linked to the least of the node's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: every lesser neighbour and the node itself are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = _written(small.distinct(), folder)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def first_independent(edges: DataFrame, folder: str) -> DataFrame:
    """The lexicographically first independent set of edges (a, b), a < b: (node, kept) of every node with an edge.

    It is what a loop over the nodes in order keeps, a node being left out if
    an earlier neighbour was kept.  All nodes whose earlier neighbours are
    decided are decided at once: a node without any that could still be kept
    is kept, and its later neighbours are out.  There are as many rounds as
    the longest chain of such decisions; each is written to ``folder``.
    """
    e = _written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), folder)
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    out = e.select(F.col("b").alias("node")).limit(0)
    while not e.isEmpty():
        free = e.select("a").distinct().join(e.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = _written(e.join(free, "a", "left_semi").select(F.col("b").alias("node")).distinct(), folder)
        out = out.unionByName(gone)
        # edges of nodes that are out say nothing; those of a kept node all lead to such nodes
        e = _written(e.join(gone.select(F.col("node").alias("b")), "b", "left_anti").join(gone.select(F.col("node").alias("a")), "a", "left_anti"), folder)
    return nodes.join(out.withColumn("out", F.lit(True)), "node", "left").select("node", F.col("out").isNull().alias("kept"))


def greedy_stars(stars: DataFrame, least: int, folder: str) -> DataFrame:
    """Disjoint stars as a loop would choose them: (seed, member), each seed being a member of its own.

    ``stars`` are (seed, member) without the seeds' own rows, a seed being a
    struct (at, id) in whose order the loop goes.  The loop takes a seed that
    no star before it used, with those of its members that none used, if they
    are ``least`` or more with itself.

    In each round all seeds are decided whose nodes no earlier open seed has:
    they share no node, so their order does not matter.  Open seeds that are
    used, or have too few members left, can never be taken and go at once.
    Each round is written to ``folder``; a node's seeds are told apart by
    their least, so no seed, node or group is gathered in a task.
    """
    own = stars.select("seed", F.col("seed.id").alias("member")).distinct()
    t = stars.filter("member != seed.id").unionByName(own).distinct()
    big = t.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("seed")
    t = _written(t.join(big, "seed", "left_semi"), folder)
    out = t.limit(0)
    while not t.isEmpty():
        first = t.groupBy("member").agg(F.min("seed").alias("first"))
        ready = t.join(first, "member").groupBy("seed").agg(F.bool_and(F.col("first") == F.col("seed")).alias("ready")).filter("ready").select("seed")
        taken = _written(t.join(ready, "seed", "left_semi"), folder)
        out = out.unionByName(taken)
        rest = t.join(taken.select("member").distinct(), "member", "left_anti")
        open_ = rest.groupBy("seed").agg(F.count("*").alias("n"), F.bool_or(F.col("member") == F.col("seed.id")).alias("free")).filter((F.col("n") >= least) & F.col("free"))
        t = _written(rest.join(open_.select("seed"), "seed", "left_semi"), folder)
    return out.select("seed", "member")


def degree(relations: DataFrame) -> DataFrame:
    """(id, degree): edges touching a node, a self-loop once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def traverse(relations: DataFrame, root, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` undirected steps of a root: (id, depth).  Nodes at the last depth are not expanded."""
    spark = relations.sparkSession
    both = relations.select(F.col("source_id").alias("x"), F.col("target_id").alias("y")).unionByName(relations.select(F.col("target_id").alias("x"), F.col("source_id").alias("y"))).distinct()
    seen = spark.range(1).select(F.lit(root).cast(relations.schema["source_id"].dataType).alias("id"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = both.join(frontier.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def edges_within(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return relations.join(ids, relations["source_id"] == ids["id"], "left_semi").join(ids, relations["target_id"] == ids["id"], "left_semi")


def add_edges(relations: DataFrame, new: DataFrame, memories: DataFrame) -> DataFrame:
    """The edges to append: unknown by (source, target, type), with both ends in the store, each once."""
    key = ["source_id", "target_id", "relation_type"]
    return edges_within(new.dropDuplicates(key), memories).join(relations.select(*key), key, "left_anti")


def without_nodes(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left after nodes (id) are deleted."""
    ids = gone.select("id").distinct()
    return relations.join(ids, relations["source_id"] == ids["id"], "left_anti").join(ids, relations["target_id"] == ids["id"], "left_anti")


def repointed(relations: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with duplicates' ends (canonical, duplicate) moved to the canonical: no self-loops, each once, weight 1."""
    s = moved.select(F.col("duplicate").alias("source_id"), F.col("canonical").alias("s"))
    t = moved.select(F.col("duplicate").alias("target_id"), F.col("canonical").alias("t"))
    out = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    out = out.select(F.coalesce("s", "source_id").alias("source_id"), F.coalesce("t", "target_id").alias("target_id"), "relation_type")
    return out.filter("source_id <> target_id").distinct().withColumn("weight", F.lit(1.0))
