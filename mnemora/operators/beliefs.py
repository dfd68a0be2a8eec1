"""Pairs of memories: near duplicates, conflicts, merging, clustering, superseding and audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions import scoring as S
from mnemora.functions import text as T
from mnemora.operators import graph
from mnemora.operators.graph import components
from mnemora.operators.recall import compatible
from mnemora.operators.vectors import linking_pairs, similar_pairs, top_neighbours
from mnemora.scorers import reversal_classifier


@dataclass(frozen=True)
class Thresholds:
    """Cosine bands of the pairwise operators."""

    near_duplicate: float = 0.92
    merge: float = 0.95
    cleanup: float = 0.93
    capture: float = 0.75
    cluster: float = 0.65
    conflict: tuple[float, float] = (0.80, 0.985)
    supersede: tuple[float, float] = (0.80, 0.97)
    confidence: float = 0.85


def marked(memories: DataFrame) -> DataFrame:
    """(id, type, project, series): memories with their content's series marks in its place.

    They are dealt out by id first, so that a content is looked at once and
    not for each of its pairs, and both sides of a pair read the same rows.
    """
    return memories.select("id", "type", "project", T.series_marks(F.col("content")).alias("series")).repartition("id")


def sided(pairs: DataFrame, memories: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b, sim) with columns of both memories, suffixed _a and _b."""
    out = pairs
    for side in "ab":
        out = out.join(memories.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return out


def near_duplicates(pairs: DataFrame, memories: DataFrame, threshold: float, k: int = 6) -> DataFrame:
    """Write-time guard: each memory's best older neighbour of its type and a compatible project, among its k nearest."""
    near = sided(top_neighbours(pairs, k), memories, "type", "project")
    ok = (F.col("b") < F.col("a")) & (F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")) & (F.col("sim") >= threshold)
    best = F.max(F.struct("sim", (-F.col("b")).alias("o"))).alias("x")
    return near.filter(ok).groupBy(F.col("a").alias("id")).agg(best).select("id", (-F.col("x.o")).alias("matched"), F.round("x.sim", 3).alias("sim"))


def conflict_pairs(pairs: DataFrame, memories: DataFrame, relations: DataFrame, low: float, high: float) -> DataFrame:
    """Divergent pairs of one subject (a, b, via): by similarity in the band, not of a series, or by an explicit edge."""
    p = sided(pairs.filter(F.col("sim").between(low, high)), marked(memories), "type", "project", "series")
    p = p.filter((F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")) & ~T.series_marked(F.col("series_a"), F.col("series_b")))
    edges = relations.filter(F.col("relation_type").isin("contradicts", "supersedes")).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lit("edge").alias("via"))
    known = memories.select("id")
    edges = edges.join(known, F.col("a") == F.col("id"), "left_semi").join(known, F.col("b") == F.col("id"), "left_semi")
    return p.select("a", "b", F.lit("similarity").alias("via")).unionByName(edges).groupBy("a", "b").agg(F.max("via").alias("via"))


def conflict_flags(pairs: DataFrame, memories: DataFrame, folder: str) -> DataFrame:
    """Currency of each member of a conflict component: the newest is current, others are candidates (id, role, vs, age)."""
    groups = components(pairs, folder).withColumnRenamed("node", "id").join(memories.select("id", "created_at"), "id")
    newest = groups.groupBy("component").agg(F.max(F.struct("created_at", (-F.col("id")).alias("n"))).alias("x")).select("component", (-F.col("x.n")).alias("newest"), F.col("x.created_at").alias("newest_at"))
    g = groups.join(newest, "component")
    mine = F.col("id") == F.col("newest")
    return g.select("id", F.when(mine, "current").otherwise("superseded_candidate").alias("role"), F.when(~mine, F.col("newest")).alias("vs"), F.when(~mine, S.age_label(F.col("newest_at"), F.col("created_at"))).alias("age"))


def merged(pairs: DataFrame, memories: DataFrame, threshold: float, folder: str) -> DataFrame:
    """Merging near-identical memories of one type: (winner, loser, tags).

    A component's winner has most accesses, then is the newest, then has the
    least id; it gets all tags of the component.
    """
    p = sided(pairs.filter(F.col("sim") >= threshold), memories.filter("type <> 'tool'"), "type").filter("type_a = type_b")
    return _winners(p.select("a", "b"), memories, folder)


def merged_vectors(vectors: DataFrame, memories: DataFrame, threshold: float, folder: str) -> DataFrame:
    """``merged`` of all pairs of vectors (memory_id, embedding), which are never listed."""
    kinds = memories.filter("type <> 'tool'").select(F.col("id").alias("memory_id"), "type")
    return _winners(linking_pairs(vectors, threshold, facts=kinds, same=["type"]), memories, folder)


def _winners(links: DataFrame, memories: DataFrame, folder: str) -> DataFrame:
    g = components(links, folder).withColumnRenamed("node", "id").join(memories.select("id", "tags", "access_count", "created_at"), "id")
    best = F.max(F.struct("access_count", "created_at", (-F.col("id")).alias("n"))).alias("x")
    won = g.groupBy("component").agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")).select("component", (-F.col("x.n")).alias("winner"), "tags")
    return g.select("component", "id").join(won, "component").filter("id <> winner").select("winner", F.col("id").alias("loser"), "tags")


def supersede_candidates(pairs: DataFrame, memories: DataFrame, relations: DataFrame, low: float, high: float, confidence: float = 0.85, cap: int = 40, classify=reversal_classifier) -> DataFrame:
    """Acts of the belief pass: (newer, older, verdict), newest first, at most ``cap``; linked pairs are left out."""
    skip = memories.filter(~F.col("type").isin("tool", "preference", "session"))
    p = sided(pairs.filter(F.col("sim").between(low, high)), skip, "type", "project", "content", "created_at")
    p = p.filter((F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")))
    linked = relations.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    p = p.join(linked, ["a", "b"], "left_anti")
    first = F.struct("created_at_a", F.col("a")) > F.struct("created_at_b", F.col("b"))
    pick = lambda c: (F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("newer"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("older"), classify(*pick("content")).alias("c"), pick("created_at")[0].alias("at"), "sim")
    p = p.filter((F.col("c.confidence") >= confidence) & F.col("c.verdict").isin("supersedes", "contradicts"))
    return p.orderBy(F.desc("at"), "newer", "older").limit(cap).select("newer", "older", F.col("c.verdict").alias("verdict"), "sim")


def auto_revisions(pairs: DataFrame, memories: DataFrame, low: float = 0.80, high: float = 0.97, confidence: float = 0.85, k: int = 6, classify=reversal_classifier) -> DataFrame:
    """What each write revises (source_id, target_id, relation_type, weight): its closest older neighbour in the band, if the classifier is sure.

    Among the k nearest those of its type and a compatible project count; of
    equally close ones the least id.  Only the closest is classified.
    """
    near = sided(top_neighbours(pairs, k), memories, "type", "project", "content")
    ok = (F.col("b") < F.col("a")) & (F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")) & F.col("sim").between(low, high)
    best = near.filter(ok).groupBy("a").agg(F.max_by(F.struct("b", "content_a", "content_b"), F.struct("sim", -F.col("b"))).alias("x"))
    said = best.select("a", "x.b", classify(F.col("x.content_a"), F.col("x.content_b")).alias("c"))
    said = said.filter(F.col("c.verdict").isin("supersedes", "contradicts") & (F.col("c.confidence") >= confidence))
    return said.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("c.verdict").alias("relation_type"), F.col("c.confidence").alias("weight"))


def batch_duplicates(probes: DataFrame, threshold: float, folder: str) -> DataFrame:
    """Rows of a batch (n, id, type, project, embedding) that saving one by one would skip: (id, matched).

    In order of n, a row is skipped if it is close to an earlier row that is
    saved, of its type and a compatible project; ``matched`` is the closest.
    """
    pairs = similar_pairs(probes, threshold, key="n")
    side = lambda s: probes.select(F.col("n").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "type", "project")])
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")))
    chosen = graph.first_independent(close.select("a", "b"), folder)
    kept = close.join(chosen.filter("kept").select(F.col("node").alias("a")), "a", "left_semi")
    kept = kept.join(chosen.filter("not kept").select(F.col("node").alias("b")), "b", "left_semi")
    return kept.groupBy(F.col("id_b").alias("id")).agg(F.max_by("id_a", F.struct("sim", "id_a")).alias("matched"))


def clusters(pairs: DataFrame, memories: DataFrame, relations: DataFrame, now, threshold: float, folder: str, least: int = 3, most: int = 3, k: int = 10) -> DataFrame:
    """Greedy clusters (project, type, seed, member): seeds oldest first, members not used again, ``most`` clusters in all.

    Candidates are older than a week, made by no consolidation, not tools,
    preferences or sessions, and no end of a part_of edge.  A neighbour must
    be among the seed's k nearest of all memories.  The choice is that of a
    loop over the seeds in order, made in rounds over all of them.
    """
    ends = relations.filter("relation_type = 'part_of'").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    ok = ~F.col("type").isin("tool", "preference", "session") & (F.col("created_at") < now - F.expr("interval 7 days")) & (F.coalesce("meta_source", F.lit("")) != "consolidation")
    pool = memories.filter(ok).join(ends, "id", "left_anti")
    near = sided(top_neighbours(pairs, k).filter(F.col("sim") >= threshold), pool, "type", "project", "created_at")
    near = near.filter((F.col("type_a") == F.col("type_b")) & F.col("project_a").eqNullSafe(F.col("project_b")))
    stars = near.select(F.struct(F.col("created_at_a").alias("at"), F.col("a").alias("id")).alias("seed"), F.col("b").alias("member"))
    found = graph.greedy_stars(stars, least, folder).select(F.col("seed.id").alias("seed"), "member", F.col("seed.at").alias("at"))
    found = found.join(pool.select(F.col("id").alias("seed"), "project", "type"), "seed")
    order = found.select("project", "type", "seed", "at").distinct().orderBy(F.col("project").asc_nulls_first(), "type", "at", "seed").limit(most)
    return found.join(order.select("seed"), "seed", "left_semi").select("project", "type", "seed", "member")


def audit(pairs: DataFrame, relations: DataFrame, cutoffs: list[float]) -> DataFrame:
    """For each cut-off the pairs at or above it: all, unlinked, linked by supersedes, and linked by anything."""
    kinds = relations.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.collect_set("relation_type").alias("kinds"))
    p = pairs.join(kinds, ["a", "b"], "left").withColumn("cutoff", F.explode(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: F.col("sim") >= c)))
    linked = F.col("kinds").isNotNull()
    return p.groupBy("cutoff").agg(F.count("*").alias("pairs"), F.count_if(~linked).alias("unlinked"), F.count_if(F.coalesce(F.array_contains("kinds", "supersedes"), F.lit(False))).alias("superseding"), F.count_if(linked).alias("linked"))


def newer_sibling(pairs: DataFrame, memories: DataFrame, relations: DataFrame, threshold: float = 0.85, k: int = 8) -> DataFrame:
    """Each memory's replacement: the closest newer one of the very same project among its k nearest, with the count in band."""
    gone = relations.filter("relation_type = 'supersedes'").select(F.col("target_id").alias("b")).distinct()
    near = sided(top_neighbours(pairs, k), memories, "project", "created_at").join(gone, "b", "left_anti")
    near = near.filter(F.col("project_a").eqNullSafe(F.col("project_b")) & (F.col("created_at_b") > F.col("created_at_a")) & (F.col("sim") >= threshold))
    return near.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("sim", (-F.col("b")).alias("n"))).alias("x"), F.count("*").alias("in_band")).select("id", (-F.col("x.n")).alias("sibling"), F.col("x.sim").alias("sim"), "in_band")


def cleanup(pairs: DataFrame, memories: DataFrame, threshold: float, rename: dict[str, str], folder: str) -> DataFrame:
    """Reversible dedup after labels are unified: (canonical, duplicate), the newest being canonical; series stay."""
    unified = memories.replace(rename, subset=["project"]) if rename else memories
    p = sided(pairs.filter(F.col("sim") >= threshold), marked(unified.filter("type <> 'tool'")), "type", "project", "series")
    p = p.filter((F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")) & ~T.series_marked(F.col("series_a"), F.col("series_b")))
    return _newest(p.select("a", "b"), unified, folder)


def cleanup_vectors(vectors: DataFrame, memories: DataFrame, threshold: float, rename: dict[str, str], folder: str) -> DataFrame:
    """``cleanup`` of all pairs of vectors (memory_id, embedding), which are never listed."""
    unified = memories.replace(rename, subset=["project"]) if rename else memories
    # a mark that is null rules out what a true one does
    mark = lambda m: F.when(F.coalesce(F.col("series")[m], F.lit(True)), "x").alias(m)
    facts = marked(unified.filter("type <> 'tool'")).select(F.col("id").alias("memory_id"), "type", "project", mark("formula"), mark("dated"))
    links = linking_pairs(vectors, threshold, facts=facts, same=["type"], agree=["project"], apart=["formula", "dated"])
    return _newest(links, unified, folder)


def _newest(links: DataFrame, memories: DataFrame, folder: str) -> DataFrame:
    g = components(links, folder).withColumnRenamed("node", "id").join(memories.select("id", "created_at"), "id")
    newest = g.groupBy("component").agg(F.max(F.struct("created_at", (-F.col("id")).alias("n"))).alias("x")).select("component", (-F.col("x.n")).alias("canonical"))
    return g.join(newest, "component").filter("id <> canonical").select("canonical", F.col("id").alias("duplicate"))


