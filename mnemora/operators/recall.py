"""Hybrid recall: full-text and vector legs, fused, weighted, scoped, deduplicated, judged and flagged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemora.functions import scoring as S
from mnemora.functions import text as T
from mnemora.operators import fts
from mnemora.operators import vectors as V
from mnemora.operators.textindex import TextIndex

LEG = 20
#: Query vectors held at once in a scan of all vectors.
QUERY_BLOCK = 1024


def scope(project: str | None, kind: str | None = None) -> Column:
    """Recall's scope: the project's and global rows; without a project all rows, but global tools only."""
    if project is not None:
        return (F.col("project") == project) | F.col("project").isNull()
    return F.col("project").isNull() if kind == "tool" else F.lit(True)


def hook_scope(project: str | None) -> Column:
    """The prompt path's scope: the project's and global rows; without a project global rows only."""
    return F.coalesce(F.col("project") == F.lit(project), F.lit(False)) | F.col("project").isNull()


def compatible(a: Column, b: Column) -> Column:
    """Pairs whose projects agree, null agreeing with any."""
    return a.isNull() | b.isNull() | (a == b)


def current(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows that nothing supersedes."""
    gone = relations.filter("relation_type = 'supersedes'").select(F.col("target_id").alias("id")).distinct()
    return memories.join(gone, "id", "left_anti")


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "memory_id") -> DataFrame:
    """The k nearest of each query by cosine: (query_id, id, sim, vec_pos), places 1-based, ties by id.

    Queries (query_id, vec) are sent in blocks of QUERY_BLOCK to one scan of
    the vectors each; a batch of vectors hands on its own k best a query.
    """
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    kinds = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    arrow = [to_arrow_type(t) for t in kinds]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, sim double"
    out = None
    for b in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "vec").filter("vec is not null").orderBy("query_id").collect()
        if not rows:
            continue
        q = np.array([r["vec"] for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        held = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], q))

        def run(batches, held=held):
            ids, q = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                place = np.empty(len(keys), np.int64)
                place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                sim = np.round(q @ m.T, 6)
                bar = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k] if len(keys) > k else -np.inf
                qi, mi = np.nonzero(sim >= bar)  # the k best and what ties with the last of them
                order = np.lexsort((place[mi], -sim[qi, mi], qi))
                qi, mi = qi[order], mi[order]
                first = np.searchsorted(qi, qi)
                qi, mi = qi[(at := np.arange(len(qi)) - first) < k], mi[at < k]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in qi], arrow[0]), pa.array(keys[mi], arrow[1]), pa.array(sim[qi, mi])], ["query_id", "id", "sim"])

        found = vectors.filter("embedding is not null").select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema + ", vec_pos int")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return out.withColumn("vec_pos", F.row_number().over(w)).filter(F.col("vec_pos") <= k)


def text_leg(memories: DataFrame, queries: DataFrame, mode: str = "all", limit: int = LEG, index: TextIndex | None = None) -> DataFrame:
    """The best ``limit`` memories of each query by BM25: (query_id, id, score, fts_pos).

    With ``index``, that of these memories, only the queries' terms are read;
    without one, all texts are.
    """
    terms = queries.select("query_id", F.flatten(F.transform(T.query_phrases(F.col("query")), T.tokens)).alias("terms"))
    if index is not None and mode != "all":
        return index.top(terms, limit)
    scored = index.match_all(queries) if index is not None else fts.bm25(memories, terms, only=fts.match_all(memories, queries) if mode == "all" else None)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("fts_pos", F.row_number().over(w)).filter(F.col("fts_pos") <= limit).select("query_id", "id", "score", "fts_pos")


def recall(memories: DataFrame, vectors: DataFrame, relations: DataFrame, queries: DataFrame, k: int = 5, *, kind: str | None = None, project: str | None = None, since: Column | None = None, mode: str = "post", text_mode: str = "all", index: TextIndex | None = None) -> DataFrame:
    """The k best memories of each query (query_id, query, vec): (query_id, pos, id, type, score, fts_hit, vec_hit).

    ``post`` filters after each leg's top 20, ``pre`` before them.  A query
    without terms falls back to its vector leg, with fts_hit null.  ``index``
    is the stored index of all memories; ``pre`` scores the filtered texts.
    """
    keep = scope(project, kind)
    if kind is not None:
        keep = keep & (F.col("type") == kind)
    if since is not None:
        keep = keep & (F.col("created_at") >= since)
    allowed = current(memories.filter(keep), relations)
    pool, vecs = memories, vectors
    if mode == "pre":
        pool, vecs = allowed, vectors.join(allowed.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    texts, near = text_leg(pool, queries, text_mode, index=index if mode == "post" else None), knn(vecs, queries, LEG)
    both = texts.select("query_id", "id", "fts_pos").join(near.select("query_id", "id", "vec_pos"), ["query_id", "id"], "full")
    blank = queries.select("query_id", (F.size(T.query_phrases(F.col("query"))) == 0).alias("blank"))
    rows = both.join(allowed.select("id", "type", "importance", "created_at"), "id").join(blank, "query_id")
    score = F.round(S.recall_weight(S.rrf(F.col("fts_pos"), F.col("vec_pos")), F.col("importance")), 9)
    rows = rows.select("query_id", "id", "type", score.alias("score"), F.when(~F.col("blank"), F.col("fts_pos").isNotNull()).alias("fts_hit"), F.col("vec_pos").isNotNull().alias("vec_hit"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def hook_rank(memories: DataFrame, vectors: DataFrame, relations: DataFrame, queries: DataFrame, now: Column, project: str | None = None, k: int = 8, index: TextIndex | None = None) -> DataFrame:
    """The prompt path's ranking: any-of text leg and vector leg with 0-based places, type tiers and today's bonus.

    ``index`` is the stored index of all memories; frequencies are those of the pool.
    """
    ok = hook_scope(project) & ~F.col("type").isin("tool", "session") & (F.coalesce("importance", F.lit(0.5)) >= 0.3)
    pool = current(memories.filter(ok), relations)
    words = queries.select("query_id", F.array_distinct(F.flatten(F.transform(T.any_words(F.col("query")), T.tokens))).alias("terms"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    texts = (fts.bm25(pool, words) if index is None else index.bm25_within(words, pool)).withColumn("f", F.row_number().over(w) - 1).filter(F.col("f") < LEG)
    near = knn(vectors.join(pool.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), queries, LEG)
    both = texts.select("query_id", "id", "f").join(near.select("query_id", "id", (F.col("vec_pos") - 1).alias("v")), ["query_id", "id"], "full").join(pool.select("id", "type", "importance", "created_at"), "id")
    today = F.to_date("created_at") == F.to_date(now)
    score = F.round(S.hook_score(S.rrf(F.col("f"), F.col("v")), F.col("importance"), F.col("type"), today), 9)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("importance", F.lit(0.5))), "id")
    return both.withColumn("score", score).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("query_id", "pos", "id", "type", "score")


def judged(pool: DataFrame, scores: DataFrame, n: int, drop_max: int = 3, order: str = "pos") -> DataFrame:
    """Rerank a pool (query_id, id, pos) by a judge's scores: low ones go, unscored ones keep their order at the end."""
    j = pool.join(scores.select(F.col("memory_id").alias("id"), F.col("score").alias("judge")), "id", "left").filter(F.col("judge").isNull() | (F.col("judge") > drop_max))
    w = Window.partitionBy("query_id").orderBy(F.col("judge").isNull(), F.desc("judge"), order)
    return j.withColumn("judge_pos", F.row_number().over(w)).filter(F.col("judge_pos") <= n)


def noise_gate(results: DataFrame, status: Column) -> DataFrame:
    """Empties a query's results where the judge did not run and no row has a text hit or an unknown one."""
    w = Window.partitionBy("query_id")
    known = F.bool_or(F.coalesce("fts_hit", F.lit(True))).over(w)
    return results.withColumn("_ok", status.isin("ok", "fallback:min_candidates") | known).filter("_ok").drop("_ok")


def final_flags(final: DataFrame, relations: DataFrame, low: float = 0.80, high: float = 0.985, most: int = 12) -> DataFrame:
    """Which of a query's answers belong together and differ: (query_id, id, role, vs, age).

    ``final`` (query_id, rank, id, type, project, content, created_at,
    embedding) has at most ``most`` rows a query, ranks from 1; only its own
    pairs are looked at.  A pair is in conflict where type and project agree
    and the cosine is in the band, series entries apart, or where an edge says
    that one contradicts or supersedes the other.  Of rows joined by such
    pairs the newest is current, equal times by the least id.
    """
    side = lambda s: final.select("query_id", *[F.col(c).alias(f"{c}_{s}") for c in ("rank", "id", "type", "project", "content", "embedding")])
    pairs = side("a").join(side("b"), "query_id").filter("rank_a < rank_b")
    told = relations.filter(F.col("relation_type").isin("contradicts", "supersedes")).select(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high")).distinct().withColumn("told", F.lit(True))
    pairs = pairs.withColumns({"low": F.least("id_a", "id_b"), "high": F.greatest("id_a", "id_b")}).join(told, ["low", "high"], "left")
    sim = F.round(V.cosine(F.col("embedding_a"), F.col("embedding_b")), 6)
    alike = (F.col("type_a") == F.col("type_b")) & compatible(F.col("project_a"), F.col("project_b")) & sim.between(low, high) & ~F.coalesce(T.series_pair(F.col("content_a"), F.col("content_b")), F.lit(False))
    pairs = pairs.filter(F.coalesce(alike, F.lit(False)) | F.col("told").isNotNull())
    links = pairs.groupBy("query_id").agg(F.collect_list(F.struct(F.col("rank_a").alias("a"), F.col("rank_b").alias("b"))).alias("links"))
    # each rank takes the least label of its neighbours, as often as a chain may be long
    ranks = F.sequence(F.lit(1), F.lit(most))
    least = lambda labels, i: F.array_min(F.transform(F.filter("links", lambda e: (e["a"] == i) | (e["b"] == i)), lambda e: F.least(F.element_at(labels, e["a"]), F.element_at(labels, e["b"]))))
    labels = F.aggregate(ranks, ranks, lambda acc, _: F.transform(ranks, lambda i: F.coalesce(least(acc, i), F.element_at(acc, i))))
    grouped = links.select("query_id", "links", F.posexplode(labels).alias("rank", "component")).withColumn("rank", F.col("rank") + 1)
    grouped = grouped.filter(F.exists("links", lambda e: (e["a"] == F.col("rank")) | (e["b"] == F.col("rank")))).drop("links")
    g = grouped.join(final.select("query_id", "rank", "id", "created_at"), ["query_id", "rank"])
    w = Window.partitionBy("query_id", "component").orderBy(F.col("created_at").desc_nulls_last(), "id")
    g = g.withColumns({"newest": F.first("id").over(w), "newest_at": F.first("created_at").over(w)})
    mine = F.col("id") == F.col("newest")
    return g.select("query_id", "id", F.when(mine, "current").otherwise("superseded_candidate").alias("role"), F.when(~mine, F.col("newest")).alias("vs"), F.when(~mine, S.age_label(F.col("newest_at"), F.col("created_at"))).alias("age"))


def answered(memories: DataFrame, vectors: DataFrame, relations: DataFrame, queries: DataFrame, scores: DataFrame, status: Column, k: int = 5, least: int = 4, *, within: Column | None = None, duplicate: float = 0.92, band: tuple[float, float] = (0.80, 0.985), **kwargs) -> DataFrame:
    """Recall as a caller sees it: oversampled, without near duplicates, judged, gated, cut to k, flagged and projected.

    The pool loses rows close to a better one first.  A query that is not
    ``within`` its day's budget is not judged and has status fallback:budget;
    the judge (memory_id, score) reranks the others whose ``status`` is ok and
    that have ``least`` candidates or more, with status
    fallback:min_candidates where there are too few.  Where it did not run,
    results without any text hit are noise.  Conflict flags are those of the
    final rows among themselves.  Returns (query_id, pos, id, type, content,
    preview, tags, project, created_at, access_count, importance, relevance,
    dual_hit, judge, judge_status, role, vs, age); the status is on the first
    row only, and access is to be recorded for these rows alone.
    """
    pool = recall(memories, vectors, relations, queries, S.oversample(k), **kwargs)
    pool = pool.join(vectors.select(F.col("memory_id").alias("id"), "embedding"), "id", "left")
    kept = V.keep_distinct(pool.select("query_id", "id", "pos", "embedding"), duplicate)
    pool = pool.join(kept.select("query_id", "id"), ["query_id", "id"], "left_semi")
    pool = pool.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    budget = F.coalesce(within, F.lit(False)) if within is not None else F.lit(True)
    pool = pool.withColumn("status", F.when(~budget, "fallback:budget").when(F.col("n") < least, "fallback:min_candidates").otherwise(status))
    ran = F.col("status") == "ok"
    j = pool.join(scores.select(F.col("memory_id").alias("id"), F.col("score").alias("rated")), "id", "left").withColumn("judge", F.when(ran, F.col("rated")))
    order = Window.partitionBy("query_id").orderBy(F.col("judge").isNull(), F.desc("judge"), "pos")
    j = j.filter(F.col("judge").isNull() | (F.col("judge") > 3)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = noise_gate(j, F.col("status")).drop("pos", "type")
    final = best.join(memories.select("id", "type", "content", "tags", "project", "created_at", "access_count", "importance"), "id")
    flags = final_flags(final, relations, *band, most=k)
    out = final.join(flags, ["query_id", "id"], "left")
    dual = F.when(F.col("fts_hit").isNotNull(), F.col("fts_hit") & F.col("vec_hit"))
    return out.select(
        "query_id", F.col("rank").alias("pos"), "id", "type", "content", T.flat_clip(F.col("content")).alias("preview"), "tags", "project", "created_at", "access_count",
        F.round(F.coalesce("importance", F.lit(0.5)), 3).alias("importance"), F.round("score", 4).alias("relevance"), dual.alias("dual_hit"), "judge", F.when(F.col("rank") == 1, F.col("status")).alias("judge_status"), "role", "vs", "age",
    )


def within_budget(ranked: DataFrame, budget: int, length: Column, group: str = "query_id", order: str = "pos") -> DataFrame:
    """Rows in order while their lengths' running sum stays in the budget; the first that overflows ends it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("total", F.sum(length).over(w)).filter(F.col("total") <= budget)


def find_tools(memories: DataFrame, vectors: DataFrame, queries: DataFrame, project: str | None = None, floor: float = 0.35, k: int = 3, suggested: DataFrame | None = None) -> DataFrame:
    """The k nearest tools in scope above a cosine floor, without those already suggested (query_id, id)."""
    tools = memories.filter((F.col("type") == "tool") & (hook_scope(project) if project else F.col("project").isNull()))
    near = knn(vectors.join(tools.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), queries, 10).filter(F.col("sim") >= floor)
    if suggested is not None:
        near = near.join(suggested, ["query_id", "id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("vec_pos")
    return near.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("query_id", "pos", "id", "sim")
