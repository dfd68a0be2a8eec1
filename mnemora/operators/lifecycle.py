"""Mutations and lifecycle as pure functions: each returns the changes; a dry run just does not append them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import scoring as S
from mnemora.functions import telex
from mnemora.operators.graph import degree
from mnemora.sources.store import RELATIONS, content_id


def save_batch(new: DataFrame, now: Column, known_duplicates: DataFrame | None = None) -> DataFrame:
    """Rows to insert of (content, type, tags, project, meta_source): normalised, with id, importance and status.

    Equal content, type and project inside the batch are saved once; rows
    whose id is among ``known_duplicates`` (id, matched) are skipped.
    """
    n = new.withColumn("content", telex.normalize(F.col("content")))
    n = n.withColumns({"id": content_id(F.col("content"), F.col("type"), F.col("project")), "importance": S.initial_importance(F.col("type"), F.col("meta_source"))})
    n = n.dropDuplicates(["id"]).withColumns({"created_at": now, "access_count": F.lit(0).cast("long")})
    if known_duplicates is None:
        return n.withColumns({"status": F.lit("saved"), "matched": F.lit(None).cast("string")})
    return n.join(known_duplicates, "id", "left").withColumn("status", F.when(F.col("matched").isNull(), "saved").otherwise("skipped_near_duplicate"))


def update_fold(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """Memories with patches (id, content, tags, ...) applied: null patch columns change nothing."""
    columns = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = memories.join(p, "id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in memories.columns])


def update_status(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, status) of each patch: updated, not_found, or empty."""
    known = memories.select("id", F.lit(True).alias("known"))
    columns = [c for c in patches.columns if c != "id"]
    empty = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in columns]).isNull()
    return patches.join(known, "id", "left").select("id", F.when(F.col("known").isNull(), "not_found").when(empty, "empty").otherwise("updated").alias("status"))


def unlink(memories: DataFrame, relations: DataFrame, requests: DataFrame, restore: bool = True) -> DataFrame:
    """(source_id, target_id, relation_type, status, importance) of each request; removing supersedes doubles the target's importance again."""
    key = ["source_id", "target_id", "relation_type"]
    r = requests.join(relations.select(*key, F.lit(True).alias("there")), key, "left").join(memories.select(F.col("id").alias("target_id"), "importance"), "target_id", "left")
    status = F.when(~F.col("relation_type").isin(RELATIONS), "invalid_relation_type").when(F.col("there").isNull(), "not_found").otherwise("unlinked")
    back = F.when((status == "unlinked") & (F.col("relation_type") == "supersedes") & F.lit(restore), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)) * 2)).otherwise(F.col("importance"))
    return r.select(*key, status.alias("status"), back.alias("importance"))


def demoted(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, importance) of the targets of new supersedes edges, halved for each."""
    hit = edges.filter("relation_type = 'supersedes'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return memories.join(hit, "id").select("id", (F.coalesce("importance", F.lit(0.5)) * F.pow(F.lit(0.5), F.col("n"))).alias("importance"))


def accessed(results: DataFrame, now: Column) -> DataFrame:
    """Access events of the final results."""
    return results.select("id", now.alias("ts"), F.lit("recall").alias("kind"))


def backfill_importance(memories: DataFrame) -> DataFrame:
    """One-time: rows at exactly 0.5 that were read or have a source get their initial importance and access boost."""
    raised = S.access_boost(S.initial_importance(F.col("type"), F.col("meta_source")), F.col("access_count"))
    due = (F.col("importance") == 0.5) & ((F.col("access_count") > 0) | F.col("meta_source").isNotNull())
    return memories.withColumn("importance", F.when(due, raised).otherwise(F.col("importance")))


def upsert(table: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Key-value state after changes."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def decay_patterns(memories: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Patterns never read and older than the limit: ids to delete."""
    return memories.filter((F.col("type") == "pattern") & (F.col("access_count") == 0) & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))).select("id")


def decay_actions(memories: DataFrame, relations: DataFrame, now: Column, since_days: float = 7.0) -> DataFrame:
    """Each memory's fate (id, action, importance): exempt, prune below 0.05, decay where it moves by over 0.01, else keep."""
    m = memories.join(degree(relations), "id", "left")
    base = F.coalesce("importance", F.lit(0.5))
    boosted = F.least(F.lit(1.0), base + S.hub_boost(F.col("degree")))
    idle = S.days_between(now, F.coalesce("last_accessed", "created_at"))
    exempt = F.col("type").isin("preference", "tool") | F.coalesce(S.days_between(now, F.col("last_accessed")) <= 7, F.lit(False))
    after = F.round(S.decay(boosted, F.least(idle, F.lit(since_days))), 4)
    action = F.when(exempt, "exempt").when(after < 0.05, "prune").when(F.abs(after - boosted) > 0.01, "decay").otherwise("keep")
    return m.select("id", action.alias("action"), F.round(F.when(action == "decay", after).otherwise(base), 4).alias("importance"))


def weekly_digest(sessions: DataFrame, now: Column, days: int = 30, known: DataFrame | None = None) -> DataFrame:
    """Digests of weeks with two old sessions or more: (tag, sessions, content); weeks with a known tag are left out."""
    s = sessions.filter((F.col("started_at") < now - F.make_dt_interval(F.lit(days))) & F.col("summary").isNotNull())
    tag = F.concat(F.coalesce("project", F.lit("global")), F.lit("_"), F.extract(F.lit("YEAROFWEEK"), F.col("started_at")).cast("string"), F.lit("_W"), F.lpad(F.weekofyear("started_at").cast("string"), 2, "0"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_at", "id", "summary"))), lambda r: F.concat(F.lit("- "), r["summary"])), "\n")
    out = s.groupBy(tag.alias("tag")).agg(F.count("*").alias("sessions"), lines.alias("content")).filter("sessions >= 2")
    return out if known is None else out.join(known.select("tag"), "tag", "left_anti")


def loop_residue(memories: DataFrame, relations: DataFrame, since: Column, most: int = 4) -> DataFrame:
    """Syntheses since a date with few members: (id, cluster_size)."""
    size = relations.filter("relation_type = 'part_of'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    c = memories.filter((F.col("meta_source") == "consolidation") & (F.col("created_at") >= since)).join(size, "id", "left")
    return c.select("id", F.coalesce("n", F.lit(0)).alias("cluster_size")).filter(F.col("cluster_size") <= most)


def expired(memories: DataFrame, now: Column, source: str, days: int = 14) -> DataFrame:
    """Short-lived rows of a source past their time."""
    return memories.filter((F.col("meta_source") == source) & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))).select("id")


def breaker(runs: DataFrame, limit: int = 3, key: str | None = None) -> DataFrame:
    """A run log (seq, ok) with the failures in a row so far and whether the next run is held back, for each key if one is named."""
    keys = [key] if key else []
    w = Window.partitionBy(*keys).orderBy("seq")  # without a key, one run log, which is small
    r = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    failures = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy(*keys, "island").orderBy("seq"))
    return r.select(*keys, "seq", "ok", failures.alias("failures"), (failures >= limit).alias("open"))


def due(last_run: Column, now: Column, sessions_since: Column, days: int = 3, sessions: int = 3) -> Column:
    """Whether consolidation may run: enough time and enough sessions."""
    return (S.days_between(now, last_run) >= days) & (sessions_since >= sessions)


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, project) pairs on one side only, with the side."""
    a, b = left.select("name", "project").distinct(), right.select("name", "project").distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def fingerprint_of(rows: DataFrame, column: str) -> DataFrame:
    """One hash of a set of values, whatever their order: of each value's hash, summed, with the count."""
    h = F.sum(F.xxhash64(column).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), h.cast("string")), 256).alias("fingerprint"))


def merged_metadata(old: Column, patch: Column) -> Column:
    """A JSON object of strings with another's keys added or replaced; null counts as empty."""
    of = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(of(old), lambda k, _: ~F.map_contains_key(of(patch), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, of(patch))))))


def topic_index(memories: DataFrame, now: Column, stale_days: int = 30) -> DataFrame:
    """(tag, type, n, stale): memories of each tag and type, and how many were not read within the days given."""
    read = F.coalesce("last_accessed", "created_at")
    tags = memories.select(F.explode(F.array_distinct("tags")).alias("tag"), "type", (S.days_between(now, read) > stale_days).alias("old"))
    return tags.groupBy("tag", "type").agg(F.count("*").alias("n"), F.count_if("old").alias("stale"))


def signal_ratio(shown: DataFrame, scores: DataFrame, drop_max: int = 3) -> DataFrame:
    """Useful results a week (week, signal, noise, ratio): shown ones (id, at) that a judge (memory_id, score) rates above ``drop_max``."""
    j = shown.join(scores.select(F.col("memory_id").alias("id"), "score"), "id")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "at").cast("string"), F.lit("_W"), F.lpad(F.weekofyear("at").cast("string"), 2, "0"))
    good = F.count_if(F.col("score") > drop_max)
    return j.groupBy(week.alias("week")).agg(good.alias("signal"), (F.count("*") - good).alias("noise"), F.round(good / F.count("*"), 6).alias("ratio"))


#: Strategies that may run unattended: the others lower or delete what was not read.
SAFE = ("merge", "sessions", "cluster")


def consolidation(strategies: dict[str, dict[str, DataFrame]], run: tuple[str, ...] = SAFE) -> DataFrame:
    """The report of a dry run (strategy, counter, n): rows of each counter's change set, of the strategies to run.

    ``strategies`` has each strategy's change sets by counter; those not run
    are not evaluated.  Unknown names raise.
    """
    if unknown := set(run) - set(strategies):
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    out = None
    for name in run:
        for counter, changes in strategies[name].items():
            row = changes.agg(F.count("*").alias("n")).select(F.lit(name).alias("strategy"), F.lit(counter).alias("counter"), "n")
            out = row if out is None else out.unionByName(row)
    return out


def lease(locks: DataFrame, asks: DataFrame, stale_minutes: int = 60) -> DataFrame:
    """Who gets the lock: (name, owner, at, granted, held_by) for each ask (name, owner, at) against the lock's last holder (name, owner, at).

    A lock is granted if nobody holds it, the asker does, or it went stale; of
    asks at one lock the first wins, by time and owner.
    """
    held = locks.groupBy("name").agg(F.max_by("owner", F.struct("at", "owner")).alias("holder"), F.max("at").alias("since"))
    first = F.row_number().over(Window.partitionBy("name", "free").orderBy("at", "owner")) == 1
    a = asks.join(held, "name", "left")
    free = F.col("holder").isNull() | (F.col("holder") == F.col("owner")) | (F.col("at") - F.col("since") >= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(stale_minutes)))
    a = a.withColumn("free", free).withColumn("granted", F.col("free") & first)
    return a.select("name", "owner", "at", "granted", F.when(~F.col("free"), F.col("holder")).alias("held_by"))


def backfilled(memories: DataFrame, marked: DataFrame, factor: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """What supersede markers (id, source, target, confidence) do: edges of the sure ones, and changes (id, importance, review).

    The target of a sure edge loses part of its importance; unsure markers
    only flag their memory for review.
    """
    sure = marked.filter((F.col("confidence") == "high") & F.col("source").isNotNull() & F.col("target").isNotNull())
    edges = sure.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("supersedes").alias("relation_type")).distinct()
    hit = edges.select(F.col("target_id").alias("id"), F.lit(True).alias("hit")).distinct()
    flag = marked.filter(F.col("confidence") != "high").select("id", F.lit(True).alias("flag")).distinct()
    m = memories.join(hit, "id", "left").join(flag, "id", "left").filter("hit or flag")
    lowered = F.when(F.col("hit"), F.coalesce("importance", F.lit(0.5)) * factor).otherwise(F.col("importance"))
    return edges, m.select("id", lowered.alias("importance"), F.coalesce("flag", F.lit(False)).alias("review"))
