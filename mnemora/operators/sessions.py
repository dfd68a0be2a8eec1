"""Session context, digests and health figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import scoring as S
from mnemora.operators.recall import current, hook_scope



def top(df: DataFrame, section: str, n: int, *order: Column) -> DataFrame:
    """The first n rows by an order as a section: (section, pos, id)."""
    rows = df.orderBy(*order).limit(n)
    return rows.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("pos"), F.col("id").cast("string").alias("id"))  # n rows


def start(memories: DataFrame, sessions: DataFrame, now: Column, project: str | None = None) -> DataFrame:
    """What a session starts with: recent sessions of the very project, preferences that age slowly, recent decisions, entities most read."""
    m = memories.filter(hook_scope(project))
    same = F.col("project").eqNullSafe(F.lit(project))
    age = F.least(S.days_between(now, F.col("created_at")) / 365, F.lit(1.0))
    worth = F.round(F.coalesce("importance", F.lit(0.5)) * (0.7 + 0.3 * (1 - age)), 9)
    recent = F.col("created_at") >= now - F.expr("interval 7 days")
    out = top(sessions.filter(same), "sessions", 3, F.desc("started_at"), F.col("id"))
    out = out.unionByName(top(m.filter("type = 'preference'"), "preferences", 5, F.desc(worth), F.col("id")))
    out = out.unionByName(top(m.filter((F.col("type") == "decision") & recent), "decisions", 5, F.desc("created_at"), F.col("id")))
    return out.unionByName(top(m.filter("type = 'entity'"), "entities", 5, F.desc("access_count"), F.desc("created_at"), F.col("id")))


def digest(memories: DataFrame, relations: DataFrame, project: str | None = None, compact: bool = False) -> DataFrame:
    """The start digest: the hot tier, then decisions before discoveries, then preferences; after compaction the hot tier alone."""
    m = memories.filter(hook_scope(project))
    worth = F.coalesce("importance", F.lit(0.5))
    hot = top(m.filter(~F.col("type").isin("tool", "session") & (worth >= 0.8)), "hot", 3, F.desc(worth), F.desc("created_at"), F.col("id"))
    if compact:
        return hot
    live = current(m, relations)
    tier = F.when(F.col("type") == "decision", 0).otherwise(1)
    made = top(live.filter(F.col("type").isin("decision", "discovery")), "decisions", 6, tier, F.desc(worth), F.desc("created_at"), F.col("id"))
    liked = top(live.filter("type = 'preference'"), "preferences", 3, F.desc(worth), F.desc("created_at"), F.col("id"))
    return hot.unionByName(made).unionByName(liked)


def by_type(memories: DataFrame) -> DataFrame:
    return memories.groupBy("type").agg(F.count("*").alias("count"))


def tiers(memories: DataFrame) -> DataFrame:
    """Counts of hot, warm and cold memories and their mean importance, tools aside."""
    w = F.coalesce("importance", F.lit(0.5))
    m = memories.filter("type <> 'tool'")
    return m.agg(F.count_if(w >= 0.8).alias("hot"), F.count_if((w >= 0.4) & (w < 0.8)).alias("warm"), F.count_if(w < 0.4).alias("cold"), F.round(F.avg(w), 3).alias("mean_importance"))


def counts(memories: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Counts over the last week, of summaries and of syntheses, with a label of activity."""
    week = F.count_if(F.col("created_at") >= now - F.expr("interval 7 days"))
    m = memories.agg(week.alias("last_week"), F.count_if(F.col("meta_source") == "consolidation").alias("syntheses"), F.count("*").alias("total"))
    s = sessions.agg(F.count("summary").alias("with_summary"), F.count("*").alias("sessions"))
    return m.crossJoin(s).withColumn("activity", F.when(F.col("last_week") > 10, "HIGH").otherwise("NORMAL"))  # one row each


def gate_report(gated: DataFrame, top_n: int = 20) -> DataFrame:
    """Prompts by skip reason, the most frequent first."""
    return gated.groupBy("reason").agg(F.count("*").alias("n"), F.first("skip").alias("skip")).orderBy(F.desc("n"), "reason").limit(top_n)


def registry_audit(projects: DataFrame, folders: DataFrame) -> DataFrame:
    """Faults of a registry (name, path, status) against folders (path): missing, stale, and not exactly one primary."""
    stale = projects.join(folders, "path", "left_anti").select(F.lit("stale_path").alias("fault"), "name")
    missing = folders.join(projects, "path", "left_anti").select(F.lit("unregistered").alias("fault"), F.col("path").alias("name"))
    primary = projects.agg(F.count_if(F.col("status") == "primary").alias("n")).filter("n <> 1").select(F.lit("primary_count").alias("fault"), F.col("n").cast("string").alias("name"))
    return stale.unionByName(missing).unionByName(primary)


def freshness(status: DataFrame, commits: DataFrame, ignored: list[str]) -> DataFrame:
    """Projects whose status is older than the newest commit outside ignored prefixes: (project, updated, newest, stale)."""
    keep = F.lit(True)
    for p in ignored:
        keep = keep & ~F.col("path").startswith(p)
    newest = commits.filter(keep).groupBy("project").agg(F.max("date").alias("newest"))
    return status.join(newest, "project", "left").select("project", "updated", "newest", F.coalesce(F.col("newest") > F.col("updated"), F.lit(False)).alias("stale"))


def size_warnings(files: DataFrame) -> DataFrame:
    """(path, lines, level) of text files that grew too long."""
    n = files.groupBy("path").agg(F.count("*").alias("lines"))
    return n.withColumn("level", F.when(F.col("lines") > 250, "SEVERE").when(F.col("lines") > 200, "WARNING")).filter("level is not null")


#: Lists of a session's learnings, and the type that each is saved as.
LEARNED = {"decisions": "decision", "discoveries": "discovery", "entities": "entity"}


def saved(ended: DataFrame, log: DataFrame, now: Column, cluster_from: int = 4) -> tuple[DataFrame, DataFrame]:
    """Ending sessions (id, project, summary, decisions, discoveries, entities): (session rows, memories to save).

    A session that is not in the log (id, project, started_at, ended_at) is
    created; without a project it inherits that of the log's last one.  Session
    rows tell how many memories they made, and whether to look for clusters:
    from ``cluster_from`` memories on, the first time that the session ends.
    """
    last = log.agg(F.max_by("project", F.struct("started_at", "id")).alias("inherited"))  # one row
    known = log.select("id", F.col("project").alias("own"), F.col("ended_at").alias("before"), F.lit(True).alias("there"))
    e = ended.join(known, "id", "left").crossJoin(F.broadcast(last))
    e = e.withColumn("project", F.when(F.col("there"), F.col("own")).otherwise(F.coalesce("project", "inherited")))

    def typed(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("content"))

    e = e.withColumn("items", F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), typed(kind)) for c, kind in LEARNED.items()]))
    rows = e.select("id", "project", "summary", now.alias("ended_at"), F.coalesce("there", F.lit(False)).alias("known"), F.size("items").alias("memories"), ((F.size("items") >= cluster_from) & F.col("before").isNull()).alias("cluster"))
    memories = e.select(F.col("id").alias("session"), "project", F.posexplode("items").alias("n", "item")).select("session", "n", "item.type", "item.content", F.lit(None).cast("string").alias("project"), F.lit("wrap").alias("meta_source"))
    return rows, memories
