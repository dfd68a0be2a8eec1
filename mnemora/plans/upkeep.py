"""More of the catalogue: whole answers, revisions, sessions, consolidation, markers, and small text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import beliefs, cache, extract, graph, lifecycle, sessions
from mnemora.operators import recall as R
from mnemora.plans import oracle as O
from mnemora.plans.catalogue import _BOTH, _COMPATIBLE, _TOP, ORACLES, folder, index_of, pairs_of, query, query_set, tables
from mnemora.sources import sinks, store
from mnemora.sources.commits import CommitLog
from mnemora.streaming import state

_PREVIEW = "CASE WHEN length(f) <= 200 THEN f ELSE CASE WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') >= 100 THEN substr(h, 1, length(h) - instr(reverse(h), ' ')) ELSE h END || '…' END"


@query(
    f"""WITH RECURSIVE {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.SCORES}, r AS ({O.recall(10)}),
close AS (SELECT n.query_id, n.id, n.pos, list(o.id) FILTER (o.pos < n.pos AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3) AS close FROM r n JOIN r o ON o.query_id = n.query_id LEFT JOIN vectors a ON a.memory_id = n.id LEFT JOIN vectors b ON b.memory_id = o.id GROUP BY n.query_id, n.id, n.pos),
step(query_id, pos, kept) AS (SELECT DISTINCT query_id, 0, []::BIGINT[] FROM r UNION ALL SELECT s.query_id, c.pos, CASE WHEN list_has_any(s.kept, coalesce(c.close, [])) THEN s.kept ELSE list_append(s.kept, c.id) END FROM step s JOIN close c ON c.query_id = s.query_id AND c.pos = s.pos + 1),
d AS (SELECT r.* FROM r JOIN (SELECT query_id, arg_max(kept, pos) AS kept FROM step GROUP BY query_id) k ON k.query_id = r.query_id WHERE list_contains(k.kept, r.id)),
p AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM d), st AS (SELECT *, CASE WHEN query_id % 5 = 4 THEN 'fallback:budget' WHEN n < 7 THEN 'fallback:min_candidates' WHEN query_id % 3 = 0 THEN 'fallback:timeout' ELSE 'ok' END AS status FROM p),
j AS (SELECT st.*, CASE WHEN status = 'ok' THEN s.score END AS judge FROM st LEFT JOIN judge_scores s ON st.id = s.memory_id),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY judge IS NULL, judge DESC, pos)::INT AS rank FROM j WHERE judge IS NULL OR judge > 3 QUALIFY rank <= 5),
g AS (SELECT *, bool_or(coalesce(fts_hit, true)) OVER (PARTITION BY query_id) AS hit FROM c),
k AS (SELECT g.query_id, g.rank, g.id, score, fts_hit, vec_hit, judge, status, m.* EXCLUDE (id), v.embedding FROM g JOIN memories m ON m.id = g.id LEFT JOIN vectors v ON v.memory_id = g.id WHERE status IN ('ok', 'fallback:min_candidates') OR hit),
cp AS (SELECT a.query_id AS q, a.id AS a, b.id AS b FROM k a JOIN k b ON a.query_id = b.query_id AND a.rank < b.rank LEFT JOIN (SELECT DISTINCT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi FROM relations WHERE relation_type IN ('contradicts', 'supersedes')) e ON e.lo = least(a.id, b.id) AND e.hi = greatest(a.id, b.id)
  WHERE e.lo IS NOT NULL OR (a.type = b.type AND (a.project IS NULL OR b.project IS NULL OR a.project = b.project) AND round(list_cosine_similarity(a.embedding, b.embedding), 6) BETWEEN 0.0 AND 0.25)),
ee AS (SELECT q, a, b FROM cp UNION SELECT q, b, a FROM cp), reach(q, node, c) AS (SELECT DISTINCT q, a, a FROM ee UNION SELECT ee.q, ee.b, reach.c FROM reach JOIN ee ON reach.q = ee.q AND reach.node = ee.a),
cc AS (SELECT q, node AS id, min(c) AS component FROM reach GROUP BY q, node),
newest AS (SELECT q, component, arg_max(cc.id, struct_pack(t := created_at, o := -cc.id)) AS newest, max(created_at) AS newest_at FROM cc JOIN memories m ON cc.id = m.id GROUP BY q, component),
flags AS (SELECT cc.q, cc.id, CASE WHEN cc.id = newest THEN 'current' ELSE 'superseded_candidate' END AS role, CASE WHEN cc.id <> newest THEN newest END AS vs,
  CASE WHEN cc.id <> newest THEN CASE WHEN newest_at - created_at >= INTERVAL 1 DAY THEN date_diff('day', created_at, newest_at) || 'd ago' ELSE 'earlier' END END AS age FROM cc JOIN newest n ON n.q = cc.q AND n.component = cc.component JOIN memories m ON cc.id = m.id),
t AS (SELECT id, f, substr(f, 1, 200) AS h FROM (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS f FROM memories))
SELECT k.query_id, k.rank AS pos, k.id, k.type, md5(k.content) AS content, {_PREVIEW} AS preview, k.lang || ',' || k.source AS tags, k.project, k.created_at, k.access_count, round(coalesce(k.importance, 0.5::DOUBLE), 3) AS importance, round(score, 4) AS relevance, CASE WHEN fts_hit IS NOT NULL THEN fts_hit AND vec_hit END AS dual_hit,
  judge, CASE WHEN k.rank = 1 THEN status END AS judge_status, role, vs, age FROM k JOIN t ON k.id = t.id LEFT JOIN flags x ON k.query_id = x.q AND k.id = x.id"""
)
def recall_answer(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recall, dedup of the pool, budget, judge, noise gate, conflict flags of the answer and projection in one."""
    m, v, r, q = tables(spark, d)
    status = F.when(F.col("query_id") % 3 == 0, "fallback:timeout").otherwise("ok")
    out = R.answered(m, v, r, q, store.judge_scores(spark, d), status, least=7, within=F.col("query_id") % 5 != 4, duplicate=0.3, band=(0.0, 0.25), index=index_of(spark, d))
    return out.withColumns({"tags": F.array_join("tags", ","), "content": F.md5("content")})


@query(
    f"""WITH {O.MEMORIES}, {O.VECTORS}, {O.PAIRS}, {_TOP.format(k=6)}, {_BOTH.format(t="top")},
x AS (SELECT * FROM sided WHERE b < a AND type_a = type_b AND {_COMPATIBLE} AND sim BETWEEN 0.31 AND 0.97 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1)
SELECT a AS source_id, b AS target_id, 'contradicts' AS relation_type, 0.9::DOUBLE AS weight FROM x WHERE length(content_a) > length(content_b)"""
)
def auto_revision(spark: SparkSession, d: str) -> DataFrame:
    """What each write revises, with a classifier by length so that sure and unsure pairs show."""
    longer = lambda a, b: F.struct(F.lit("contradicts").alias("verdict"), F.when(F.length(a) > F.length(b), 0.9).otherwise(0.2).alias("confidence"))
    return beliefs.auto_revisions(pairs_of(spark, d), store.memories(spark, d), 0.31, 0.97, classify=longer)


_ENDED = "ended AS (SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'p' || (conv_id % 5) END AS project, min_by(text, turn) AS summary, list(text ORDER BY turn) FILTER (role = 'user') AS decisions, list(text ORDER BY turn) FILTER (role <> 'user') AS entities FROM conversations GROUP BY conv_id)"
_LOG = f"log AS (SELECT id, project, started_at, CASE WHEN id % 4 = 0 THEN {O.AS_OF} END AS ended_at FROM sessions WHERE id % 3 <> 1)"


def _ended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = store.read(spark, d, "conversations")
    said = lambda who: F.transform(F.array_sort(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda r: r["text"])
    e = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("summary"), said(F.col("role") == "user").alias("decisions"), said(F.col("role") != "user").alias("entities"))
    e = e.withColumns({"project": F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), (F.col("id") % 5).cast("string"))), "discoveries": F.lit(None).cast("array<string>")})
    log = store.sessions(spark, d).filter("id % 3 <> 1").withColumn("ended_at", F.when(F.col("id") % 4 == 0, store.as_of()))
    return e, log


@query(
    f"""WITH {O.SESSIONS}, {_ENDED}, {_LOG}, last AS (SELECT project AS p FROM log ORDER BY started_at DESC, id DESC LIMIT 1)
SELECT e.id, CASE WHEN l.id IS NOT NULL THEN l.project ELSE coalesce(e.project, (SELECT p FROM last)) END AS project, summary, l.id IS NOT NULL AS known, (coalesce(len(decisions), 0) + coalesce(len(entities), 0))::INT AS memories,
  coalesce(len(decisions), 0) + coalesce(len(entities), 0) >= 4 AND l.ended_at IS NULL AS cluster FROM ended e LEFT JOIN log l ON e.id = l.id"""
)
def session_save(spark: SparkSession, d: str) -> DataFrame:
    e, log = _ended(spark, d)
    return sessions.saved(e, log, store.as_of())[0].drop("ended_at")


@query(f"WITH {_ENDED} SELECT id AS session, (unnest(range(len(coalesce(decisions, []) || coalesce(entities, [])))))::INT AS n, unnest(list_transform(coalesce(decisions, []), lambda x: 'decision') || list_transform(coalesce(entities, []), lambda x: 'entity')) AS type, unnest(coalesce(decisions, []) || coalesce(entities, [])) AS content, 'wrap' AS meta_source FROM ended")
def session_memories(spark: SparkSession, d: str) -> DataFrame:
    return sessions.saved(*_ended(spark, d), store.as_of())[1].drop("project")


@query(
    f"""WITH {O.MEMORIES}, {O.SESSIONS} SELECT 'tools' AS strategy, 'kept' AS counter, count(*) AS n FROM memories WHERE type = 'tool' UNION ALL SELECT 'sessions', 'due', count(*) FROM sessions WHERE started_at < {O.AS_OF} - INTERVAL 30 DAY UNION ALL SELECT 'sessions', 'young', count(*) FROM sessions WHERE started_at >= {O.AS_OF} - INTERVAL 30 DAY"""
)
def consolidation_report(spark: SparkSession, d: str) -> DataFrame:
    m, s = store.memories(spark, d), store.sessions(spark, d)
    old = F.col("started_at") < store.as_of() - F.expr("interval 30 days")
    return lifecycle.consolidation({"tools": {"kept": m.filter("type = 'tool'")}, "sessions": {"due": s.filter(old), "young": s.filter(~old)}, "decay": {"weak": m}}, ("tools", "sessions"))


@query(
    """WITH locks AS (SELECT event_type AS name, 'u' || user_id AS owner, ts FROM events WHERE event_id % 50 = 0), held AS (SELECT name, arg_max(owner, struct_pack(t := ts, o := owner)) AS holder, max(ts) AS since FROM locks GROUP BY name),
asks AS (SELECT event_type || CASE WHEN event_id % 7 = 0 THEN '!' ELSE '' END AS name, 'u' || user_id AS owner, ts FROM events WHERE event_id % 20 = 3),
f AS (SELECT a.*, holder, holder IS NULL OR holder = a.owner OR epoch_us(a.ts) - epoch_us(since) >= 3600000000 AS free FROM asks a LEFT JOIN held USING (name))
SELECT name, owner, ts, free AND row_number() OVER (PARTITION BY name, free ORDER BY ts, owner) = 1 AS granted, CASE WHEN NOT free THEN holder END AS held_by FROM f"""
)
def lock_lease(spark: SparkSession, d: str) -> DataFrame:
    e = store.events(spark, d).select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner"), F.col("ts").alias("at"))
    locks = e.filter("event_id % 50 = 0").select(F.col("event_type").alias("name"), "owner", "at")
    name = F.concat("event_type", F.when(F.col("event_id") % 7 == 0, "!").otherwise(""))
    return lifecycle.lease(locks, e.filter("event_id % 20 = 3").select(name.alias("name"), "owner", "at")).withColumnRenamed("at", "ts")


_MARKED = "marked AS (SELECT substr(md5(doc_id::VARCHAR), 1, 12) AS id, substr(md5((doc_id - 1)::VARCHAR), 1, 12) AS other, doc_id FROM documents WHERE doc_id % 10 IN (1, 2, 3))"


ORACLES["marker_classify"] = f"""WITH {_MARKED}, known AS (SELECT substr(md5(doc_id::VARCHAR), 1, 12) AS id FROM documents)
SELECT id, 'p1a' AS tier, CASE doc_id % 10 WHEN 1 THEN 'passive' ELSE 'active' END AS role, CASE doc_id % 10 WHEN 1 THEN other ELSE id END AS source, CASE doc_id % 10 WHEN 1 THEN id ELSE other END AS target, 'high' AS confidence FROM marked WHERE doc_id % 10 <> 3 AND other IN (SELECT id FROM known)
UNION ALL SELECT id, 'p1b', 'passive', NULL, id, 'pending' FROM marked WHERE doc_id % 10 = 3"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    m, i = store.memories(spark, d), F.col("id")
    code = lambda c: F.substring(F.md5(c.cast("string")), 1, 12)
    said = F.when(i % 10 == 1, F.concat(F.lit("[SUPERSEDED by "), code(i - 1), F.lit("]"))).when(i % 10 == 2, F.concat(F.lit("This supersedes "), code(i - 1))).when(i % 10 == 3, "RETIRED plan").otherwise("plain")
    return m.select(code(i).alias("id"), said.alias("content"), "importance")


@query(
    f"""WITH {O.MEMORIES}, {_MARKED}, known AS (SELECT substr(md5(id::VARCHAR), 1, 12) AS id, importance FROM memories),
e AS (SELECT DISTINCT CASE doc_id % 10 WHEN 1 THEN id ELSE other END AS target FROM marked WHERE doc_id % 10 <> 3 AND other IN (SELECT id FROM known))
SELECT id, CASE WHEN id IN (SELECT target FROM e) THEN coalesce(importance, 0.5::DOUBLE) * 0.7::DOUBLE ELSE importance END AS importance, id IN (SELECT id FROM marked WHERE doc_id % 10 = 3) AS review FROM known WHERE id IN (SELECT target FROM e) OR id IN (SELECT id FROM marked WHERE doc_id % 10 = 3)"""
)
def marker_backfill(spark: SparkSession, d: str) -> DataFrame:
    m = _said(spark, d)
    return lifecycle.backfilled(m, extract.markers(m))[1]


@query(f"""WITH {O.MEMORIES}, t AS (SELECT unnest(list_distinct([lang, source])) AS tag, type, epoch({O.AS_OF}) - epoch(coalesce(last_accessed, created_at)) > 20 * 86400 AS old FROM memories) SELECT tag, type, count(*) AS n, count(*) FILTER (old) AS stale FROM t GROUP BY tag, type""")
def topic_index(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.topic_index(store.memories(spark, d), store.as_of(), 20)


@query(f"""WITH {O.MEMORIES}, {O.SCORES} SELECT strftime(created_at, '%G') || '_W' || strftime(created_at, '%V') AS week, count(*) FILTER (score > 3) AS signal, count(*) FILTER (score <= 3) AS noise, round(count(*) FILTER (score > 3) / count(*)::DOUBLE, 6) AS ratio FROM memories JOIN judge_scores ON id = memory_id GROUP BY 1""")
def signal_ratio(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.signal_ratio(store.memories(spark, d).select("id", F.col("created_at").alias("at")), store.judge_scores(spark, d))


@query("SELECT event_id AS id, '{\"a\":\"' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END || '\",\"b\":\"' || event_type || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"c\":\"' || user_id || '\"' ELSE '' END || '}' AS metadata FROM events")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    e = store.read(spark, d, "events")
    old = F.to_json(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("event_type")))
    patch = F.when(F.col("event_id") % 2 == 0, F.to_json(F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("user_id").cast("string"))))
    return e.select(F.col("event_id").alias("id"), lifecycle.merged_metadata(old, patch).alias("metadata"))


@query(f"WITH {O.MEMORIES} SELECT id, content, type, importance FROM memories WHERE id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One memory by id: the filter reaches the scan."""
    return store.memories(spark, d).filter("id = 42").select("id", "content", "type", "importance")


@query(f"WITH {O.SESSIONS} SELECT id, project, started_at FROM sessions ORDER BY started_at DESC, id DESC LIMIT 1")
def last_session(spark: SparkSession, d: str) -> DataFrame:
    return store.sessions(spark, d).orderBy(F.desc("started_at"), F.desc("id")).limit(1).select("id", "project", "started_at")


@query(f"WITH {O.RELATIONS}, n AS (SELECT source_id, target_id, 'caused_by' AS relation_type FROM relations WHERE source_id % 2 = 0 UNION ALL SELECT source_id, source_id + 1000000, 'used_by' FROM relations WHERE source_id % 5 = 0) SELECT DISTINCT * FROM n WHERE target_id IN (SELECT doc_id FROM documents) EXCEPT SELECT source_id, target_id, relation_type FROM relations")
def edge_insert(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-ignore: new edges between memories that exist."""
    r = store.relations(spark, d)
    new = r.filter("source_id % 2 = 0").select("source_id", "target_id", F.lit("caused_by").alias("relation_type"))
    new = new.unionByName(r.filter("source_id % 5 = 0").select("source_id", (F.col("source_id") + 1000000).alias("target_id"), F.lit("used_by").alias("relation_type")))
    return graph.add_edges(r, new, store.memories(spark, d))


@query("SELECT event_type AS key, CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE count(*) END AS value FROM events GROUP BY event_type UNION SELECT 'error', 0 UNION SELECT 'click', 0 UNION SELECT 'fresh', 0")
def key_upsert(spark: SparkSession, d: str) -> DataFrame:
    table = store.read(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value"))
    return lifecycle.upsert(table, spark.createDataFrame([(k, 0) for k in ("click", "error", "fresh")], "key string, value long"))


@query(f"WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=3)} SELECT id, {O.AS_OF} AS ts, 'recall' AS kind FROM near")
def access_events(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.accessed(R.knn(store.memory_vectors(spark, d), query_set(spark, d), 3), store.as_of())


@query("SELECT * FROM (SELECT path, sum(n)::BIGINT AS lines, CASE WHEN sum(n) > 250 THEN 'SEVERE' ELSE 'WARNING' END AS level FROM (SELECT source || '/' || (doc_id % 10) AS path, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY path) WHERE lines > 200")
def size_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The lines of ten files a source, each the texts of a tenth of its documents."""
    path = F.concat("source", F.lit("/"), (F.col("doc_id") % 10).cast("string"))
    lines = store.read(spark, d, "documents").select(path.alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    return sessions.size_warnings(lines)


@query("WITH c AS (SELECT 'p' || (user_id % 40) AS project, max(ts) FILTER (event_type <> 'error') AS newest FROM events GROUP BY 1), s AS (SELECT DISTINCT 'p' || (user_id % 50) AS project, TIMESTAMP '2024-01-15 00:00:00' AS updated FROM events) SELECT project, updated, newest, coalesce(newest > updated, false) AS stale FROM s LEFT JOIN c USING (project)")
def status_freshness(spark: SparkSession, d: str) -> DataFrame:
    e = store.events(spark, d)
    commits = e.select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("project"), F.concat("event_type", F.lit("/file")).alias("path"), F.col("ts").alias("date"))
    status = e.select(F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("project"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("updated")).distinct()
    return sessions.freshness(status, commits, ["error/"])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE nullif(trim(text), '') END AS own FROM conversations")
def user_words(spark: SparkSession, d: str) -> DataFrame:
    c = store.read(spark, d, "conversations")
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<wrapped>"), "text")).when(F.col("turn") % 3 == 2, F.concat("text", F.lit("<system-reminder>more"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.user_text(said, ["<wrapped>"]).alias("own"))


@query("SELECT doc_id AS id, 'fact' AS category, (doc_id % 10) / 10.0::DOUBLE AS confidence, trim(string_split(text, chr(10))[1]) AS content FROM documents WHERE doc_id % 3 = 0 AND trim(string_split(text, chr(10))[1]) <> ''")
def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d)
    head = F.get(F.split("content", "\n"), F.lit(0))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("thinking...\nFACT: fact | "), (F.col("id") % 10).cast("string"), F.lit(" | "), head)).otherwise(F.concat(F.lit("FACT: broken | "), F.translate(head, "|", "")))
    return m.select("id", F.explode(T.facts(text)).alias("f")).select("id", "f.*")


@query("SELECT event_id, 'src' || (user_id % 9) AS project, '/home/Projects/src' || (user_id % 9) || '/a.py,/tmp/b' AS paths FROM events")
def tool_paths(spark: SparkSession, d: str) -> DataFrame:
    e = store.read(spark, d, "events")
    path = F.concat(F.lit("/home/Projects/src"), (F.col("user_id") % 9).cast("string"), F.lit("/a.py"))
    given = F.concat(F.lit('{"file_path": "'), path, F.lit('", "x": 1, "path":"/tmp/b", "path": "/tmp/b"}'))
    return e.select("event_id", T.project_of(path).alias("project"), F.array_join(T.file_paths(given), ",").alias("paths"))


@query("WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(text), '\\s+') AS ws FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i AND length(w) >= 3 AND regexp_matches(w, '^[\\p{L}\\p{N}]+$')), ' ') AS words FROM w")
def context_words(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.context_words(F.col("text")), " ").alias("words"))


@query(f"WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=6)}, l AS (SELECT query_id, vec_pos, id || ': ' || repeat('x', (40 * (id % 30))::INT) AS line FROM near), t AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY vec_pos) AS total FROM l) SELECT query_id, string_agg(line, chr(10) ORDER BY vec_pos) AS context FROM t WHERE total <= 2000 GROUP BY query_id")
def rendered_context(spark: SparkSession, d: str) -> DataFrame:
    near = R.knn(store.memory_vectors(spark, d), query_set(spark, d), 6)
    line = F.concat(F.col("id").cast("string"), F.lit(": "), F.repeat(F.lit("x"), (40 * (F.col("id") % 30)).cast("int")))
    return sinks.rendered(near.withColumn("line", line), 2000, order="vec_pos")


@query("WITH s AS (SELECT conv_id, turn, role, text FROM conversations), p AS (SELECT conv_id, role, list(text ORDER BY turn)[1:2] AS items FROM s GROUP BY conv_id, role), b AS (SELECT conv_id, role, '## ' || role || chr(10) || array_to_string(list_transform(items, lambda i: '- ' || i), chr(10)) AS body FROM p), t AS (SELECT *, sum(length(body) + 2) OVER (PARTITION BY conv_id ORDER BY role) AS total FROM b) SELECT conv_id AS session, string_agg(body, chr(10) || chr(10) ORDER BY role) AS snapshot FROM t WHERE total <= 3200 GROUP BY conv_id")
def section_snapshot(spark: SparkSession, d: str) -> DataFrame:
    c = store.read(spark, d, "conversations")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    parts = c.groupBy(F.col("conv_id").alias("session"), "role").agg(items.alias("items")).withColumns({"rank": F.col("role"), "title": F.col("role")})
    return extract.snapshot(parts, each=2)


_WORDS = "['alpha' || translate((conv_id * 1000 + turn)::VARCHAR, '0123456789', 'abcdefghij'), 'kilo' || chr((97 + turn % 3)::INT), 'lima' || chr((97 + turn % 4)::INT), 'mike' || chr((97 + turn % 5)::INT), 'quebec' || chr((97 + conv_id % 26)::INT)]"


@query(
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 10 = 0 THEN [] ELSE {_WORDS} END AS w FROM conversations), s AS (SELECT conv_id, turn, list_concat(w, ['romeo', 'sierra', 'tango', 'uniform', 'victor', 'whiskey', 'xray', 'yankee']) AS w FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations) WHERE turn % 9 = 4)
SELECT conv_id, turn FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND (abs(s.turn - c.turn) <= 1 OR len(c.w) = 0 OR len(list_intersect(s.w, c.w)) > 0.5 * len(c.w) OR len(list_intersect(s.w, c.w)) > 0.5 * len(s.w)))"""
)
def unsaved_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals that no save covers: by place, by over half of either side's words, or for want of words."""
    c = store.read(spark, d, "conversations")
    letter = lambda x: F.char(F.lit(97) + x)
    alone = F.concat(F.lit("alpha"), F.translate((F.col("conv_id") * 1000 + F.col("turn")).cast("string"), "0123456789", "abcdefghij"))
    words = F.concat_ws(" ", alone, *[F.concat(F.lit(w), letter(x)) for w, x in (("kilo", F.col("turn") % 3), ("lima", F.col("turn") % 4), ("mike", F.col("turn") % 5), ("quebec", F.col("conv_id") % 26))])
    signals = c.select("conv_id", F.col("turn").alias("line"), F.when(F.col("turn") % 10 != 0, words).otherwise("1 2 3").alias("match_text"))
    saves = c.filter("turn % 9 = 4").select("conv_id", F.col("turn").alias("line"), F.concat_ws(" ", words, F.lit("romeo sierra tango uniform victor whiskey xray yankee")).alias("content"))
    return extract.unsaved(signals, saves, near=1, share=0.5, key="conv_id").select("conv_id", F.col("line").alias("turn"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, (event_id % 40)::BIGINT AS item, (100 + event_id * 37 % 900)::BIGINT AS size, event_type = 'error' AS reset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR, true) AS apart FROM events),
step(user_id, n, event_id, ids, total, shown) AS (SELECT user_id, n, event_id, CASE WHEN reset THEN []::BIGINT[] ELSE [item] END, CASE WHEN reset THEN 0 ELSE size END, NOT reset FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN ok THEN list_append(ids, item) ELSE ids END, CASE WHEN ok THEN total + size ELSE total END, ok FROM (SELECT *, NOT reset AND NOT list_contains(ids, item) AND total + size <= 3000 AS ok
    FROM (SELECT e.user_id, e.n, e.event_id, e.item, e.size, e.reset, CASE WHEN e.reset OR e.apart THEN []::BIGINT[] ELSE s.ids END AS ids, CASE WHEN e.reset OR e.apart THEN 0 ELSE s.total END AS total FROM step s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT event_id, shown, total FROM step"""
)
def session_caps(spark: SparkSession, d: str) -> DataFrame:
    """What a session shows: each item once, 3000 characters in all, anew after two idle hours or a reset."""
    e = store.events(spark, d).withColumns({"item": F.col("event_id") % 40, "size": 100 + F.col("event_id") * 37 % 900})
    return state.capped(e, "user_id", "item", "size", reset=F.col("event_type") == "error")


@query("WITH e AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT event_id, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS since FROM e")
def since_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user since the last reset."""
    return state.counted_since(store.events(spark, d), "user_id", F.col("event_type") == "error")


@query("SELECT doc_id, length(text)::BIGINT AS value, md5(text) IN (SELECT DISTINCT md5(text) FROM documents WHERE doc_id % 2 = 0 ORDER BY 1 LIMIT 300) AS hit FROM documents")
def scorer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Every text scored behind a cache of 300 that the even rows have filled: known texts are hits, others are scored once."""
    cached = cache.ScorerCache(CommitLog(spark, folder(spark)), "long", 300)
    docs = store.read(spark, d, "documents").select("doc_id", "text", F.md5("text").alias("key"))
    score = lambda df: df.select("key", F.length("text").cast("long").alias("value"))
    cached.call(docs.filter("doc_id % 2 = 0"), score, store.as_of())
    return cached.call(docs, score, store.as_of() + F.expr("interval 1 day")).select("doc_id", "value", "hit")


# --- oracles of queries registered above -----------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    return _quoted(pattern.replace("(?iu)", "(?i)"))


def _gate() -> str:
    """The skip gate's decision list over (conv_id, turn, p, vote): the struct (skip, reason)."""
    out = lambda skip, reason: f"struct_pack(skip := {str(skip).lower()}, reason := {reason})"
    first = "CASE " + " ".join(f"WHEN regexp_matches(p, {_re2(r)}) THEN {_quoted(n)}" for n, r in T.TENTATIVE) + " END"
    bare = "regexp_replace(w, '^[.,!]+|[.,!]+$', '', 'g')"
    code = f"len(list_filter(ws, lambda w: contains(w, '/') OR contains(w, '_') OR contains(w, '::') OR contains(w, '()') OR (contains({bare}, '.') AND NOT regexp_full_match(replace({bare}, '.', ''), '\\d+')))) > 0"
    cases = [("length(p) < 10", out(True, "'too_short'")), ("length(p) > 5000", out(False, "'long_prompt'"))]
    cases += [(f"regexp_matches(p, {_re2(r)})", out(True, _quoted(f"confident:{n}"))) for n, r in T.CONFIDENT]
    cases += [(f"len(ws) <= 4 AND NOT contains(p, '?') AND NOT ({code})", out(True, "'trivial_short'")), ("len(ws) > 8", out(False, "'substantive_length'"))]
    cases += [(f"contains(' ' || lower(p) || ' ', ' {m} ') OR starts_with(lower(p), '{m} ')", out(False, _quoted(f"contrast:{m}"))) for m in T.CONTRAST]
    cases += [("vote IS NULL AND f IS NOT NULL", out(True, "'pattern:' || f || '|llm_fail'")), ("vote IS NULL", out(False, "'default_include|llm_fail'")), ("f IS NOT NULL AND vote = 'skip'", out(True, "'agree_skip:' || f")), ("f IS NULL AND vote = 'include'", out(False, "'agree_include'")), ("f IS NOT NULL", out(False, "'llm_rescue:' || f"))]
    listed = " ".join(f"WHEN {c} THEN {v}" for c, v in cases)
    return f"""SELECT conv_id, turn, g.skip AS skip, g.reason AS reason FROM (SELECT conv_id, turn, CASE {listed} ELSE {out(False, "'llm_skip_ignored'")} END AS g FROM (SELECT *, {first} AS f, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '') AS ws
FROM (SELECT conv_id, turn, trim(text) AS p, CASE turn % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'include' END AS vote FROM conversations WHERE role = 'user')))"""


ORACLES["skip_gate"] = _gate()
ORACLES["skip_report"] = f"SELECT reason, count(*) AS n, any_value(skip) AS skip FROM ({_gate()}) GROUP BY reason ORDER BY n DESC, reason LIMIT 20"
_LIST = lambda words: "[" + ", ".join(map(_quoted, words)) + "]"
_TRIM = "[,.!?;:''\"()\\[\\]{}]+"
ORACLES["emotional"] = f"""SELECT id, len(list_filter({_LIST(["met moi", "tam ly", "cam xuc", "lo lang", "dau long", "on dinh lai", "dam tang", "dam cuoi"])}, lambda p: contains(replace(strip_accents(lower(x)), 'đ', 'd'), p))) > 0
  OR list_has_any(list_transform(regexp_split_to_array(lower(x), '\\s+'), lambda w: regexp_replace(w, '^{_TRIM}|{_TRIM}$', '', 'g')), {_LIST(T.EMOTIONAL_WORDS)}) AS emotional
FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Hôm nay mệt mỏi. ' WHEN 1 THEN 'So anxious! ' ELSE '' END || text AS x FROM documents)"""
ORACLES["saveable"] = f"""SELECT id, substr(hits[1], 1, 120) AS excerpt FROM (SELECT id, x, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: length(l) >= 60 AND (regexp_matches(l, {_quoted("(?i)" + "|".join(T.DECISION_PHRASES))}) OR regexp_matches(l, {_quoted("|".join(T.TECHNICAL_PATTERNS))}))) AS hits
FROM (SELECT doc_id AS id, ['We decided on the second plan, and this is why it was chosen: ', 'Now at v2.10.3 after a long week of work on all of the parts: ', 'Nothing much to report here today, all is as it was before: '][doc_id % 3 + 1] || text AS x FROM documents)) WHERE length(x) >= 200 AND len(hits) > 0"""
_CLEAN = "regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g')"
ORACLES["entities"] = f"""WITH c AS (SELECT doc_id AS id, lower({_CLEAN}) AS low, list_transform(regexp_extract_all(text, '(?i)/Projects/(\\w[\\w-]*)', 1), lambda p: lower(p)) AS paths FROM documents)
SELECT id, 'atlas' AS name, 'project' AS category FROM c WHERE list_contains(paths, 'atlas') OR contains(low, 'atlas') UNION ALL SELECT id, 'data-lake', 'project' FROM c WHERE list_contains(paths, 'data-lake') OR contains(low, 'data lake') OR contains(low, 'data-lake')
UNION ALL SELECT id, '/' || s, 'skill' FROM c, (VALUES ('research'), ('ship')) v(s) WHERE regexp_matches(low, '(^|\\W)/' || s || '($|\\W)') UNION ALL SELECT id, t, 'technology' FROM c, (VALUES ('sqlite'), ('and')) v(t) WHERE contains(low, t)"""

ORACLES["judge_cache_key"] = f"WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=5)} SELECT query_id, md5(any_value(query) || chr(0) || array_to_string(list_sort(list(id::VARCHAR)), ',')) AS h FROM near JOIN queries USING (query_id) GROUP BY query_id"


def _kinds() -> str:
    lead = "['It turns out that this holds. ', 'The build failed with exit code 2. ', 'Next step: we need to update the index. ', ''][turn % 4 + 1]"
    parts = []
    for group, kinds in extract.GROUPS.items():
        case = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(x, {_quoted('(?i)' + extract.SIGNALS[k])}) THEN {what(k)}" for k in kinds) + " END"  # noqa: B023, E731
        keyword = lambda k: f"regexp_extract(x, {_quoted('(?i)' + extract.SIGNALS[k])}, 0)"
        parts.append(f"SELECT '{group}' AS section, conv_id, turn AS line, {case(_quoted)} AS kind, {case(keyword)} AS keyword, x FROM said")
    return f"WITH said AS (SELECT conv_id, turn, {lead} || text AS x FROM conversations) SELECT section, conv_id, line, kind, keyword, substr(x, greatest(strpos(x, keyword) - 200, 1)::INT, strpos(x, keyword) - greatest(strpos(x, keyword) - 200, 1) + length(keyword) + 200) AS match_text FROM (" + " UNION ALL ".join(parts) + ") WHERE kind IS NOT NULL"


@query(_kinds())
def signal_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each line's first signal of every group: its kind and the words that show it."""
    lead = F.get(F.array(*[F.lit(x) for x in ("It turns out that this holds. ", "The build failed with exit code 2. ", "Next step: we need to update the index. ", "")]), (F.col("turn") % 4).cast("int"))
    c = store.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("line"), F.concat(lead, "text").alias("text"))
    found = [extract.signals(c, g).select(F.lit(g).alias("section"), "conv_id", "line", "kind", "keyword", "match_text") for g in extract.GROUPS]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
