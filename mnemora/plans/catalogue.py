"""The engine's query catalogue: each entry is a query over the driver's tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.deploy import ship
from mnemora.functions import scoring as S
from mnemora.functions import telex
from mnemora.functions import text as T
from mnemora.operators import beliefs, extract, fts, graph, lifecycle, sessions, textindex, vectors
from mnemora.operators import recall as R
from mnemora.plans import oracle as O
from mnemora.sources import store
from mnemora.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark items as queries, each with a stored vector."""
    b, e = store.read(spark, d, "benchmark"), store.read(spark, d, "embeddings")
    b = b.join(e, b["item_id"] == e["vec_id"])
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").cast("array<double>").alias("vec"))


def tables(spark: SparkSession, d: str):
    return store.memories(spark, d), store.memory_vectors(spark, d), store.relations(spark, d), query_set(spark, d)


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(store.memory_vectors(spark, d), 0.3)


def folder(spark: SparkSession) -> str:
    """Where iterative operators write their rounds: the cluster's shared folder, else, on a local master, a temporary one."""
    import atexit
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="mnemora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/mnemora-graph-{uuid.uuid4().hex[:12]}"


_INDEXES: dict[tuple, textindex.TextIndex] = {}


def index_of(spark: SparkSession, d: str) -> textindex.TextIndex:
    """The stored index of a folder's memories, written once a session and version of its files."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = (spark.sparkContext.applicationId, d, *sorted(docs.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = textindex.indexed(spark, folder(spark), store.memories(spark, d).select("id", fts.indexed_text().alias("text")))
    return _INDEXES[key]


# --- recall ---------------------------------------------------------------


@query(O.recall())
def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.recall(*tables(spark, d), k=5, index=index_of(spark, d))


@query(f"WITH {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.QUERIES}, {O.LIVE}, {O.near()} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS pos, id, s AS score FROM (SELECT query_id, n.id, round(1::DOUBLE / (60 + vec_pos) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(importance, 0.5::DOUBLE)), 9) AS s FROM near n JOIN live l ON n.id = l.id) QUALIFY pos <= 5")
def recall_vector_only(spark: SparkSession, d: str) -> DataFrame:
    m, v, r, q = tables(spark, d)
    return R.recall(m, v, r, q.withColumn("query", F.lit("?!")), k=5).select("query_id", "pos", "id", "score")


@query(O.recall(where="(project = 'src3' OR project IS NULL)"))
def recall_scoped(spark: SparkSession, d: str) -> DataFrame:
    return R.recall(*tables(spark, d), k=5, project="src3", index=index_of(spark, d))


@query(O.recall(where=f"type = 'decision' AND created_at >= {O.AS_OF} - INTERVAL 60 DAY"))
def recall_time_range(spark: SparkSession, d: str) -> DataFrame:
    return R.recall(*tables(spark, d), k=5, kind="decision", since=store.as_of() - F.expr("interval 60 days"), index=index_of(spark, d))


_HOOK_POOL = f"{O.LIVE}, pool AS (SELECT * FROM live WHERE (project = 'src3' OR project IS NULL) AND type NOT IN ('tool', 'session') AND coalesce(importance, 0.5::DOUBLE) >= 0.3::DOUBLE)"
_ANY = "list_filter(list_transform(regexp_split_to_array(query, '\\s+'), lambda t: trim(t, ',.!?;:''\"()[]{}')), lambda t: length(t) > 2 AND regexp_matches(t, '^[\\p{L}\\p{N}]+$'))[1:8]"


@query(
    f"""WITH {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.QUERIES}, {_HOOK_POOL},
toks AS (SELECT id, {O.tokens(O.INDEXED)} AS toks FROM pool), q_terms AS (SELECT query_id, list_distinct(flatten(list_transform({_ANY}, lambda p: {O.tokens("p")}))) AS terms FROM queries),
post AS (SELECT id, len(toks) AS len, unnest(toks) AS term FROM toks), tf AS (SELECT id, len, term, count(*) AS tf FROM post GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS n_docs, avg(len(toks)) AS mean_len FROM toks),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean_len))), 6) AS score FROM (SELECT query_id, unnest(terms) AS term FROM q_terms) JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY query_id, id),
f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS f FROM bm QUALIFY f < 20),
pv AS (SELECT v.* FROM vectors v SEMI JOIN pool p ON v.memory_id = p.id), {O.near("pv")},
b AS (SELECT coalesce(f.query_id, n.query_id) AS query_id, coalesce(f.id, n.id) AS id, f, vec_pos - 1 AS v FROM f FULL JOIN near n ON f.query_id = n.query_id AND f.id = n.id),
s AS (SELECT query_id, b.id, p.type, coalesce(importance, 0.5::DOUBLE) AS imp, round((coalesce(1::DOUBLE / (60 + f), 0) + coalesce(1::DOUBLE / (60 + v), 0)) * (0.7::DOUBLE + 0.3::DOUBLE * coalesce(importance, 0.5::DOUBLE)) - 0.001::DOUBLE * CASE p.type WHEN 'entity' THEN 1 WHEN 'session' THEN 2 WHEN 'tool' THEN 2 ELSE 0 END + CASE WHEN created_at::DATE = {O.AS_OF}::DATE THEN 0.005::DOUBLE ELSE 0 END, 9) AS score FROM b JOIN pool p ON b.id = p.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, imp DESC, id)::INT AS pos, id, type, score FROM s QUALIFY pos <= 8"""
)
def hook_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.hook_rank(*tables(spark, d), store.as_of(), project="src3", index=index_of(spark, d))


@query(
    f"""WITH {O.MEMORIES}, {O.VECTORS}, {O.QUERIES}, tv AS (SELECT v.* FROM vectors v JOIN memories m ON v.memory_id = m.id WHERE type = 'tool' AND (project = 'src3' OR project IS NULL)), {O.near("tv", 10)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_pos)::INT AS pos, id, sim FROM near WHERE sim >= 0.1 QUALIFY pos <= 3"""
)
def tool_search(spark: SparkSession, d: str) -> DataFrame:
    m, v, _, q = tables(spark, d)
    return R.find_tools(m, v, q, project="src3", floor=0.1)


_TOOL_WORDS = "list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3)[1:8]"


@query(f"SELECT item_id, array_to_string({_TOOL_WORDS}, ' OR ') AS query FROM benchmark")
def tool_fts_fallback(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "benchmark").select("item_id", F.array_join(T.tool_words(F.col("text")), " OR ").alias("query"))


# --- full text ------------------------------------------------------------


@query(f"WITH {O.MEMORIES}, {O.QUERIES}, {O.TEXT} SELECT query_id, id FROM all_of")
def fts_and_match(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).match_all(query_set(spark, d)).select("query_id", "id")


@query(f"WITH {O.MEMORIES}, {O.QUERIES}, {O.TEXT} SELECT query_id, id, hits FROM bm")
def fts_or_match(spark: SparkSession, d: str) -> DataFrame:
    q = query_set(spark, d).select("query_id", F.flatten(F.transform(T.query_phrases(F.col("query")), T.tokens)).alias("terms"))
    return index_of(spark, d).bm25(q).select("query_id", "id", "hits")


@query(f"WITH {O.MEMORIES}, {O.QUERIES}, {O.TEXT} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS fts_pos FROM bm QUALIFY fts_pos <= 20")
def fts_any_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best 20 by any term, stripes whose bound misses the bar being left unread."""
    return R.text_leg(store.memories(spark, d), query_set(spark, d), "any", index=index_of(spark, d))


_EDITED = f"{O.MEMORIES.replace('m0 AS (SELECT doc_id AS id, text AS content', 'm0 AS (SELECT doc_id AS id, CASE WHEN doc_id % 100 = 7 THEN {text} ELSE text END AS content').replace('FROM documents)', 'FROM documents WHERE doc_id % 100 <> 9)')}"


@query(f"WITH {_EDITED.replace('{text}', 'substr(text, 1, length(text) // 2)')}, {O.QUERIES}, {O.TEXT} SELECT query_id, id, score, hits FROM bm")
def fts_after_updates(spark: SparkSession, d: str) -> DataFrame:
    """Scores after one commit that changes some texts and one that deletes some: an index of its own, updated in place."""
    m = store.memories(spark, d)
    text = fts.indexed_text().alias("text")
    index = textindex.indexed(spark, folder(spark), m.select("id", text))
    changed = m.filter("id % 100 = 7")
    halved = changed.withColumn("content", F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int")))
    with index.log.commit() as c:
        index.write(c, halved.select("id", text), changed.select("id", text))
    with index.log.commit() as c:
        index.write(c, None, m.filter("id % 100 = 9").select("id", text))
    q = query_set(spark, d).select("query_id", F.flatten(F.transform(T.query_phrases(F.col("query")), T.tokens)).alias("terms"))
    return index.bm25(q)


@query(f"WITH {O.MEMORIES}, {O.QUERIES}, {O.TEXT}, {O.LEGS} SELECT query_id, id, fts_pos::INT AS fts_pos FROM texts")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.text_leg(store.memories(spark, d), query_set(spark, d), index=index_of(spark, d)).select("query_id", "id", "fts_pos")


@query("SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))[1:16], lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' ') AS match FROM benchmark")
def fts_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "benchmark").select("item_id", T.quoted(F.col("text")).alias("match"))


# --- vectors --------------------------------------------------------------


@query(f"WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=5)} SELECT query_id, id, sim, vec_pos::INT AS vec_pos FROM near")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.knn(store.memory_vectors(spark, d), query_set(spark, d), 5)


@query(f"WITH {O.VECTORS}, {O.PAIRS} SELECT a, b, sim FROM pairs")
def cosine_pairs_band(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(spark, d)


@query(f"WITH {O.VECTORS}, q AS (SELECT embedding AS q FROM vectors WHERE memory_id = 0) SELECT memory_id, round(1 - list_distance(embedding, q) ** 2 / 2, 4) AS cosine FROM vectors, q")
def l2_to_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = store.memory_vectors(spark, d)
    q = F.array(*[F.lit(x) for x in v.filter("memory_id = 0").first()["embedding"]])
    diff = F.zip_with("embedding", q, lambda a, b: a - b)
    return v.select("memory_id", F.round(vectors.cosine_of_distance(vectors.norm(diff)), 4).alias("cosine"))


_DEDUP = f"""WITH RECURSIVE {O.VECTORS}, {O.QUERIES}, {O.near(k=12)},
close AS (SELECT n.query_id, n.id, n.vec_pos, list(o.id) FILTER (o.vec_pos < n.vec_pos AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3) AS close FROM near n JOIN near o ON o.query_id = n.query_id JOIN vectors a ON a.memory_id = n.id JOIN vectors b ON b.memory_id = o.id GROUP BY n.query_id, n.id, n.vec_pos),
step(query_id, pos, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM near UNION ALL SELECT s.query_id, c.vec_pos, CASE WHEN list_has_any(s.kept, coalesce(c.close, [])) THEN s.kept ELSE list_append(s.kept, c.id) END FROM step s JOIN close c ON c.query_id = s.query_id AND c.vec_pos = s.pos + 1),
pool AS (SELECT n.query_id, n.id, n.vec_pos::INT AS pos FROM near n JOIN (SELECT query_id, arg_max(kept, pos) AS kept FROM step GROUP BY query_id) k ON k.query_id = n.query_id WHERE list_contains(k.kept, n.id))"""


@query(f"{_DEDUP} SELECT query_id, id, pos FROM pool")
def pool_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression within each query's pool; the oracle goes through each pool in order."""
    v = store.memory_vectors(spark, d)
    pool = R.knn(v, query_set(spark, d), 12).join(v.withColumnRenamed("memory_id", "id"), "id")
    return vectors.keep_distinct(pool.select("query_id", "id", F.col("vec_pos").alias("pos"), "embedding"), 0.3)


@query(f"{_DEDUP} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS n FROM pool WHERE pos > 3 QUALIFY n <= 3")
def section_filter(spark: SparkSession, d: str) -> DataFrame:
    """A section's candidates that are close to nothing shown before them."""
    kept = pool_dedup(spark, d)
    return kept.filter("pos > 3").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter("n <= 3").select("query_id", "id", "n")


_TOP = "dirs AS (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs), top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS pos FROM dirs QUALIFY pos <= {k})"
_BOTH = "sided AS (SELECT t.*, ma.type AS type_a, mb.type AS type_b, ma.project AS project_a, mb.project AS project_b, ma.content AS content_a, mb.content AS content_b, ma.created_at AS created_at_a, mb.created_at AS created_at_b FROM {t} t JOIN memories ma ON t.a = ma.id JOIN memories mb ON t.b = mb.id)"
_COMPATIBLE = "(project_a IS NULL OR project_b IS NULL OR project_a = project_b)"


@query(f"WITH {O.MEMORIES}, {O.VECTORS}, {O.PAIRS}, {_TOP.format(k=6)}, {_BOTH.format(t='top')} SELECT a AS id, arg_max(b, struct_pack(s := sim, o := -b)) AS matched, round(max(sim), 3) AS sim FROM sided WHERE b < a AND type_a = type_b AND {_COMPATIBLE} AND sim >= 0.32 GROUP BY a")
def near_dup_guard(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.near_duplicates(pairs_of(spark, d), store.memories(spark, d), 0.32)


@query(f"WITH {O.VECTORS}, {O.PAIRS}, {_TOP.format(k=3)} SELECT a AS id, count(*) AS close FROM top WHERE sim >= 0.35 GROUP BY a")
def capture_filter(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_neighbours(pairs_of(spark, d), 3).filter("sim >= 0.35").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("close"))


# --- beliefs --------------------------------------------------------------

_SERIES = "'(?i)EXECUTED|GREEN|ADR-?\\d+|Tier ?\\d|\\bP-?\\d|P\\dc|LANDED|milestone|\\bGUT\\b|✅'"
_CONFLICT = f"cp AS (SELECT a, b, max(via) AS via FROM (SELECT a, b, 'similarity' AS via FROM sided WHERE type_a = type_b AND {_COMPATIBLE} AND NOT (regexp_matches(content_a, {_SERIES}) AND regexp_matches(content_b, {_SERIES})) UNION ALL SELECT least(source_id, target_id), greatest(source_id, target_id), 'edge' FROM relations WHERE relation_type IN ('contradicts', 'supersedes')) GROUP BY a, b)"
_CONFLICT_CTE = f"{O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.PAIRS}, {_BOTH.format(t='pairs')}, {_CONFLICT}"


@query(f"WITH {_CONFLICT_CTE} SELECT a, b, via FROM cp")
def conflict_edges(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.conflict_pairs(pairs_of(spark, d), store.memories(spark, d), store.relations(spark, d), 0.3, 0.985)


_CC = "e AS (SELECT a, b FROM {p} UNION SELECT b, a FROM {p}), reach(node, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON reach.node = e.a), cc AS (SELECT node AS id, min(c) AS component FROM reach GROUP BY node)"


@query(
    f"""WITH RECURSIVE {O.MEMORIES}, {O.VECTORS}, {O.PAIRS}, cp AS (SELECT a, b FROM pairs WHERE sim >= 0.4), {_CC.format(p="cp")},
n AS (SELECT component, arg_max(cc.id, struct_pack(t := created_at, o := -cc.id)) AS newest, max(created_at) AS newest_at FROM cc JOIN memories m ON cc.id = m.id GROUP BY component)
SELECT cc.id, CASE WHEN cc.id = newest THEN 'current' ELSE 'superseded_candidate' END AS role, CASE WHEN cc.id <> newest THEN newest END AS vs,
  CASE WHEN cc.id <> newest THEN CASE WHEN newest_at - created_at >= INTERVAL 1 DAY THEN date_diff('day', created_at, newest_at) || 'd ago' ELSE 'earlier' END END AS age FROM cc JOIN n USING (component) JOIN memories m ON cc.id = m.id"""
)
def conflict_flags(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.conflict_flags(vectors.linking_pairs(store.memory_vectors(spark, d), 0.4), store.memories(spark, d), folder(spark))


@query(
    f"""WITH RECURSIVE {O.MEMORIES}, {O.VECTORS}, {O.PAIRS}, {_BOTH.format(t="pairs")}, cp AS (SELECT a, b FROM sided WHERE sim >= 0.33 AND type_a = type_b AND type_a <> 'tool'), {_CC.format(p="cp")},
w AS (SELECT component, arg_max(cc.id, struct_pack(n := access_count, t := created_at, o := -cc.id)) AS winner, list_sort(list_distinct(flatten(list([lang, source])))) AS tags FROM cc JOIN memories m ON cc.id = m.id GROUP BY component)
SELECT winner, id AS loser, array_to_string(tags, ',') AS tags FROM cc JOIN w USING (component) WHERE id <> winner"""
)
def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.merged_vectors(store.memory_vectors(spark, d), store.memories(spark, d), 0.33, folder(spark)).select("winner", "loser", F.array_join("tags", ",").alias("tags"))


@query(
    f"""WITH {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.PAIRS}, l AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM relations), op AS (SELECT p.* FROM pairs p ANTI JOIN l USING (a, b)), {_BOTH.format(t="op")},
x AS (SELECT *, (created_at_a, a) > (created_at_b, b) AS f FROM sided WHERE sim <= 0.97 AND type_a = type_b AND {_COMPATIBLE} AND type_a NOT IN ('tool', 'preference', 'session'))
SELECT CASE WHEN f THEN a ELSE b END AS newer, CASE WHEN f THEN b ELSE a END AS older, sim FROM x ORDER BY CASE WHEN f THEN created_at_a ELSE created_at_b END DESC, newer, older LIMIT 40"""
)
def supersede_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The pass with a classifier that says yes to every pair, so that order and cap show."""
    yes = lambda a, b: F.struct(F.lit("contradicts").alias("verdict"), F.lit(1.0).alias("confidence"))
    return beliefs.supersede_candidates(pairs_of(spark, d), store.memories(spark, d), store.relations(spark, d), 0.3, 0.97, classify=yes).select("newer", "older", "sim")


@query(
    f"""WITH RECURSIVE {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.PAIRS}, {_TOP.format(k=50)},
ends AS (SELECT source_id AS id FROM relations WHERE relation_type = 'part_of' UNION SELECT target_id FROM relations WHERE relation_type = 'part_of'),
pool AS (SELECT * FROM memories WHERE type NOT IN ('tool', 'preference', 'session') AND created_at < {O.AS_OF} - INTERVAL 7 DAY AND coalesce(meta_source, '') <> 'consolidation' AND id NOT IN (SELECT id FROM ends)),
star AS (SELECT a.type, a.created_at, t.a AS seed, list(t.b) AS near FROM top t JOIN pool a ON t.a = a.id JOIN pool b ON t.b = b.id WHERE a.type = b.type AND t.sim >= 0.3 GROUP BY a.type, a.created_at, t.a),
line AS (SELECT *, row_number() OVER (ORDER BY created_at, seed) AS n FROM star),
step(n, used, seed, got) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT[] UNION ALL
  SELECT l.next, CASE WHEN take THEN list_concat(used, list_append(free, l.seed)) ELSE used END, CASE WHEN take THEN l.seed END, CASE WHEN take THEN list_append(free, l.seed) END
  FROM (SELECT s.n, s.used, l.seed, l.n AS next, list_filter(l.near, lambda x: NOT list_contains(s.used, x)) AS free, NOT list_contains(s.used, l.seed) AND len(list_filter(l.near, lambda x: NOT list_contains(s.used, x))) >= 2 AS take FROM step s JOIN line l ON l.n = s.n + 1) l),
best AS (SELECT l.type, l.created_at, s.seed, s.got FROM step s JOIN line l ON l.seed = s.seed ORDER BY l.type, l.created_at, s.seed LIMIT 3)
SELECT NULL::VARCHAR AS project, type, seed, unnest(got) AS member FROM best"""
)
def cluster_groups(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of one project that holds all memories; the oracle goes through the seeds in order."""
    m = store.memories(spark, d).withColumn("project", F.lit(None).cast("string"))
    return beliefs.clusters(pairs_of(spark, d), m, store.relations(spark, d), store.as_of(), 0.3, folder(spark), k=50)


@query(
    f"""WITH {O.RELATIONS}, {O.VECTORS}, {O.PAIRS}, k AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, list(DISTINCT relation_type) AS kinds FROM relations GROUP BY 1, 2)
SELECT cutoff, count(*) AS pairs, count(*) FILTER (kinds IS NULL) AS unlinked, count(*) FILTER (coalesce(list_contains(kinds, 'supersedes'), false)) AS superseding, count(*) FILTER (kinds IS NOT NULL) AS linked
FROM (SELECT unnest([0.3, 0.32, 0.34, 0.36, 0.38, 0.4]::DOUBLE[]) AS cutoff) c JOIN (pairs p LEFT JOIN k USING (a, b)) ON sim >= cutoff GROUP BY cutoff"""
)
def audit_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.audit(pairs_of(spark, d), store.relations(spark, d), [0.3, 0.32, 0.34, 0.36, 0.38, 0.4])


@query(
    f"""WITH {O.MEMORIES}, {O.RELATIONS}, {O.VECTORS}, {O.PAIRS}, {_TOP.format(k=8)}, {_BOTH.format(t="top")}
SELECT a AS id, arg_max(b, struct_pack(s := sim, o := -b)) AS sibling, max(sim) AS sim, count(*) AS in_band FROM sided WHERE b NOT IN (SELECT target_id FROM relations WHERE relation_type = 'supersedes') AND project_a IS NOT DISTINCT FROM project_b AND created_at_b > created_at_a AND sim >= 0.3 GROUP BY a"""
)
def newer_sibling(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.newer_sibling(pairs_of(spark, d), store.memories(spark, d), store.relations(spark, d), 0.3)


@query(
    f"""WITH RECURSIVE {O.MEMORIES}, {O.VECTORS}, {O.PAIRS}, {_BOTH.format(t="pairs").replace("ma.project AS", "CASE WHEN ma.project = 'src1' THEN 'src2' ELSE ma.project END AS").replace("mb.project AS", "CASE WHEN mb.project = 'src1' THEN 'src2' ELSE mb.project END AS")},
cp AS (SELECT a, b FROM sided WHERE sim >= 0.33 AND type_a = type_b AND type_a <> 'tool' AND {_COMPATIBLE} AND NOT (regexp_matches(content_a, {_SERIES}) AND regexp_matches(content_b, {_SERIES}))), {_CC.format(p="cp")},
w AS (SELECT component, arg_max(cc.id, struct_pack(t := created_at, o := -cc.id)) AS canonical FROM cc JOIN memories m ON cc.id = m.id GROUP BY component) SELECT canonical, id AS duplicate FROM cc JOIN w USING (component) WHERE id <> canonical"""
)
def label_unify(spark: SparkSession, d: str) -> DataFrame:
    return beliefs.cleanup_vectors(store.memory_vectors(spark, d), store.memories(spark, d), 0.33, {"src1": "src2"}, folder(spark))


@query(
    f"""WITH {O.RELATIONS}, moved AS (SELECT doc_id AS duplicate, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents) WHERE doc_id <> canonical)
SELECT DISTINCT coalesce(s.canonical, source_id) AS source_id, coalesce(t.canonical, target_id) AS target_id, relation_type, 1::DOUBLE AS weight FROM relations LEFT JOIN moved s ON source_id = s.duplicate LEFT JOIN moved t ON target_id = t.duplicate WHERE coalesce(s.canonical, source_id) <> coalesce(t.canonical, target_id)"""
)
def repoint_edges(spark: SparkSession, d: str) -> DataFrame:
    docs = store.read(spark, d, "documents")
    first = docs.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    moved = docs.select(F.col("doc_id").alias("duplicate"), F.md5("text").alias("key")).join(first, "key").filter("duplicate <> canonical").select("canonical", "duplicate")
    return graph.repointed(store.relations(spark, d), moved)


# --- judge ----------------------------------------------------------------


@query(
    f"""WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=12)}, {O.SCORES}
SELECT query_id, n.id, score AS judge, row_number() OVER (PARTITION BY query_id ORDER BY score IS NULL, score DESC, vec_pos)::INT AS judge_pos FROM near n LEFT JOIN judge_scores j ON n.id = j.memory_id WHERE score IS NULL OR score > 3 QUALIFY judge_pos <= 5"""
)
def judge_rerank(spark: SparkSession, d: str) -> DataFrame:
    pool = R.knn(store.memory_vectors(spark, d), query_set(spark, d), 12).withColumnRenamed("vec_pos", "pos")
    return R.judged(pool, store.judge_scores(spark, d), 5).select("query_id", "id", "judge", "judge_pos")


@query(f"WITH r AS ({O.recall()}), g AS (SELECT *, bool_or(fts_hit) OVER (PARTITION BY query_id) AS any_hit FROM r) SELECT query_id, id FROM g WHERE query_id % 2 = 0 OR any_hit")
def noise_gate(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("query_id") % 2 == 0, "ok").otherwise("fallback:timeout")
    return R.noise_gate(recall_hybrid(spark, d), status).select("query_id", "id")


@query("SELECT event_id, round((value * 1000 * CASE event_id % 3 WHEN 0 THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END + value * 100 * CASE event_id % 3 WHEN 0 THEN 4.5::DOUBLE ELSE 1.25::DOUBLE END) / 1e6 * CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END, 9) AS cost FROM events")
def judge_cost(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("event_id") % 3 == 0, "mini").otherwise("other")
    return store.events(spark, d).select("event_id", F.round(S.cost(F.col("value") * 1000, F.col("value") * 100, price, F.col("event_id") % 2 == 0), 9).alias("cost"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value * 1e-4), 6) AS spent, count(*) AS calls, round(sum(value * 1e-4), 6) >= 0.5 AS closed FROM events GROUP BY 1")
def judge_budget(spark: SparkSession, d: str) -> DataFrame:
    return state.daily_spend(store.events(spark, d).withColumn("cost", F.col("value") * 1e-4), 0.5)


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value > 0) WHERE rn <= 100 GROUP BY event_type")
def latency_ring(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = store.events(spark, d).filter("value > 0").withColumn("rn", F.row_number().over(w)).filter("rn <= 100")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS fallbacks, round(sum(value), 4) AS tokens FROM events GROUP BY event_type")
def telemetry_counters(spark: SparkSession, d: str) -> DataFrame:
    return store.events(spark, d).groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("fallbacks"), F.round(F.sum("value"), 4).alias("tokens"))


@query()
def judge_cache_key(spark: SparkSession, d: str) -> DataFrame:
    q = query_set(spark, d)
    ids = R.knn(store.memory_vectors(spark, d), q, 5).groupBy("query_id").agg(F.collect_list(F.col("id").cast("string")).alias("ids"))
    return q.join(ids, "query_id").select("query_id", T.set_hash(F.col("query"), F.col("ids")).alias("h"))


# --- importance -----------------------------------------------------------


@query(f"WITH {O.MEMORIES} SELECT id, round(greatest(0::DOUBLE, least(1::DOUBLE, {O.BASE} + {O.BOOST})), 6) AS importance FROM memories")
def importance_initial(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", F.round(S.initial_importance(F.col("type"), F.col("meta_source")), 6).alias("importance"))


@query(f"WITH {O.MEMORIES} SELECT id, round(CASE WHEN importance <= 0 OR id % 120 <= 0 THEN importance ELSE importance * exp(-0.16::DOUBLE * (1 - 0.8::DOUBLE * importance) * (id % 120)) END, 6) AS importance FROM memories")
def importance_decay(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", F.round(S.decay(F.col("importance"), F.round(S.days_between(store.as_of(), F.col("created_at")))), 6).alias("importance"))


@query(f"WITH {O.MEMORIES} SELECT id, round(CASE WHEN access_count <= 0 THEN importance ELSE least(1::DOUBLE, importance + 0.03::DOUBLE * ln(1 + access_count)) END, 6) AS importance FROM memories")
def access_boost(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", F.round(S.access_boost(F.col("importance"), F.col("access_count")), 6).alias("importance"))


_DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT unnest(list_distinct([source_id, target_id])) AS id FROM relations) GROUP BY id)"


@query(f"WITH {O.RELATIONS}, {_DEGREE} SELECT doc_id AS id, round(0.02::DOUBLE * least(coalesce(degree, 0), 10), 6) AS boost FROM documents LEFT JOIN deg ON doc_id = id")
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d).select("id").join(graph.degree(store.relations(spark, d)), "id", "left")
    return m.select("id", F.round(S.hub_boost(F.col("degree")), 6).alias("boost"))


@query(f"WITH {O.MEMORIES} SELECT id, round(CASE WHEN importance = 0.5 AND (access_count > 0 OR meta_source IS NOT NULL) THEN CASE WHEN access_count <= 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, {O.BASE} + {O.BOOST})) ELSE least(1::DOUBLE, greatest(0::DOUBLE, least(1::DOUBLE, {O.BASE} + {O.BOOST})) + 0.03::DOUBLE * ln(1 + access_count)) END ELSE importance END, 6) AS importance FROM memories")
def importance_backfill(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.backfill_importance(store.memories(spark, d)).select("id", F.round("importance", 6).alias("importance"))


# --- lifecycle ------------------------------------------------------------


@query(f"WITH {O.MEMORIES} SELECT id FROM memories WHERE type = 'pattern' AND access_count = 0 AND created_at < {O.AS_OF} - INTERVAL 90 DAY")
def decay_patterns(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.decay_patterns(store.memories(spark, d), store.as_of())


@query(
    f"""WITH {O.SESSIONS} SELECT coalesce(project, 'global') || '_' || isoyear(started_at) || '_W' || lpad(weekofyear(started_at)::VARCHAR, 2, '0') AS tag, count(*) AS sessions, string_agg('- ' || summary, chr(10) ORDER BY started_at, id) AS content
FROM sessions WHERE started_at < {O.AS_OF} - INTERVAL 30 DAY AND summary IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"""
)
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.weekly_digest(store.sessions(spark, d), store.as_of())


@query(
    f"""WITH {O.MEMORIES}, {O.RELATIONS}, {_DEGREE},
x AS (SELECT m.id, type, last_accessed, coalesce(importance, 0.5::DOUBLE) AS base, least(1::DOUBLE, coalesce(importance, 0.5::DOUBLE) + 0.02::DOUBLE * least(coalesce(degree, 0), 10)) AS boosted, least(epoch({O.AS_OF} - coalesce(last_accessed, created_at)) / 86400::DOUBLE, 7) AS idle FROM memories m LEFT JOIN deg USING (id)),
y AS (SELECT *, round(CASE WHEN boosted <= 0 OR idle <= 0 THEN boosted ELSE boosted * exp(-0.16::DOUBLE * (1 - 0.8::DOUBLE * boosted) * idle) END, 4) AS after FROM x),
z AS (SELECT *, CASE WHEN type IN ('preference', 'tool') OR coalesce(epoch({O.AS_OF} - last_accessed) / 86400::DOUBLE <= 7, false) THEN 'exempt' WHEN after < 0.05 THEN 'prune' WHEN abs(after - boosted) > 0.01 THEN 'decay' ELSE 'keep' END AS action FROM y)
SELECT id, action, round(CASE WHEN action = 'decay' THEN after ELSE base END, 4) AS importance FROM z"""
)
def decay_actions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.decay_actions(store.memories(spark, d), store.relations(spark, d), store.as_of())


@query(f"WITH {O.MEMORIES}, {O.RELATIONS} SELECT m.id, coalesce(n, 0) AS cluster_size FROM memories m LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM relations WHERE relation_type = 'part_of' GROUP BY 1) USING (id) WHERE meta_source = 'consolidation' AND created_at >= {O.AS_OF} - INTERVAL 60 DAY AND coalesce(n, 0) <= 4")
def loop_residue(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.loop_residue(store.memories(spark, d), store.relations(spark, d), store.as_of() - F.expr("interval 60 days"))


@query(f"WITH {O.MEMORIES} SELECT id FROM memories WHERE meta_source = 'hook' AND created_at < {O.AS_OF} - INTERVAL 14 DAY")
def snapshot_expiry(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.expired(store.memories(spark, d), store.as_of(), "hook")


@query()
def save_batch(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d).select("content", "type", "tags", "project", "meta_source")
    return lifecycle.save_batch(m, store.as_of()).select("id", "type", "status", F.round("importance", 6).alias("importance"))


@query(f"WITH {O.MEMORIES} SELECT id, CASE WHEN type = 'tool' THEN 'patched ' || id ELSE content END AS content, CASE WHEN type = 'entity' THEN 'moved' ELSE project END AS project FROM memories")
def update_fold(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d)
    patches = m.filter("type in ('tool', 'entity')").select("id", F.when(F.col("type") == "tool", F.concat(F.lit("patched "), F.col("id").cast("string"))).alias("content"), F.when(F.col("type") == "entity", "moved").alias("project"))
    return lifecycle.update_fold(m, patches).select("id", "content", "project")


@query(f"WITH {O.MEMORIES}, {O.RELATIONS}, gone AS (SELECT id FROM memories WHERE type = 'session') SELECT source_id, target_id, relation_type FROM relations WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = store.memories(spark, d).filter("type = 'session'").select("id")
    return graph.without_nodes(store.relations(spark, d), gone).select("source_id", "target_id", "relation_type")


@query(
    f"""WITH {O.MEMORIES}, {O.RELATIONS}, req AS (SELECT id AS source_id, id // 2 AS target_id, CASE WHEN type = 'tool' THEN 'nonsense' ELSE 'supersedes' END AS relation_type FROM memories WHERE id > 0)
SELECT q.*, CASE WHEN relation_type = 'nonsense' THEN 'invalid_relation_type' WHEN NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = q.source_id AND r.target_id = q.target_id AND r.relation_type = q.relation_type) THEN 'not_found' ELSE 'unlinked' END AS status,
  round(CASE WHEN relation_type = 'supersedes' AND EXISTS (SELECT 1 FROM relations r WHERE r.source_id = q.source_id AND r.target_id = q.target_id AND r.relation_type = q.relation_type) THEN least(1::DOUBLE, coalesce(importance, 0.5::DOUBLE) * 2) ELSE importance END, 6) AS importance FROM req q LEFT JOIN memories m ON m.id = q.target_id"""
)
def unlink_restore(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d)
    req = m.filter("id > 0").select(F.col("id").alias("source_id"), F.floor(F.col("id") / 2).alias("target_id"), F.when(F.col("type") == "tool", "nonsense").otherwise("supersedes").alias("relation_type"))
    return lifecycle.unlink(m, store.relations(spark, d), req).withColumn("importance", F.round("importance", 6))


@query(f"WITH {O.MEMORIES}, {O.RELATIONS} SELECT m.id, round(coalesce(importance, 0.5::DOUBLE) * power(0.5::DOUBLE, n), 6) AS importance FROM memories m JOIN (SELECT target_id AS id, count(*) AS n FROM relations WHERE relation_type = 'supersedes' GROUP BY 1) USING (id)")
def supersede_demotion(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.demoted(store.memories(spark, d), store.relations(spark, d)).withColumn("importance", F.round("importance", 6))


@query(
    """WITH l AS (SELECT DISTINCT lang AS name, source AS project FROM documents WHERE source <> 'src3'), r AS (SELECT DISTINCT lang AS name, source AS project FROM documents WHERE lang <> 'fr')
SELECT name, project, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT name, project, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    n = store.read(spark, d, "documents").select(F.col("lang").alias("name"), F.col("source").alias("project"))
    return lifecycle.drift(n.filter("project <> 'src3'"), n.filter("name <> 'fr'"))


@query(
    """WITH p AS (SELECT DISTINCT 'p' || (doc_id % 30) AS name, '/x/' || (doc_id % 30) AS path, CASE WHEN doc_id % 30 < 2 THEN 'primary' END AS status FROM documents), f AS (SELECT DISTINCT '/x/' || (doc_id % 33 + 2) AS path FROM documents)
SELECT 'stale_path' AS fault, name FROM p WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT 'unregistered', path FROM f WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT 'primary_count', n::VARCHAR FROM (SELECT count(*) FILTER (status = 'primary') AS n FROM p) WHERE n <> 1"""
)
def registry_audit(spark: SparkSession, d: str) -> DataFrame:
    i, s = store.read(spark, d, "documents").select("doc_id"), lambda c: c.cast("string")
    k = F.col("doc_id") % 30
    p = i.select(F.concat(F.lit("p"), s(k)).alias("name"), F.concat(F.lit("/x/"), s(k)).alias("path"), F.when(k < 2, "primary").alias("status")).distinct()
    return sessions.registry_audit(p, i.select(F.concat(F.lit("/x/"), s(F.col("doc_id") % 33 + 2)).alias("path")).distinct())


@query("SELECT user_id, seq, ok, failures, failures >= 3 AS open FROM (SELECT user_id, seq, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY seq)::BIGINT AS failures FROM (SELECT user_id, event_id AS seq, event_type <> 'error' AND event_type <> 'click' AS ok, sum((event_type <> 'error' AND event_type <> 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events))")
def breaker_log(spark: SparkSession, d: str) -> DataFrame:
    runs = store.events(spark, d).select("user_id", F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "click")).alias("ok"))
    return lifecycle.breaker(runs, key="user_id")


# --- graph ----------------------------------------------------------------


@query(f"WITH RECURSIVE {O.RELATIONS}, u AS (SELECT source_id AS x, target_id AS y FROM relations UNION SELECT target_id, source_id FROM relations), t(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT y, depth + 1 FROM t JOIN u ON t.id = u.x WHERE depth < 2) SELECT id, min(depth)::INT AS depth FROM t GROUP BY id")
def traverse_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(store.relations(spark, d), 7, 2)


@query(f"WITH {O.RELATIONS}, {_DEGREE} SELECT id, degree FROM deg")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(store.relations(spark, d))


@query(f"WITH RECURSIVE {O.RELATIONS}, p AS (SELECT source_id AS a, target_id AS b FROM relations WHERE relation_type IN ('supersedes', 'contradicts')), {_CC.format(p='p')} SELECT id AS node, component FROM cc")
def components(spark: SparkSession, d: str) -> DataFrame:
    e = store.relations(spark, d).filter("relation_type in ('supersedes', 'contradicts')").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return graph.components(e, folder(spark))


@query(f"WITH {O.RELATIONS} SELECT relation_type, count(*) AS n FROM relations GROUP BY relation_type")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.relations(spark, d).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"WITH {O.MEMORIES}, {O.RELATIONS} SELECT r.source_id, r.target_id FROM relations r JOIN memories a ON a.id = source_id AND a.type IN ('decision', 'pattern') JOIN memories b ON b.id = target_id AND b.type IN ('decision', 'pattern')")
def edges_within(spark: SparkSession, d: str) -> DataFrame:
    some = store.memories(spark, d).filter("type in ('decision', 'pattern')").select("id")
    return graph.edges_within(store.relations(spark, d), some).select("source_id", "target_id")


# --- sessions -------------------------------------------------------------


@query(f"WITH {O.MEMORIES} SELECT type, count(*) AS count FROM memories GROUP BY type")
def status_by_type(spark: SparkSession, d: str) -> DataFrame:
    return sessions.by_type(store.memories(spark, d))


@query(f"WITH {O.MEMORIES}, w AS (SELECT coalesce(importance, 0.5::DOUBLE) AS w FROM memories WHERE type <> 'tool') SELECT count(*) FILTER (w >= 0.8) AS hot, count(*) FILTER (w >= 0.4 AND w < 0.8) AS warm, count(*) FILTER (w < 0.4) AS cold, round(avg(w), 3) AS mean_importance FROM w")
def status_tiers(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tiers(store.memories(spark, d))


@query(f"WITH {O.MEMORIES}, {O.SESSIONS} SELECT *, CASE WHEN last_week > 10 THEN 'HIGH' ELSE 'NORMAL' END AS activity FROM (SELECT count(*) FILTER (created_at >= {O.AS_OF} - INTERVAL 7 DAY) AS last_week, count(*) FILTER (meta_source = 'consolidation') AS syntheses, count(*) AS total FROM memories), (SELECT count(summary) AS with_summary, count(*) AS sessions FROM sessions)")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.counts(store.memories(spark, d), store.sessions(spark, d), store.as_of())


def _section(name: str, source: str, where: str, order: str, n: int) -> str:
    return f"SELECT '{name}' AS section, pos::INT AS pos, id FROM (SELECT id::VARCHAR AS id, row_number() OVER (ORDER BY {order}) AS pos FROM {source} WHERE {where} QUALIFY pos <= {n})"


_SCOPED = "(project = 'src3' OR project IS NULL)"


@query(
    f"WITH {O.MEMORIES}, {O.SESSIONS} "
    + " UNION ALL ".join(
        [
            _section("sessions", "sessions", "project = 'src3'", "started_at DESC, id", 3),
            _section("preferences", "memories", f"{_SCOPED} AND type = 'preference'", f"round(coalesce(importance, 0.5::DOUBLE) * (0.7::DOUBLE + 0.3::DOUBLE * (1 - least(epoch({O.AS_OF} - created_at) / 86400::DOUBLE / 365, 1))), 9) DESC, memories.id", 5),
            _section("decisions", "memories", f"{_SCOPED} AND type = 'decision' AND created_at >= {O.AS_OF} - INTERVAL 7 DAY", "created_at DESC, memories.id", 5),
            _section("entities", "memories", f"{_SCOPED} AND type = 'entity'", "access_count DESC, created_at DESC, memories.id", 5),
        ]
    )
)
def session_start(spark: SparkSession, d: str) -> DataFrame:
    return sessions.start(store.memories(spark, d), store.sessions(spark, d), store.as_of(), "src3")


@query(
    f"WITH {O.MEMORIES}, {O.RELATIONS}, {O.LIVE} "
    + " UNION ALL ".join(
        [
            _section("hot", "memories", f"{_SCOPED} AND type NOT IN ('tool', 'session') AND coalesce(importance, 0.5::DOUBLE) >= 0.8", "coalesce(importance, 0.5::DOUBLE) DESC, created_at DESC, memories.id", 3),
            _section("decisions", "live", f"{_SCOPED} AND type IN ('decision', 'discovery')", "CASE WHEN type = 'decision' THEN 0 ELSE 1 END, coalesce(importance, 0.5::DOUBLE) DESC, created_at DESC, live.id", 6),
            _section("preferences", "live", f"{_SCOPED} AND type = 'preference'", "coalesce(importance, 0.5::DOUBLE) DESC, created_at DESC, live.id", 3),
        ]
    )
)
def digest_start(spark: SparkSession, d: str) -> DataFrame:
    return sessions.digest(store.memories(spark, d), store.relations(spark, d), "src3")


# --- text -----------------------------------------------------------------


@query()
def skip_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn's gate; the patterns need look-around, so it is tested case by case."""
    c = store.read(spark, d, "conversations").filter("role = 'user'")
    vote = F.when(F.col("turn") % 3 == 0, "skip").when(F.col("turn") % 3 == 1, "include")
    return c.withColumn("g", T.skip_gate(F.col("text"), vote)).select("conv_id", "turn", "g.skip", "g.reason")


@query()
def skip_report(spark: SparkSession, d: str) -> DataFrame:
    return sessions.gate_report(skip_gate(spark, d))


@query(f"SELECT doc_id AS id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')), lambda w: NOT list_contains({O.stop_list()}, w))), ' ') AS words FROM documents")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", F.array_join(F.array_sort(T.keywords(F.col("content"))), " ").alias("words"))


@query(f"SELECT doc_id AS id, lower(translate(text, '{O.FOLD_FROM}', '{O.FOLD_TO}')) AS folded FROM documents")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", T.fold(F.col("content")).alias("folded"))


@query()
def telex_repair(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", telex.normalize(F.concat(F.lit("dduowcj thuaanj "), "content")).alias("content"))


@query()
def emotional(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", T.emotional(F.concat(F.when(F.col("id") % 4 == 0, "Hôm nay mệt mỏi. ").when(F.col("id") % 4 == 1, "So anxious! ").otherwise(""), "content")).alias("emotional"))


@query("SELECT doc_id AS id, substr(sha256(trim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END)), 1, 16) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", T.fingerprint(F.col("content")).alias("fingerprint"))


@query("SELECT doc_id AS id, CASE WHEN length(f) <= 200 THEN f ELSE CASE WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') >= 100 THEN substr(h, 1, length(h) - instr(reverse(h), ' ')) ELSE h END || '…' END AS preview FROM (SELECT *, substr(f, 1, 200) AS h FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents))")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d).select("id", T.flat_clip(F.col("content")).alias("preview"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g') AS text FROM pages")
def code_strip(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "pages").select("page_id", T.strip_code(F.col("html")).alias("text"))


@query()
def saveable(spark: SparkSession, d: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(x) for x in ("We decided on the second plan, and this is why it was chosen: ", "Now at v2.10.3 after a long week of work on all of the parts: ", "Nothing much to report here today, all is as it was before: ")]), (F.col("id") % 3).cast("int"))
    return store.memories(spark, d).select("id", T.saveable_excerpt(F.concat(lead, "content")).alias("excerpt")).filter("excerpt is not null")


@query()
def signals(spark: SparkSession, d: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(x) for x in ("It turns out that this holds. ", "The build failed with exit code 2. ", "Next step: we need to update the index. ", "")]), (F.col("turn") % 4).cast("int"))
    c = store.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("line"), F.concat(lead, "text").alias("text"))
    out = None
    for group in ("technical", "error", "action", "next"):
        s = extract.signals(c, group).select(F.lit(group).alias("section"), "conv_id", "line", "kind", "context")
        out = s if out is None else out.unionByName(s)
    return out


@query()
def entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.entities(store.memories(spark, d).withColumnRenamed("content", "text"), {"atlas": [], "data-lake": []}, ["research", "ship"], ["sqlite", "and"])


@query()
def marker_classify(spark: SparkSession, d: str) -> DataFrame:
    m = store.memories(spark, d)
    ids = F.substring(F.md5(F.col("id").cast("string")), 1, 12)
    said = F.when(F.col("id") % 10 == 1, F.concat(F.lit("[SUPERSEDED by "), F.substring(F.md5((F.col("id") - 1).cast("string")), 1, 12), F.lit("] "), "content")).when(F.col("id") % 10 == 2, F.concat(F.lit("This supersedes "), F.substring(F.md5((F.col("id") - 1).cast("string")), 1, 12))).when(F.col("id") % 10 == 3, "RETIRED plan").otherwise(F.col("content"))
    return extract.markers(m.select(ids.alias("id"), said.alias("content")))


_CAPTIONS = "SELECT page_id AS file, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS text, unnest(range(len(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))))) AS line FROM pages"


@query(f"SELECT file, line::INT AS line, text FROM (SELECT file, line, text, lag(text) OVER (PARTITION BY file ORDER BY line) AS before FROM (SELECT file, line, trim(regexp_replace(text, '<[^>]+>', '', 'g')) AS text FROM ({_CAPTIONS}) WHERE NOT contains(text, '-->') AND NOT regexp_matches(text, '^(Kind:|Language:|NOTE)')) WHERE text <> '') WHERE before IS NULL OR before <> text")
def caption_clean(spark: SparkSession, d: str) -> DataFrame:
    p = store.read(spark, d, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.split(F.replace("html", F.lit("><"), F.lit(">\n<")), "\n")).alias("line", "text"))
    return extract.captions(p)


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(c, 'rm\\s+-[a-zA-Z]*r[a-zA-Z]*f') THEN 'recursive force delete' WHEN regexp_matches(c, 'git\\s+clean\\s+-[a-zA-Z]*f') THEN 'git clean -f' WHEN regexp_matches(c, 'git\\s+(add|commit)') THEN 'staged files' END AS why FROM (SELECT conv_id, turn, ['rm -rf ', 'git clean -fd ', 'git commit ', 'ls '][turn % 4 + 1] || text AS c FROM conversations)")
def safety_rules(spark: SparkSession, d: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(s) for s in ("rm -rf ", "git clean -fd ", "git commit ", "ls ")]), (F.col("turn") % 4).cast("int"))
    return store.read(spark, d, "conversations").select("conv_id", "turn", T.safety(F.concat(lead, "text")).alias("why"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'game-dev' WHEN 1 THEN 'finance' WHEN 2 THEN 'research' ELSE 'general' END AS category FROM pages")
def tool_category(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(s) for s in ("A Godot helper", "Budget and runway", "Deep RESEARCH", "Nothing")]), (F.col("page_id") % 4).cast("int"))
    return store.read(spark, d, "pages").select("page_id", T.category(said).alias("category"))


@query("SELECT doc_id AS id, json_extract_string(props, '$.k') AS k FROM (SELECT event_id AS doc_id, props FROM events)")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"))


# --- state ----------------------------------------------------------------


@query(f"WITH {O.VECTORS}, {O.QUERIES}, {O.near(k=12)} SELECT query_id, id, sum(length(text)) OVER (PARTITION BY query_id ORDER BY vec_pos)::BIGINT AS total FROM near JOIN documents ON id = doc_id QUALIFY total <= 8000")
def budget_cumsum(spark: SparkSession, d: str) -> DataFrame:
    pool = R.knn(store.memory_vectors(spark, d), query_set(spark, d), 12).join(store.memories(spark, d).select("id", "content"), "id")
    return R.within_budget(pool, 8000, F.length("content"), order="vec_pos").select("query_id", "id", "total")


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type, false) AS skip FROM events")
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return state.unchanged(store.events(spark, d), "user_id", "event_type").select("event_id", "skip")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def once_per_session(spark: SparkSession, d: str) -> DataFrame:
    return state.once(store.events(spark, d), "user_id", "event_type").select("event_id")


@query("SELECT event_id, (1 + sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session_no FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)")
def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    return state.sessionized(store.events(spark, d), "user_id").select("event_id", "session_no")


@query("WITH RECURSIVE e AS (SELECT event_id, ts, user_id || event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), k(key, n, last, event_id, kept) AS (SELECT key, n, ts, event_id, true FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, CASE WHEN epoch(e.ts) - epoch(k.last) >= 86400 THEN e.ts ELSE k.last END, e.event_id, epoch(e.ts) - epoch(k.last) >= 86400 FROM k JOIN e ON e.key = k.key AND e.n = k.n + 1) SELECT event_id FROM k WHERE kept")
def dedup_within(spark: SparkSession, d: str) -> DataFrame:
    """Batch form of the stateful dedup, a day's window: an ordered fold over each key's times."""
    e = store.events(spark, d)
    rows = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), "event_id")))
    zero = F.array().cast("array<struct<t:bigint,event_id:bigint>>")
    fold = F.reduce(rows, zero, lambda acc, x: F.when((F.size(acc) == 0) | (x["t"] - F.coalesce(F.get(acc, F.size(acc) - 1)["t"], F.lit(0)) >= 86_400_000_000), F.concat(acc, F.array(x))).otherwise(acc))
    return e.groupBy("user_id", "event_type").agg(fold.alias("kept")).select(F.explode("kept.event_id").alias("event_id"))


# --- relational -----------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing(spark: SparkSession, d: str) -> DataFrame:
    l = store.read(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rel_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = store.read(spark, d, "customer").join(store.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(store.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def rel_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    o = store.read(spark, d, "orders")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def rel_left_join(spark: SparkSession, d: str) -> DataFrame:
    o = store.read(spark, d, "orders").filter("o_totalprice > 300000")
    return store.read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "customer").join(store.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def rel_window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return store.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(store.read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def rel_except(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(store.read(spark, d, "orders").select("o_custkey"))


@query("SELECT e.event_id, p.event_id AS before FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type = 'purchase'")
def rel_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase's last earlier error of the same user, by a window instead of an inequality join."""
    e = store.events(spark, d).filter("event_type in ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(w)
    return e.withColumn("before", last["event_id"]).filter("event_type = 'purchase'").select("event_id", "before")


@query("SELECT event_type, approx FROM (SELECT event_type, count(DISTINCT user_id) AS approx FROM events GROUP BY event_type)")
def rel_distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("approx"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rel_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = store.events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


from mnemora.plans import upkeep  # noqa: E402, F401  (registers its queries; it builds on those above)
