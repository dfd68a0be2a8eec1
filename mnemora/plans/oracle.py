"""DuckDB views of the memory store over the driver's tables, as common table expressions for the oracle queries."""

from __future__ import annotations

from mnemora.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

BASE = "CASE type WHEN 'preference' THEN 0.9::DOUBLE WHEN 'decision' THEN 0.8::DOUBLE WHEN 'pattern' THEN 0.7::DOUBLE WHEN 'discovery' THEN 0.6::DOUBLE WHEN 'entity' THEN 0.5::DOUBLE WHEN 'tool' THEN 0.4::DOUBLE WHEN 'session' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"
BOOST = "CASE meta_source WHEN 'reflect' THEN 0.15::DOUBLE WHEN 'manual' THEN 0.1::DOUBLE WHEN 'mentor' THEN 0.1::DOUBLE WHEN 'research' THEN 0.05::DOUBLE WHEN 'hook' THEN -0.2::DOUBLE WHEN 'consolidation' THEN -0.1::DOUBLE ELSE 0::DOUBLE END"

MEMORIES = f"""
m0 AS (SELECT doc_id AS id, text AS content, ['decision','discovery','pattern','entity','preference','session','tool'][doc_id % 7 + 1] AS type,
  CASE WHEN doc_id % 4 <> 0 THEN source END AS project, lang, source, ['reflect','manual','mentor','research','wrap','hook','consolidation'][doc_id % 8 + 1] AS meta_source FROM documents),
memories AS (SELECT *, {AS_OF} - to_days((id % 120)::INT) AS created_at, id % 11 AS access_count, CASE WHEN id % 5 <> 0 THEN {AS_OF} - to_days((id % 30)::INT) END AS last_accessed,
  CASE WHEN id % 13 <> 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, {BASE} + {BOOST})) END AS importance FROM m0)
"""
RELATIONS = """
r0 AS (SELECT doc_id, ['supersedes','contradicts','relates_to','part_of','depends_on','caused_by','used_by'][doc_id % 7 + 1] AS k, (SELECT count(*) FROM documents) AS n FROM documents),
relations AS (SELECT DISTINCT s AS source_id, t AS target_id, k AS relation_type FROM (SELECT doc_id AS s, doc_id // 2 AS t, k FROM r0 WHERE doc_id > 0 UNION ALL SELECT doc_id, (7 * doc_id + 3) % n, k FROM r0 WHERE doc_id % 3 = 0) WHERE s <> t)
"""
SESSIONS = f"""
sessions AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 <> 0 THEN 'src' || (conv_id % 20) END AS project, {AS_OF} - to_days((conv_id % 100)::INT) AS started_at, min_by(text, turn) AS summary FROM conversations WHERE role = 'user' GROUP BY conv_id)
"""
SCORES = "judge_scores AS (SELECT doc_id AS memory_id, 7 * quality + 3 * (1 - toxic) AS score FROM labels)"
VECTORS = "vectors AS (SELECT vec_id AS memory_id, embedding::DOUBLE[] AS embedding FROM embeddings)"
PAIRS = """
pairs AS (SELECT * FROM (SELECT x.memory_id AS a, y.memory_id AS b, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS sim FROM vectors x JOIN vectors y ON x.memory_id < y.memory_id) WHERE sim >= 0.3)
"""
QUERIES = "queries AS (SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS vec FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"


def tokens(text: str) -> str:
    """A list of index terms."""
    return f"list_filter(regexp_split_to_array(lower(translate({text}, '{FOLD_FROM}', '{FOLD_TO}')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


INDEXED = "concat_ws(' ', content, lang || ' ' || source, project)"
PHRASES = "list_filter(regexp_split_to_array(query, '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))[1:16]"
#: Needs memories and queries; gives toks, bm (query_id, id, score), all_of (query_id, id).
TEXT = f"""
toks AS (SELECT id, {tokens(INDEXED)} AS toks FROM memories),
q_terms AS (SELECT query_id, list_distinct(flatten(list_transform({PHRASES}, lambda p: {tokens("p")}))) AS terms FROM queries),
post AS (SELECT id, len(toks) AS len, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM toks),
tf AS (SELECT id, len, term, count(*) AS tf FROM post GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tot AS (SELECT count(*) AS n_docs, avg(len(toks)) AS mean_len FROM toks),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean_len))), 6) AS score, count(*) AS hits
  FROM (SELECT query_id, unnest(terms) AS term FROM q_terms) JOIN tf USING (term) JOIN dfs USING (term), tot GROUP BY query_id, id),
ph0 AS (SELECT query_id, unnest({PHRASES}) AS phrase, unnest(range(len({PHRASES}))) AS n FROM queries),
ph AS (SELECT query_id, n, {tokens("phrase")} AS terms FROM ph0 WHERE len({tokens("phrase")}) > 0),
pht AS (SELECT query_id, n, len(terms) AS width, unnest(terms) AS term, unnest(range(len(terms))) AS off FROM ph),
whole AS (SELECT query_id, n, id FROM pht JOIN post USING (term) GROUP BY query_id, n, width, id, pos - off HAVING count(DISTINCT off) = width),
need AS (SELECT query_id, count(*) AS need FROM ph GROUP BY query_id),
all_of AS (SELECT query_id, id FROM whole JOIN need USING (query_id) GROUP BY query_id, id, need HAVING count(DISTINCT n) = need)
"""
LIVE = "live AS (SELECT * FROM memories WHERE id NOT IN (SELECT target_id FROM relations WHERE relation_type = 'supersedes'))"


def near(source: str = "vectors", k: int = 20) -> str:
    return f"near AS (SELECT query_id, memory_id AS id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) AS vec_pos FROM (SELECT query_id, memory_id, round(list_cosine_similarity(embedding, vec), 6) AS sim FROM {source}, queries) QUALIFY vec_pos <= {k})"


LEGS = "texts AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_pos FROM bm SEMI JOIN all_of USING (query_id, id) QUALIFY fts_pos <= 20)"


def recall(k: int = 5, where: str = "true") -> str:
    return f"""
WITH {MEMORIES}, {RELATIONS}, {VECTORS}, {QUERIES}, {TEXT}, {LIVE}, {LEGS}, {near()},
both_legs AS (SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.id, n.id) AS id, fts_pos, vec_pos FROM texts t FULL JOIN near n ON t.query_id = n.query_id AND t.id = n.id),
s AS (SELECT query_id, b.id, l.type, round((coalesce(1::DOUBLE / (60 + fts_pos), 0) + coalesce(1::DOUBLE / (60 + vec_pos), 0)) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(importance, 0.5::DOUBLE)), 9) AS score, fts_pos IS NOT NULL AS fts_hit, vec_pos IS NOT NULL AS vec_hit
  FROM both_legs b JOIN live l ON b.id = l.id WHERE {where})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS pos, id, type, score, fts_hit, vec_hit FROM s QUALIFY pos <= {k}
"""


def stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
