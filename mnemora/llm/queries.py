"""The queries of this subpackage: one thin wrapper for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import decontam, jaccard, langid, media, merkle, metricjoin, packing, sharding, substrings, toxicity, urlfilter, vectorcodes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_read(spark, sf_dir, "documents"), 3, 90, 100)


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.linked_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.with_label_errors(vectorcodes.encode(_read(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_language_id, op3_suffix_dedup, op4_toxicity, op5_best_fit_packing, op6_vector_sharding, op7_mpeg_audio, op8_jaccard_join, op9_string_tiling, op10_warc_zstd, op11_metric_join, op12_merkle_manifest, op13_vector_codes)}


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(sha, i, 1)) - 1) * 4 + 1, 4)), lambda x, y: x || y) AS bits FROM g)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(bits, i * 5 + 1, 5)::BITSTRING::INT + 1, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.sh
"""


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept FROM v JOIN r ON r.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""


OP12_SQL = """
WITH RECURSIVE crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 2 = 0 AS even FROM documents, crc_table),
f AS (SELECT doc_id, coalesce('s' || source, '') AS g, coalesce(even, false) AS even,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS cut FROM d),
leaves AS (SELECT doc_id, g, sha256(head || body) AS leaf, sha256(head || CASE WHEN even THEN cut ELSE body END) AS changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM f),
lower(lvl, g, i, h, n) AS (SELECT 0, g, i, leaf, n FROM leaves UNION ALL SELECT lvl + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM lower WHERE n > 1 GROUP BY lvl, g, i // 3, n),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS s, count(*) OVER () AS m FROM lower WHERE n = 1),
upper(lvl, i, h, n) AS (SELECT 0, s, subroot, m FROM subroots UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (SELECT lvl, g, i, h FROM lower WHERE n > 1 UNION ALL SELECT lvl + 100, '', i, h FROM upper WHERE n > 1),
runs AS (SELECT lvl, g, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes GROUP BY lvl, g, i // 3),
steps AS (SELECT leaf.doc_id, leaf.g, leaf.i, r.lvl, r.hs, ((leaf.i // (3 ** r.lvl)::BIGINT) % 3)::BIGINT AS k FROM leaves leaf JOIN runs r ON r.lvl < 100 AND r.g = leaf.g AND r.run = leaf.i // (3 ** (r.lvl + 1))::BIGINT
  UNION ALL SELECT leaf.doc_id, leaf.g, leaf.i, r.lvl, r.hs, ((s.s // (3 ** (r.lvl - 100))::BIGINT) % 3)::BIGINT FROM leaves leaf JOIN subroots s ON s.g = leaf.g JOIN runs r ON r.lvl >= 100 AND r.run = s.s // (3 ** (r.lvl - 99))::BIGINT),
paths AS (SELECT g, i, list({'a': array_to_string(hs[1 : k], ''), 'b': array_to_string(hs[k + 2 :], '')} ORDER BY lvl) AS path FROM steps GROUP BY g, i),
p AS (SELECT leaf.*, coalesce(paths.path, []) AS path FROM leaves leaf LEFT JOIN paths ON paths.g = leaf.g AND paths.i = leaf.i),
fold(g, i, k, h) AS (SELECT g, i, 1, changed FROM p UNION ALL SELECT fold.g, fold.i, k + 1, sha256(path[k].a || h || path[k].b) FROM fold JOIN p ON p.g = fold.g AND p.i = fold.i WHERE k <= len(path)),
ends AS (SELECT g, i, max_by(h, k) AS h FROM fold GROUP BY g, i)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(array_to_string(list_transform(p.path, lambda x: x.a || x.b), '')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM p JOIN subroots s ON s.g = p.g JOIN upper r ON r.n = 1 JOIN ends e ON e.g = p.g AND e.i = p.i
"""


def op13_sql() -> str:
    """The rounds written out, each one's nearest entries and new codebook as tables of their own."""
    near = "SELECT p.vec_id, p.part, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + b.e) AS best FROM p JOIN b{0} b ON b.part = p.part GROUP BY p.vec_id, p.part"
    tables = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM v, range(8) r(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16)",
    ]
    for r in range(vectorcodes.ROUNDS):
        tables.append(f"n{r} AS MATERIALIZED ({near.format(r)})")
        tables.append(f"m{r} AS (SELECT part, e, list(s ORDER BY i) AS c FROM (SELECT part, best % 16 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS s FROM n{r}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY part, best % 16, i) GROUP BY part, e)")
        tables.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)")
    last = vectorcodes.ROUNDS
    tables.append(f"n{last} AS MATERIALIZED ({near.format(last)})")
    tables.append(f"f AS (SELECT vec_id, string_agg('0' || lower(to_hex(best % 16)), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM n{last} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{last})"
    joined = ",\n".join(tables)
    return f"WITH {joined}\nSELECT v.vec_id, v.label, f.code, f.error, (sum(f.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, {books} AS codebooks_sha256 FROM v JOIN f ON f.vec_id = v.vec_id"


def oracle_sql() -> dict[str, str]:
    return {"op8_jaccard_join": OP8_SQL, "op10_warc_zstd": OP10_SQL, "op11_metric_join": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_vector_codes": op13_sql()}
