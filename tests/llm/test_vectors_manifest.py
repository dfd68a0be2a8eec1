import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm import merkle, metricjoin, queries, vectorcodes
from tests.oracle import check


@pytest.mark.parametrize("name", ["op11_metric_join", "op12_merkle_manifest", "op13_vector_codes"])
def test_oracles(spark, sf, name):
    check(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


# --- metric join ------------------------------------------------------------


def linked(rows, least=0.98):
    """Links and components of all pairs, by a loop."""
    n, comp = [0] * len(rows), list(range(len(rows)))

    def root(i):
        return i if comp[i] == i else root(comp[i])

    def unit(e):
        if e is None or not len(e) or not all(x is not None and np.isfinite(x) for x in e) or not any(e):
            return None
        v = np.array(e, dtype=float)
        v /= np.abs(v).max()
        return v / np.linalg.norm(v)

    vs = [unit(e) for _, e, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if vs[i] is not None and vs[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                comp[root(i)] = root(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[root(i)] = min(least_id.get(root(i), r[0]), r[0])
    return sorted(((r[0], n[i], least_id.get(root(i)), r[0] == least_id.get(root(i))) for i, r in enumerate(rows)), key=repr)


def joined(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted((tuple(r) for r in metricjoin.linked_vectors(df.withColumn("unit", F.lit(1)).withColumn("g", F.lit("x"))).collect()), key=repr)


def test_metric_join_of_crowds_and_chains(spark, monkeypatch):
    """Small cells and tiles: exact copies, a crowd of near copies, a chain across cells, random vectors and a hot label."""
    monkeypatch.setattr(metricjoin, "CELL", 20)
    monkeypatch.setattr(metricjoin, "TILE_ROWS", 9)
    rng = np.random.default_rng(4)
    crowd = np.array([1.0, 0, 0, 0, 0, 0]) + 0.07 * rng.normal(size=(70, 6))
    chain = [[np.cos(a), np.sin(a), 0, 0, 0, 0] for a in np.arange(0, 3, 0.15)]
    vs = [*crowd.tolist(), *chain, *rng.normal(size=(150, 6)).tolist(), *[[0, 0, 1.0, 0, 0, 0]] * 40, *[[0, 0, 3.0, 0, 0, 0]] * 5]
    rows = [(i, [float(np.float32(x)) for x in v], 1 if i % 9 else 2) for i, v in enumerate(vs)]
    got = joined(spark, rows)
    assert got == linked(rows)
    assert max(r[1] for r in got) > 30 and len({r[2] for r in got}) > 60


def test_metric_join_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (None, [-3.0, 0.1], 1), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1)]
    rows += [(8, [None, 1.0], 1), (9, [1.0, 0.0], 2), (10, [1e-200, 0.0], 1), (11, [1e200, 1e200], 1), (12, [1e200, 1e200], 1), (1, [0.0, 1.0], 1), (13, [], 1), (14, [1.0, 0.0, 0.0], 1), (15, [float("inf"), 0.0], 1)]
    got = joined(spark, rows, "double")
    assert got == linked(rows)
    assert (None, 3, 1, False) in got and (None, 0, None, True) in [(a, b, c, k or a is None and c is None) for a, b, c, k in got]
    assert joined(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.01, 0.4), st.integers(1, 12), st.integers(1, 12))
def test_links_of_tiles_equal_products(seed, spread, n, m):
    """Rows that the middle of a tile settles are settled as multiplication would."""
    rng = np.random.default_rng(seed)
    a, b = (np.eye(4)[0] + spread * rng.normal(size=(k, 4)) for k in (n, m))
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    sim = a @ b.T
    assert (metricjoin.links(a, b, 0.98) == (sim >= 0.98))[abs(sim - 0.98) > 1e-9].all()


def test_local_components():
    m = np.zeros((4, 3), bool)
    m[0, 0] = m[1, 0] = m[2, 2] = True
    a, b = metricjoin.local_roots(m)
    assert a[0] == a[1] == b[0] and a[2] == b[2] != a[0] and a[3] == b[1] == -1


# --- merkle manifest --------------------------------------------------------


def manifest(rows):
    """Leaves, trees, proofs and folds by plain loops, as the driver's contract words them."""
    sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
    field = lambda v: b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()
    leaf_of = lambda r: sha(b"".join(map(field, r)))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)

    def tree(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + 3] for i in range(0, len(level), 3)]
            for x, i in enumerate(at):
                paths[x].append((runs[i // 3][: i % 3], runs[i // 3][i % 3 + 1 :]))
            at, level = [i // 3 for i in at], ["".join(run) for run in runs]
            level = [sha(x) for x in level]
        return level[0], paths

    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by_source[s]])
    root, above = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, path in zip(by_source[s], trees[s][1], strict=True):
            path = path + up
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            end = leaf_of((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in path:
                end = sha("".join([*left, end, *right]))
            out.append((r[0], leaf_of(r), trees[s][0], root, sha("".join(x for a, b in path for x in a + b)), end, end == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def proved(df):
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)


@pytest.mark.parametrize(("depth", "top"), [(7, 3**8), (2, 5), (1, 2)])
def test_manifest_by_plain_loops(spark, sf, monkeypatch, depth, top):
    """Also with blocks of 9 and 3 and a tiny top tree, where trees and the tree of sources are reduced in several steps."""
    for name, value in (("DEPTH", depth), ("BLOCK", 3**depth), ("TOP", top)):
        monkeypatch.setattr(merkle, name, value)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [(1000 + i, "hot", "en", i, f"a\nb{i}") for i in range(130)]
    got = proved(spark.createDataFrame(rows, DOCS))
    assert got == manifest(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", "de", 3, "x\ny"), (None, "a", "de", 3, "x\ny"), (1, None, "de", 3, "x\ny"), (1, None, "de", 3, "x\ny"), (1, None, "de", None, None), (5, "ä", None, 0, ""), (6, "z", None, 0, "\n" * 9), (7, "", "x", 1, "é😀\n")]
    rows += [(9, "same", "en", 1, "copy\n")] * 40
    df = spark.createDataFrame(rows, DOCS)
    extra = df.withColumns({c: F.lit(1) for c in ("hash", "g", "i", "n", "changed")})
    assert proved(df) == proved(extra) == manifest(rows)
    assert proved(df.limit(0)) == []
    one = df.filter("doc_id = 5")
    (r,) = merkle.prove(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_paths_travel_packed():
    level = [hashlib.sha256(bytes([i])).hexdigest() for i in range(7)]
    (top,), paths = merkle.climb(level, merkle.height(7))
    for leaf, path in zip(level, paths, strict=True):
        assert merkle.unpacked(merkle.packed(path)) == path and merkle.folded(leaf, path) == top


# --- vector codes -----------------------------------------------------------


def coded(rows):
    """Codes, errors and codebooks by full comparison in plain integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    width = -(-max((len(r[1]) for r in kept), default=0) // 8)
    q = [[int(np.floor(4096 * float(np.float32(x)))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    parts = [[v[p * width : (p + 1) * width] for v in q] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(6):
        for p in range(8):
            at = [nearest(x, books[p]) for x in parts[p]]
            for e in set(at):
                mine = [x for x, a in zip(parts[p], at, strict=True) if a == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    name = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, r in enumerate(kept):
        code = [nearest(parts[p][i], books[p]) for p in range(8)]
        error = sum(dist(parts[p][i], books[p][c]) for p, c in enumerate(code))
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], r[2], "".join(f"{c:02x}" for c in code), error))
    return sorted(((*o, sums[o[1]], name) for o in out), key=repr)


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({"q": F.lit(1), "code": F.lit("x")})
    return sorted((tuple(r) for r in vectorcodes.with_label_errors(vectorcodes.encode(df)).collect()), key=repr)


def test_codes_by_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "ROWS", 50)
    monkeypatch.setattr(vectorcodes, "SENT_LABELS", 4)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=24)], None if i % 5 == 0 else f"l{i % 40 if i % 3 else 0}") for i in rng.permutation(300)]
    rows += [(1000 + i, rows[3][1], "l0") for i in range(30)]
    assert encoded(spark, rows) == coded(rows)


def test_codes_of_odd_rows(spark):
    rows = [(None, [1.0] * 8, "a"), (1, None, None), (2, [float("nan")] * 8, "a"), (3, [None] + [1.0] * 7, "b"), (4, [], "a"), (5, [1.0, 2.0, 3.0], "a"), (6, [float("-inf")], "a"), (7, [-0.00001] * 17, None), (7, [-0.00001] * 17, None)]
    got = encoded(spark, rows)
    assert got == coded(rows) and len(got) == 5
    assert encoded(spark, []) == []


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 20), st.integers(1, 6))
def test_partial_distances_are_exact(seed, width, entries, n):
    """Small integers, so that there are ties: the lower index wins."""
    rng = np.random.default_rng(seed)
    rows, books = rng.integers(-3, 4, (n, 8, width)), rng.integers(-3, 4, (8, entries, width))
    code, far = vectorcodes.search(rows, books)
    whole = ((rows[:, :, None] - books[None]) ** 2).sum(axis=3)
    assert (code == whole.argmin(axis=2)).all() and (far == whole.min(axis=2)).all()


def test_quantised_slices_of_arrays():
    column = pa.array([[1.0], None, [0.5, -0.5], [], [float("nan")]], pa.list_(pa.float64()))
    whole, q = vectorcodes.quantised(column.slice(2, 3))
    assert whole.tolist() == [True, True, False] and q.tolist() == [[2048, -2048], [0, 0]]
