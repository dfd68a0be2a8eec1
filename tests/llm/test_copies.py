import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm import jaccard, queries, substrings
from tests.oracle import check

# --- substrings -------------------------------------------------------------


def removed(texts, window):
    """Per text: bytes, removed bytes, runs and the hash of the rest, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[p : p + window] for r in raw for p in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - window + 1):
            if count[r[p : p + window]] > 1:
                gone[p : p + window] = b"\x01" * window
        left = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), len(r) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.integers(2, 40))
def test_names_of_substrings(data, k):
    h = substrings.rolling(np.frombuffer(data, np.uint8), k)
    strings = [data[i : i + k] for i in range(len(data) - k + 1)]
    assert len(h) == len(strings) and len(set(h.tolist())) == len(set(strings))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200), st.integers(1, 12), st.sampled_from([(2, 2), (8, 4), (64, 64)]))
def test_units_hold_every_window_once(data, edge, every):
    """Each window start of each text is in one unit of its first trigger."""
    p = substrings.Parse(12, 3, every, (4, 1))
    texts = [np.array(data[i : i + 20 * edge], np.uint8) for i in range(0, len(data), 20 * edge)]
    for stretch, _, _, edges in substrings.stretches(texts, 12):
        t, first, last, a, core, hull = substrings.units(stretch, edges, p)
        starts = sorted(x for lo, hi in zip(first.tolist(), last.tolist(), strict=True) for x in range(lo, hi + 1))
        assert starts == [x for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for x in range(lo, hi - 11)]
        assert ((t - last >= a) & (t - first < a + 4) & (t - first <= p.reach) & (first <= last)).all()


def corpus(window, seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = [word(window * 2), word(window + 3), word(window - 2)]
    texts = [word(int(rng.integers(0, 6 * window))) for _ in range(25)]
    for k in range(30):
        s = shared[k % 3]
        a, b = sorted(rng.integers(0, len(s), 2))
        texts.append(word(int(rng.integers(0, window))) + s[a if k % 4 == 0 else 0 : b if k % 4 == 0 else None] + word(int(rng.integers(0, window))))
    return [*texts, "a" * (3 * window), "ab" * window, texts[3], texts[3], None, "", shared[0] + shared[0], "\x00" * (window + 5)]


@pytest.mark.parametrize("chunk", [1 << 20, 500])
@pytest.mark.parametrize("bits", [20, 6])
@pytest.mark.parametrize("parse", [None, substrings.Parse(40, 3, (64, 32), (64, 8, 4, 1)), substrings.Parse(40, 12, (2, 2), (2, 1))])
def test_removal_by_table(spark, monkeypatch, chunk, bits, parse):
    """Also with bitmaps so small that nearly every name hits, and with triggers so rare that windows have none."""
    window = 40
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "LEAST_BITS", bits)
    monkeypatch.setattr(substrings, "MOST_BITS", bits)
    texts = corpus(window, chunk + bits)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {bytes(r["key"]): r["spans"] for r in substrings.repeated_spans(d, window=window, parse=parse).collect()}
    got = []
    for t in texts:
        raw = (t or "").encode()
        runs = substrings.merged(spans.get(hashlib.md5(raw).digest()), window)
        left = substrings.kept(raw, runs)
        got.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
    assert got == removed(texts, window)


def test_digest_and_cut(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (None, "y" * 450), (9002, "z" * 399), (9003, "z" * 399), (9004, "é" * 300), (9004, "é" * 300), (9005, "0123456789" * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("spans_key", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    got = substrings.digest(d).collect()
    want = [(i, *w) for (i, _), w in zip(rows, removed([t for _, t in rows], 400), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    cut = substrings.remove_repeats(d)
    assert cut.columns == d.columns and cut.count() == len(rows)
    by = {r["doc_id"]: r for r in cut.collect()}
    assert by[9000]["text"] is None and by[9004]["text"] == "" and by[9002]["text"] == "z" * 399 and all(r["n_chars"] == len(r["text"]) for r in by.values() if r["text"] is not None)
    assert substrings.digest(d.limit(0)).count() == 0 and substrings.remove_repeats(d.limit(0)).count() == 0


# --- Jaccard join -----------------------------------------------------------


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, n, num, den):
    """(id, size, smallest id reachable) of each row, by comparing all pairs."""
    sets = sets_of([t for _, t in rows], n)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                up[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), (least.get(find(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows)]


def near_copies(seed, groups=6, size=12, words=120):
    rng = np.random.default_rng(seed)
    rows, i = [], 100
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, words)))]
        for k in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 15)) if k else 0):
                t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 99999)}"
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "ONE "), (12, "one two"), (None, rows[0][1]), (None, "alone without any id here at all"), (rows[5][0], "another text under the same id as before"), (13, "É É É"), (14, "é é é"), (5, rows[20][1].upper())]
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 50)])
@pytest.mark.parametrize("short", [6, 1])
def test_groups_by_all_pairs(spark, monkeypatch, n, num, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "LONG", short)
    rows = near_copies(n + num)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("clash"))
    got = jaccard.groups(d, n, num, 100).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, n, num, 100), key=str)


@pytest.mark.parametrize("short", [6, 1])
def test_join_by_all_pairs(spark, monkeypatch, short):
    """Every link, also between two members of one leader's list, with its overlap and union."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = near_copies(8)
    members, links = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 50, 100)
    texts = sorted({t or "" for _, t in rows})
    key = {t: hashlib.md5(t.encode()).digest() for t in texts}
    sets, want = sets_of(texts, 2), []
    for i, x in enumerate(texts):
        for j in range(i):
            k = len(sets[i] & sets[j])
            u = len(sets[i] | sets[j])
            if k and 100 * k >= 50 * u:
                want.append((*sorted((key[x], key[texts[j]])), k, u))
    got = [(bytes(r["a"]), bytes(r["b"]), r["common"], r["joint"]) for r in links.collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    size = dict(zip(texts, map(len, sets), strict=True))
    assert sorted(((r["doc_id"], bytes(r["key"]), r["n_shingles"]) for r in members.collect()), key=str) == sorted(((i, key[t or ""], size[t or ""]) for i, t in rows), key=str)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.data())
def test_linked_sets_share_a_signature(tokens, data):
    """The pigeonhole: sets that link share a signature, and their marks do not rule them out."""
    a = sorted(tokens)
    drop = data.draw(st.integers(0, max(0, len(a) // 8)))
    add = data.draw(st.sets(st.integers(0, 2**64 - 1), max_size=max(1, len(a) // 8)))
    b = sorted(set(a[drop:]) | add)
    for num in (80, 90):
        k, u = len(set(a) & set(b)), len(set(a) | set(b))
        if k * 100 >= num * u:
            x, y = np.array(a, np.uint64), np.array(b, np.uint64)
            left = data.draw(st.sets(st.integers(0, 255), max_size=200))  # signatures that count as long, by their last byte
            long = lambda sig: np.isin(sig & np.uint64(255), list(left))
            kept = [{s for sig, spare in jaccard.signatures(z, num, 100) for s in jaccard.without_long(sig, long(sig), spare).tolist()} for z in (x, y)]
            assert kept[0] & kept[1]
            ma, mb = jaccard.mark(x), jaccard.mark(y)
            size = min(len(ma), len(mb))
            assert (jaccard.folded(ma, size) != jaccard.folded(mb, size)).sum() <= (len(a) + len(b)) * (100 - num) // (100 + num)


def test_marks_rule_out_sets_without_anything_in_common():
    """Also where the smaller set is just too small for the mark of the larger one."""
    rng = np.random.default_rng(4)
    for k in range(5, 12):
        for n, m in ((1 << k, (1 << k) * 5 // 4), ((1 << k) - 3, 1 << k), ((1 << k) + 1, (1 << k) * 5 // 4)):
            for _ in range(20):
                ma, mb = (jaccard.mark(np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))) for size in (n, m))
                assert not jaccard.alike(ma, mb, n + m, 80, 100)


def test_one_of_each_group_stays(spark):
    rows = near_copies(1)
    rows += [rows[3], rows[3]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("near_id", F.lit("clash")).withColumn("component", F.lit(0))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute(rows, 5, 80, 100)
    groups = collections.defaultdict(set)
    for (key, _), (_, size, least) in zip(rows, want, strict=True):
        if size and least is not None:
            groups[least].add(key)
    assert all(ids.count(g) >= 1 for g in groups)
    assert sum(len(r["text"].split()) > 0 for r in kept.filter("text is not null").collect()) == len({(w[2], None) if w[2] is not None else i for i, w in enumerate(want) if w[1]})
    assert {7, 8, 9} <= set(ids)
    assert jaccard.keep_one(d.limit(0)).count() == 0 and jaccard.groups(d.limit(0)).count() == 0


def test_op8_oracle(spark):
    check(spark, "/root/testdata/sf0.001", queries.queries()["op8_jaccard_join"], queries.oracle_sql()["op8_jaccard_join"])
