import collections
import re

import numpy as np

import corpus_pipeline
from mnemora.llm import decontam, toxicity
from mnemora.llm.tokens import loaded
from tests.llm.test_copies import brute


def without_repeats(texts, window, words):
    """The texts without strings of ``window`` bytes and passages of ``words`` words that start at two places, by tables of all of them."""
    raws = [t.encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^ \t\n\x0b\f\r]+", r)] for r in raws]
    own = [[r[a:b] for a, b in p] for r, p in zip(raws, places, strict=True)]
    strings = collections.Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    runs = collections.Counter(tuple(w[i : i + words]) for w in own for i in range(len(w) - words + 1))
    out = []
    for r, p, w in zip(raws, places, own, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if strings[r[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        for i in range(len(w) - words + 1):
            if runs[tuple(w[i : i + words])] > 1:
                a, b = p[i][0], p[i + words - 1][1]
                gone[a:b] = b"\x01" * (b - a)
        out.append(bytes(c for c, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_stages_one_by_one(spark, sf, tmp_path):
    """Every stage against plain loops on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, after = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    assert set(after[0]) == {r["doc_id"] for r in scored if not r["predicted"]}
    rows = sorted(after[0].items())
    assert set(after[1]) == {i for i, size, least in brute(rows, 5, 80, 100) if i == least or not size}
    ids = sorted(after[1])
    assert after[2] == dict(zip(ids, without_repeats([after[1][i] for i in ids], 400, corpus_pipeline.PASSAGE_WORDS), strict=True))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    b = decontam.block(items, decontam.MIN_MATCH)
    dirty = {i for i, t in after[2].items() if any(c >= 0.5 * len(b.items[k]) for k, c, _, _ in decontam.search(b, t))}
    assert dirty and set(after[3]) == set(after[2]) - dirty
    bpe = loaded()
    want = {i: len(bpe.encode(t)) + 1 for i, t in after[3].items()}
    got = {}
    for r in after[4]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert len({r["sequence_id"] for r in after[4]}) <= after[4][0]["partition_bound"] + 1
    assert set(start) >= set(got)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5


def test_short_passages_are_cut(spark):
    """Passages of 51 words repeat in under 400 bytes; those of 50 words stay."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    whole, short, solid = [f"{x:03d}" for x in rng.permutation(999)[:51]], word(50), "".join(word(60))[:401]
    assert len(" ".join(whole)) < 400 and len(solid) == 401
    texts, want = [], []
    for cut, text in ((True, whole), (False, short), (True, [solid])):
        for gap in (" ", "\n "):
            a, b = word(70), word(70)
            texts.append(gap.join(a) + gap + gap.join(text) + gap + gap.join(b))
            want.append([*a, *([] if cut else text), *b])
    texts += [" ".join(whole), "é " * 20, " ".join(word(51)), None]
    want += [[], ["é"] * 20, texts[-2].split(), None]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)] + [(99, texts[-2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    want[-2] = []  # copies of 51 words lose everything
    assert [None if got[i]["text"] is None else got[i]["text"].split() for i in range(len(texts))] == want
    assert got[99]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
