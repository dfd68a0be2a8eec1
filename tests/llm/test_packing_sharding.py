import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm import packing, sharding
from mnemora.llm.tokens import loaded

ODD = ["", " ", "don't it's we'll _a_b !!'s x²  é é İstanbul <|endoftext|> a", "\x0b\x0c a\xa0b", "ﬁne Ωσς ÀÉ ßẞ", "'S 'T I'M ", "12³ 3½", "日本語 🙂", "ŉ ǅ Ĳ", "a­b", "tab\tnew\r\nline", "x" * 5000]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_tokens_equal_the_library(text):
    bpe = loaded()
    assert bpe.encode(text).tolist() == bpe.tok.encode(text, add_special_tokens=False).ids


def test_tokens_of_odd_and_real_texts(spark, sf, monkeypatch):
    from mnemora.llm import tokens

    bpe = tokens.WordBpe()
    monkeypatch.setattr(tokens, "SPAN", 50)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in ODD + real:
        assert bpe.encode(text).tolist() == bpe.tok.encode(text, add_special_tokens=False).ids


def test_texts_learn_a_word_once(monkeypatch):
    """What is new to texts that are split together goes to the vocabulary once, a word beside punctuation as the word."""
    from mnemora.llm import tokens

    bpe, learned = tokens.WordBpe(), []
    learn = bpe._learn
    monkeypatch.setattr(bpe, "_learn", lambda words: (learned.extend(words), learn(words)))
    texts = ["Alpha beta, beta.", "beta (gamma) alpha!", "", "gamma's 12"] + ODD
    assert [x.tolist() for x in bpe.encode_all(texts)] == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(learned) == len(set(learned)) and {"beta", "gamma"} <= set(learned) and "beta," not in learned


def test_frequent_words_and_batches_are_learned_once(spark, monkeypatch):
    """A word that stands twice in a span is known from then on, and small batches are split together."""
    import pyarrow as pa

    from mnemora.llm import common, tokens

    bpe, learned = tokens.WordBpe(), []
    learn = bpe._learn
    monkeypatch.setattr(bpe, "_learn", lambda words: (learned.extend(words), learn(words)))
    texts = ["alpha beta beta", "beta beta, gamma", "Beta! gamma"]
    assert [bpe.encode(t).tolist() for t in texts] == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert learned.count("beta") == 1 and learned.count("gamma") == 2

    common.tune(spark)
    rows = common.scan(spark.range(2000).coalesce(1), lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long", at_once=8 * 1000).collect()
    assert sum(r["n"] for r in rows) == 2000 and len(rows) == 2


def test_every_plain_character():
    from mnemora.llm import tokens

    bpe = tokens.WordBpe()
    texts = [t for c in map(chr, range(0x260)) for t in (c, f"a{c}b {c}{c}'s {c}1", f" {c}x\n")]
    assert sum(map(bpe._split, texts)) > 1000
    assert [x.tolist() for x in bpe.encode_all(texts)] == [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_caches_end_with_their_task(spark):
    """A worker that waits keeps no vocabulary and no words."""
    import pyarrow as pa

    from mnemora.llm import common, tokens

    def run(batch):
        held = len(tokens._LOADED)
        tokens.loaded().encode("a word")
        return pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows, pa.int64())], ["held"])

    one = common.scan(spark.range(4).coalesce(1), run, "held long")
    assert [{r["held"] for r in one.collect()} for _ in range(12)] == [{0}] * 12


HEAVY = """
import resource, sys
import numpy as np
from mnemora.llm.tokens import loaded

rng = np.random.default_rng(3)
letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
words = ["".join(letters[rng.integers(0, 26, n)]) for n in rng.integers(3, 10, 150_000)]
texts = [" ".join(words[i % len(words)] for i in rng.zipf(1.2, 2_000).tolist()) for _ in range(550)]
bpe = loaded()
bpe.encode("some words")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
size = sum(len(x) for x in bpe.encode_all(texts))
print(sum(map(len, texts)), size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_long_batches():
    """What a worker takes for a batch of many new words stays near its vocabulary's size."""
    out = subprocess.run([sys.executable, "-c", HEAVY], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    chars, size, mb = map(int, out.stdout.split())
    assert chars > 6 << 20 and size > 1 << 20 and mb < 110


def test_words_are_learned_in_slices(monkeypatch):
    """The ids do not depend on how many words the vocabulary sees at once."""
    from mnemora.llm import tokens

    texts = ["one two three four five", "six's (seven) 8 nine-ten Ünï", ""] + ODD
    want = [x.tolist() for x in tokens.WordBpe().encode_all(texts)]
    monkeypatch.setattr(tokens, "LEARN", 2)
    bpe, most = tokens.WordBpe(), []
    told = bpe._told
    monkeypatch.setattr(bpe, "_told", lambda words: (most.append(len(words)), told(words))[1])
    assert [x.tolist() for x in bpe.encode_all(texts)] == want and max(most) == 2 and len(most) > 5


def best_bins(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i] and free[k] not in free[:k]:
                go(i + 1, free[:k] + [free[k] - lengths[i]] + free[k + 1 :])
        go(i + 1, [*free, capacity - lengths[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing(lengths):
    n = np.array(sorted(lengths, reverse=True))
    bins, offsets, free = packing.best_fit(n, 20)
    bound = packing.lower_bound(np.bincount(n, minlength=21), 20)
    assert np.ceil(bound - 1e-9) <= best_bins(lengths, 20) <= len(free)
    for b in range(len(free)):
        at = np.argsort(offsets[bins == b])
        ends = np.r_[0, np.cumsum(n[bins == b][at])]
        assert (offsets[bins == b][at] == ends[:-1]).all() and ends[-1] == 20 - free[b]


def assert_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_exchange(spark):
    """Partitions too small to pack well give the released bins' pieces to the next round."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 3000)
    p = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(p, 100, partition_pieces=300).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000)) and {r["round"] for r in rows} > {0}
    n = assert_packed(rows, 100)
    need = int(np.ceil(packing.lower_bound(np.bincount(lengths, minlength=101), 100) - 1e-9))
    alone = sum(len(packing.best_fit(np.array(sorted(lengths[k::10], reverse=True)), 100)[2]) for k in range(10))
    assert need <= n <= 1.02 * need and n <= alone
    assert packing.pack(p.limit(0), 100).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "lost"), (9003, "word " * 9000), (9003, "word " * 9000)], "doc_id long, text string"))
    rows = packing.pack_documents(docs.withColumn("piece", F.lit(1)).withColumn("rid", F.lit(1))).collect()
    bpe, want = loaded(), []
    for d in docs.collect():
        ids = np.array([*bpe.tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(d["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str) == sorted(want, key=str)
    n = assert_packed(rows, 2048)
    assert n >= -(-sum(w[3] for w in want) // 2048) and n <= rows[0]["partition_bound"] + 1


def test_assembled_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    pieces = packing.token_pieces(docs, keep_ids=True)
    seqs = packing.sequences(packing.pack(pieces.drop("ids")), pieces).collect()
    bpe = loaded()
    assert len(seqs) == 1 and sorted(seqs[0]["ids"]) == sorted([*bpe.encode("a b c").tolist(), 0, *bpe.encode("d").tolist(), 0])


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 180")
    extra = [(5000 + i, None) for i in range(3)] + [(5003, ""), (None, "no id"), (6000, "z" * 300), (6000, "z" * 300)]
    extra += [(7000 + i, "the same text again and again " * 20) for i in range(400 * hot)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sharding.shard_documents(docs.withColumn("size", F.lit(0)).withColumn("shard", F.lit(0)), 8).collect()
    src = docs.collect()
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], key=str) == sorted([(d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in src], key=str)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    load = np.zeros(8)
    slots = {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in rows)
    assert load.max() - load.min() <= biggest
    if not hot:  # equal texts stay together
        where = {}
        for r in rows:
            where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(len(s) == 1 for s in where.values())


def test_no_documents(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_place_follows_all_dimensions():
    items = np.array([[10, 1, 1], [10, 1, 1], [1, 10, 1], [1, 10, 1]], dtype=float)
    shard = sharding.place(items, 2, (1.0, 1.0, 1.0))
    assert sorted(shard[:2]) == [0, 1] and sorted(shard[2:]) == [0, 1]
