"""Exact Jaccard join of word-shingle sets, by set relations.

A set is its shingles' hashes in order.  The order is cut into position
blocks, more of them than two linked sets of near sizes can differ in
shingles, so linked sets agree in several whole blocks; an index list holds
the sets with one content at one block, and a probe skips every other block
and list.  As links share more than one list, each set leaves out as many of
its longest ones as it can spare: what many texts share, such as a common
passage, makes no list where anything else does.

Per list one leader, the set that most lists share, is compared with all
members.  Members linked to it are in one component, and the others' answers
follow from the leader's: by the triangle inequality of the Jaccard distance,
two members whose distances to the leader differ by more than the limit are
no link.  Members of different components are led in turn by each that is
left: marks of half a byte a range of the order bound the difference from
below, and only pairs that pass leave their list and are compared themselves.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, bitmap, distinct_scan, fitted, hit, hold, in_bitmap, rest, scan, text_key, tidy, tune
from mnemora.llm.langid import mix
from mnemora.operators.graph import components

#: Bytes of a signature, signatures counted at once, words whose hashes and sets that a process keeps.
SIG_BYTES, FLUSH, CACHE_WORDS, KEPT_SETS = 5, 1 << 20, 150_000, 64
#: Least and most logarithm of a mark's length; members up to which a list's pairs come from a join, that a task takes together, and of a block of a longer list.
MARK_LEAST, MARK_MOST, SHORT, TASK_ROWS, BLOCK = 6, 14, 6, 1000, 2048
#: Members from which on a list is long, and the part of the most possible differences that blocks exceed it by, to leave long lists out.
LONG, SPARE = 128, 6


class _Words(dict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Words()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles.

    Words are runs of characters other than ASCII white space, A-Z
    lower-cased.  Fewer words than n make one shingle; no words make none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hold("jaccard", _HASHES.clear)
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        out = mix(out * _STEP + h[i : i + len(out)])
    return np.unique(out)


@lru_cache(maxsize=None)
def bands(num: int, den: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Size bands: first sizes, position blocks, blocks that a set may leave out, and sizes up to which it reaches below.

    A band spans two of the greatest ratios of linked sizes, so a set links
    only within its band and a neighbouring one; with the band below only if
    it is no larger than the last number.  Two linked sets, the smaller in
    band r, differ in at most blocks - 1 - spare shingles.
    """
    grow = lambda n: n * den // num  # noqa: E731  the largest set that links with one of n
    first, blocks, spare, below = [1, 2], [], [], [0]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, grow(grow(first[-1] - 1)) + 1))
    for r in range(len(first) - 1):
        a = first[r + 1] - 1
        below.append(grow(a))
        differ = (a + grow(a)) * (den - num) // (den + num)
        free = 0
        if differ:
            for _ in range(3):
                m = differ + 1 + free
                free = int(np.ceil(2 * m * np.exp(-first[r] / m))) + differ // SPARE
        blocks.append(differ + 1 + free)
        spare.append(free)
    return first, blocks, spare, below


def signatures(tokens: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """The set's block contents as hashes of SIG_BYTES bytes, with how many may still be left out.

    They are those in its own band, and in the one below if it reaches there.
    Links share one more than may be left out, so what is left out must be
    first by an order of all signatures: empty blocks are before all others.
    """
    first, blocks, spare, below = bands(num, den)
    own = int(np.searchsorted(first, len(tokens), side="right")) - 1
    total = np.r_[np.uint64(0), np.cumsum(mix(tokens + _STEP), dtype=np.uint64)]
    out = []
    for r in (own, own - 1):
        if r < 0 or (r < own and len(tokens) > below[own]):
            continue
        m = blocks[r]
        edge = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        cut = np.r_[0, np.searchsorted(tokens, edge), len(tokens)]
        empty = np.diff(cut) == 0
        content = total[cut[1:]] - total[cut[:-1]]
        sig = mix(content ^ mix(np.arange(m, dtype=np.uint64) + np.uint64((r + 1) << 32))) & np.uint64((1 << 8 * SIG_BYTES) - 1)
        left = spare[r] - int(empty.sum())
        out.append((sig[~empty], left) if left >= 0 else (sig, 0))
    return out


def without_long(sig: np.ndarray, long: np.ndarray, left: int) -> np.ndarray:
    """Signatures without up to ``left`` of those marked long, the lowest first."""
    at = np.flatnonzero(long)
    return np.delete(sig, at[np.argsort(sig[at], kind="stable")[:left]]) if len(at) and left else sig


def packed(sigs: np.ndarray) -> bytes:
    return sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // SIG_BYTES
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :SIG_BYTES] = np.frombuffer(raw, np.uint8).reshape(n, SIG_BYTES)
    return out.view("<u8").ravel()


def shared_bitmap(sets: DataFrame, total: int, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the signatures (bands), by their last 32 bits, that several sets have.

    Tasks hand on sorted 32-bit values in parts of FLUSH, each value once and
    with a note if it was there twice; a bucket of values is a slice of the
    bitmap and is counted by one task.
    """
    log = int(np.clip(np.ceil(np.log2(max(total, 1) / FLUSH)), 0, bits - 3))

    def parts(batches):
        held: list[np.ndarray] = []

        def flush():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(value, np.arange(1, 1 << log, dtype=np.uint64) << np.uint64(32 - log))
            groups = list(zip(range(1 << log), np.split(value.astype("<u4"), edges), np.split(count > 1, edges), strict=True))
            groups = [g for g in groups if len(g[1])]
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.int32()), pa.array([g[1].tobytes() for g in groups], pa.binary()), pa.array([g[1][g[2]].tobytes() for g in groups], pa.binary())], ["bucket", "once", "more"])

        for batch in batches:
            held.append(unpacked(b"".join(batch.column(0).flatten().to_pylist())) & np.uint64(0xFFFFFFFF))
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if held:
            yield flush()
        rest()

    def count(t: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(t.column("once").to_pylist()), "<u4")
        kinds, n = np.unique(value, return_counts=True)
        again = np.concatenate([kinds[n > 1], np.frombuffer(b"".join(t.column("more").to_pylist()), "<u4")])
        bucket, width = t.column("bucket")[0].as_py(), 1 << (bits - log)
        flags = np.zeros(width, dtype=np.uint8)
        flags[(again >> np.uint32(32 - bits)).astype(np.int64) - bucket * width] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "map": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = len(out) >> log
    for r in sets.select("bands").mapInArrow(parts, "bucket int, once binary, more binary").groupBy("bucket").applyInArrow(tidy(count), "bucket int, map binary").toLocalIterator():
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["map"], dtype=np.uint8)
    return out


def linked_texts(docs: DataFrame, scratch: Scratch, n: int, num: int, den: int, text_col: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every distinct text's set size (key, n_shingles), and links (a, b, common, joint) that connect all linked texts.

    All links of different components of the links returned are ruled out
    exactly; within a component not every link is listed, unless ``every``
    is set: then each link is there, some of them more than once.
    """
    keys = docs.select(text_key(F.col(text_col)).alias("key"))
    copies = scratch.table("copies", keys.groupBy("key").count().filter("count > 1").select(F.xxhash64("key").alias("key")))
    several = scratch.send(bitmap(copies, fitted(copies.count())))

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            tokens = shingles(text, n)
            bands_of = signatures(tokens, num, den) if len(tokens) else []
            for column, value in zip(rows, (len(tokens), [packed(sig) for sig, _ in bands_of], [left for _, left in bands_of], mark(tokens)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["key", "n", "bands", "spare", "mark"])

    sets = scratch.table("sets", distinct_scan(docs, text_col, several, index, "key binary, n long, bands array<binary>, spare array<long>, mark binary"))
    total = (sets.agg(F.sum(F.expr("aggregate(bands, 0L, (s, b) -> s + octet_length(b))"))).first()[0] or 0) // SIG_BYTES
    bits = fitted(total)
    shared = scratch.send(shared_bitmap(sets, total, bits))

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sig = unpacked(b"".join(batch.column(0).flatten().to_pylist()))
        value, count = np.unique(sig[in_bitmap((sig & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits), shared.value)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (value, count)], ["sig", "c"])

    lists = scratch.table("lists", scan(sets.select("bands"), listed, "sig long, c long").groupBy("sig").agg(F.sum("c").alias("c")).filter("c > 1"))
    several_in = scratch.send(bitmap(lists.select(F.col("sig").alias("key")), fitted(lists.count())))
    longest = lists.filter(F.col("c") > LONG).select(F.col("sig").alias("key"))
    long = scratch.send(bitmap(longest, fitted(longest.count())))

    def members(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[list] = [[], [], [], []]
        for key, size, bands_of, spare in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            kept = [without_long(sig, in_bitmap(sig, long.value), left) for sig, left in zip(map(unpacked, bands_of), spare, strict=True)]
            sig = np.concatenate([x[in_bitmap(x, several_in.value)] for x in kept] or [np.zeros(0, np.uint64)]).view(np.int64).tolist()
            for column, value in zip(rows, ([key] * len(sig), [size] * len(sig), sig, [len(sig)] * len(sig)), strict=True):
                column.extend(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "n", "sig", "score"])

    # the leader is the member that most lists share; lists of one member were a bitmap's chance hits
    member = scratch.table("found", scan(sets.select("key", "n", "bands", "spare"), members, "key binary, n long, sig long, score long"))
    heads = member.groupBy("sig").agg(F.max(F.struct("score", "key")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("sig", F.col("lead.key").alias("leader"))
    member = scratch.table("members", member.join(scratch.table("heads", heads), "sig").select("sig", "key", "n", "leader"))
    scratch.drop("found", "lists")
    marks = sets.select("key", "n", "mark")
    pairs = member.filter("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    first = _verify(docs, scratch, _possible(pairs, marks, num, den), n, text_col, "first")
    linked = (F.col("common") * den >= F.col("joint") * num).alias("linked")
    # for every link, each text counts as a component of its own
    m = member
    if not every:
        m = m.join(components(first.filter(linked), scratch.root).withColumnRenamed("node", "key"), "key", "left")
    # lists whose members lie in several components; a leader's own answers are known
    far = 1 - F.col("common") / F.col("joint")
    answers = first.select(F.col("a").alias("leader"), F.col("b").alias("key"), far.alias("far"))
    m = m.withColumn("component", F.xxhash64(F.coalesce("component", "key") if not every else F.col("key"))).join(answers, ["leader", "key"], "left")
    m = scratch.table("open", m.select("sig", "key", "n", "leader", "far", "component"))
    spread = m.groupBy("sig").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most and size > 2")
    m = scratch.table("rest", m.join(scratch.table("spread", spread.select("sig", "size")), "sig").filter("key != leader").select("sig", "key", "n", "far", "component", "size"))
    scratch.drop("members", "open", "heads", "spread")
    short = m.filter(F.col("size") <= SHORT)
    x, y = (short.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "far", "component")]) for s in "xy")
    limit = (den - num) / den + 1e-9
    near = (F.col("key_x") < F.col("key_y")) & (F.col("component_x") != F.col("component_y")) & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num)
    near = near & F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= limit, F.lit(True))
    closer = _possible(x.join(y, "sig").filter(near).select(F.col("key_x").alias("a"), F.col("key_y").alias("b")).distinct(), marks, num, den)
    closer = closer.unionByName(_within(scratch, m.filter(F.col("size") > SHORT), marks, num, den)).distinct()
    second = _verify(docs, scratch, closer, n, text_col, "second")
    links = scratch.table("links", first.unionByName(second).filter(linked))
    sizes = scratch.table("sizes", sets.select("key", F.col("n").alias("n_shingles")))
    scratch.close("links", "sizes")
    return sizes, links


def mark(tokens: np.ndarray) -> bytes:
    """Half a byte for each of 2**k equal ranges of the order, 2**k being half to all of the set's size: the sum of its tokens' hashes.

    Ranges whose sums differ hold different shingles, so their number is no
    more than the sets' symmetric difference.  Adding neighbours gives the
    mark of half as many ranges.  Sets that link differ in two ninths of a
    set's size at a limit of 0.8, so the ranges of sets that share nothing
    are always more than that, whatever the sizes that meet.
    """
    k = int(np.clip(np.ceil(np.log2(max(len(tokens), 1))) - 1, MARK_LEAST, MARK_MOST))
    sums = np.bincount((tokens >> np.uint64(64 - k)).astype(np.int64), weights=(mix(tokens) & np.uint64(0xF)).astype(np.float64), minlength=1 << k)
    sums = (sums.astype(np.int64) & 0xF).astype(np.uint8)
    return (sums[0::2] | sums[1::2] << 4).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A mark's sums over ``size`` ranges."""
    b = np.frombuffer(raw, np.uint8)
    return np.stack([b & 0xF, b >> 4], axis=1).reshape(size, -1).sum(axis=1, dtype=np.uint8) & 0xF


def alike(ma: bytes, mb: bytes, both: int, num: int, den: int) -> bool:
    """Whether marks, at as many ranges as both have, allow a link of sets of ``both`` shingles together."""
    size = 2 * min(len(ma), len(mb))
    return int((folded(ma, size) != folded(mb, size)).sum()) <= both * (den - num) // (den + num)


def _possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and marks do not rule out."""
    both = pairs.join(marks.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("mb")), "b").join(marks.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("mark").alias("ma")), "a")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for na, nb, ma, mb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")), strict=True):
            keep.append(min(na, nb) * den >= max(na, nb) * num and alike(ma, mb, na + nb, num, den))
        return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return scan(both.select("a", "b", "na", "nb", "ma", "mb"), run, "a binary, b binary")


def led(size: np.ndarray, component: np.ndarray, far: np.ndarray, grid: np.ndarray, block: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of one list's members, each in turn leading those after it, that nothing rules out."""
    out = []
    limit = (den - num) / den + 1e-9
    for i in range(len(size) - 1):
        j = np.arange(i + 1, len(size))
        ok = (component[j] != component[i]) & (np.minimum(size[j], size[i]) * den >= np.maximum(size[j], size[i]) * num) & ~(np.abs(far[j] - far[i]) > limit)
        j = j[ok if block is None else ok & (block[j] != block[i])]
        if len(j):
            j = j[(grid[j] != grid[i]).sum(axis=1) <= (size[j] + size[i]) * (den - num) // (den + num)]
            out.extend((i, k) for k in j.tolist())
    return out


def _within(scratch: Scratch, members: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in lists, that leaders' answers, sizes and marks do not rule out.

    A list of more than BLOCK members is dealt into blocks, and each pair of
    blocks is compared by itself; a task takes many short lists together.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), n).cast("int")
    m = members.select("sig", "key", "n", "far", "component", n.alias("blocks"), mine.alias("mine"))
    m = m.join(marks.select("key", "mark"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    groups = 1 + members.count() // TASK_ROWS
    m = m.withColumn("g", F.pmod(F.xxhash64("sig", "low", "high"), F.lit(groups)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        sig, low, high = (t.column(c).to_numpy() for c in ("sig", "low", "high"))
        order = np.lexsort((high, low, sig))
        cut = np.flatnonzero(np.r_[True, (np.diff(sig[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0), True])
        size, component, mine = (t.column(c).to_numpy() for c in ("n", "component", "mine"))
        far = t.column("far").to_numpy(zero_copy_only=False).astype(np.float64)
        keys, raw = t.column("key").to_pylist(), t.column("mark").to_pylist()
        pairs = set()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = order[lo:hi]
            width = 2 * min(len(raw[i]) for i in at.tolist())
            grid = np.stack([folded(raw[i], width) for i in at.tolist()])
            split = mine[at] if low[at[0]] != high[at[0]] else None
            for i, k in led(size[at], component[at], far[at], grid, split, num, den):
                i, k = int(at[i]), int(at[k])
                # the list's least set may have fewer ranges than these two
                if 2 * min(len(raw[i]), len(raw[k])) == width or alike(raw[i], raw[k], int(size[i] + size[k]), num, den):
                    pairs.add((min(keys[i], keys[k]), max(keys[i], keys[k])))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return m.drop("other", "blocks").groupBy("g").applyInArrow(run, "a binary, b binary")


def _verify(docs: DataFrame, scratch: Scratch, pairs: DataFrame, n: int, text_col: str, name: str) -> DataFrame:
    """Exact overlap and union of pairs (a, b) of text keys: (a, b, common, joint).

    Texts, which compress, are what is moved; a task keeps the sets of the
    texts it saw last.
    """
    pairs = scratch.table(f"{name}_pairs", pairs)
    schema = "a binary, b binary, common long, joint long"
    if pairs.isEmpty():
        return scratch.spark.createDataFrame([], schema)
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    only = scratch.send(bitmap(wanted.select(F.xxhash64("key").alias("key")), fitted(2 * pairs.count())))
    d = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = scratch.table(f"{name}_texts", d.filter(hit(only, F.xxhash64("key"))).groupBy("key").agg(F.first("text").alias("text")))
    both = pairs.join(t.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(t.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")

    def overlaps(batches):
        kept: dict[bytes, np.ndarray] = {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) >= KEPT_SETS:
                    del kept[next(iter(kept))]
                kept[key] = shingles(text, n)
            return kept[key]

        for batch in batches:
            common, joint = [], []
            for ka, kb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                a, b = of(ka, ta), of(kb, tb)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                common.append(int((b[at] == a).sum()) if len(b) else 0)
                joint.append(len(a) + len(b) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(joint, pa.int64())], ["a", "b", "common", "joint"])
        rest()

    out = scratch.table(name, both.mapInArrow(overlaps, schema))
    scratch.drop(f"{name}_texts")
    return out


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: the text of each row (doc_id, key, n_shingles), and every link (a, b, common, joint) of different texts.

    Links are between keys, a < b, each once, with the exact overlap and union
    of the shingle sets; rows of one key have one text, so their links follow.
    Texts without words link with nothing.  ``groups`` is a view of it that
    needs fewer comparisons.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "join")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes, links = linked_texts(d, scratch, n, num, den, every=True)
    rows = d.select("doc_id", text_key(F.col("text")).alias("key")).join(sizes, "key").select("doc_id", "key", "n_shingles")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "joint")
    return rows, links.dropDuplicates(["a", "b"])


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's set size and component: (doc_id, n_shingles, component_id).

    Texts link where den * intersection >= num * union of their shingle sets;
    the component is the smallest id reachable by links, the row's own
    included.  Null, empty and blank texts have no set and link with nothing.
    Null ids take no part in the smallest id and are null where a component
    has no other; rows that repeat an id are nodes of their own text.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "jaccard")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes, links = linked_texts(d, scratch, n, num, den)
    found = components(links, scratch.root)
    ids = d.select("doc_id", text_key(F.col("text")).alias("key")).join(sizes, "key")
    ids = scratch.table("ids", ids.join(found, ids["key"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "key").alias("component")))
    # written, so that the join deals out both sides itself and a large component can be split
    least = scratch.table("least", ids.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least")))
    out = ids.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: one row of each group stays.

    It is the one of the smallest doc_id, null ids last; of rows that repeat
    its id and text any one.  Rows without words all stay.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "near")
    sizes, links = linked_texts(docs, scratch, n, num, den, text_col)
    found = components(links, scratch.root)
    near = "near"
    while any(c.startswith(near) for c in docs.columns):
        near = "_" + near
    key, doc = text_key(F.col(text_col)), F.col("doc_id").cast("long")
    slim = docs.select(doc.alias("doc_id"), key.alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("c"))
    slim = slim.join(sizes.filter("n_shingles > 0"), "key").join(found, F.col("key") == F.col("node"), "left")
    slim = scratch.table("rows", slim.select("doc_id", "key", F.coalesce("component", "key").alias("component"), "c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    chosen = scratch.table("chosen", slim.groupBy("component").agg(first, F.sum("c").alias("rows")).filter("rows > 1"))
    judged = slim.join(chosen, "component").select("c", F.col("doc_id").alias(f"{near}_id"), F.col("key").alias(f"{near}_key"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("stays"))
    judged = scratch.table("judged", judged)

    def marked(rows: DataFrame):
        return spark.sparkContext.broadcast(bitmap(rows.select(F.xxhash64(f"{near}_id", f"{near}_key").alias("key")), fitted(rows.count())))

    # only rows with a dropped row's bit are joined, and only a kept row that is repeated is dealt by its id
    dropped = judged.filter("not stays").select(f"{near}_id", f"{near}_key")
    some = hit(marked(dropped), F.xxhash64(doc, key))
    out = docs.filter(~some).unionByName(docs.filter(some).join(dropped, doc.eqNullSafe(F.col(f"{near}_id")) & (key == F.col(f"{near}_key")), "left_anti"))
    repeated = judged.filter("stays and c > 1")
    if repeated.isEmpty():
        return out
    some = hit(marked(repeated), F.xxhash64(doc, key))
    return out.filter(~some).unionByName(out.filter(some).dropDuplicates(["doc_id", text_col]))
