"""Removal of repeated substrings by prefix-free parsing.

A window of ``window`` symbols is repeated if it starts at two places of the
corpus; symbols are a text's UTF-8 bytes, or the codes of its words.  A
rolling hash marks triggers, and triggers cut texts into phrases.  A window is
a suffix of the phrase that it starts in, up to its first trigger, and a prefix
of the parse that follows, so windows are equal where phrase suffix and parse
are, with the trigger at one distance from their starts.

Windows are taken together by their trigger and a range of that distance.  The
core of such a unit is what all its windows hold, its hull all that they
cover.  Cores and hulls get names (hashes), and names are counted: a unit whose
core is unique has no repeated window; one whose hull is not unique has no
other; the rest, where a repeat ends, is named again in smaller ranges with
the core's name in place of its symbols, as in prefix doubling, down to single
windows.  One of each settled hull goes along where such a unit shares its core.  Names stand in for the ranks that suffix arrays of dictionary and
parse would give: only equality is asked for, and names are counted where they
arise, while the sorted order brings all occurrences of a frequent phrase into
one task.  Nothing but names and the ends of repeats is shuffled.

Windows without a trigger of the first rolling hash take the second, denser
one, and without that are units of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, bitmap, dealt, distinct_scan, fitted, flags, gathered, hold, in_bitmap, scan, text_key, tidy, tune
from mnemora.llm.langid import mix

WINDOW = 400
#: Symbols hashed at once; a longer text is cut into overlapping stretches.
CHUNK = 1 << 18
#: Least and most logarithm of the bits of bitmaps of names; they filter, so fuller ones cost time and change no result.
LEAST_BITS, MOST_BITS = 16, 28
#: Names that a task counts together.
TASK_NAMES = 1 << 19
#: Bytes of a word's code, and words whose codes a process keeps.
CODE, CACHE_WORDS = 8, 40_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_WORD = re.compile(rb"[^ \t\n\x0b\f\r]+")
_POWERS: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Parse:
    """A window, the length of trigger strings, one in how many is a trigger of either hash, and the ranges of distances."""

    window: int
    trigger: int
    every: tuple[int, int]
    ranges: tuple[int, ...]
    words: bool = False

    @property
    def reach(self) -> int:
        """The greatest distance of a window's first trigger from its start."""
        return self.window - self.trigger


def parse_of(window: int, words: bool = False) -> Parse:
    """Triggers and ranges fitted to a window: about a third of it lies between two triggers, ranges fall to 1 by sixteens."""
    trigger = max(1, min(2 if words else 16, window // 4))
    every = 1 << max(1, int(np.log2(max(2, window / 3))))
    ranges = [every]
    while ranges[-1] > 1:
        ranges.append(max(1, ranges[-1] // 16))
    return Parse(window, trigger, (every, max(2, every // 8)), tuple(ranges), words)


class _Codes(dict):
    """Word -> its code, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def _forget() -> None:
    _POWERS.clear()
    _CODES.clear()


def symbols(text: str, words: bool) -> np.ndarray:
    """A text's bytes, or the codes of its words, which are runs of characters other than ASCII white space."""
    if not words:
        return np.frombuffer(text.encode(), np.uint8)
    hold("substrings", _forget)
    if len(_CODES) > CACHE_WORDS:
        _CODES.clear()
    own = text.encode().split()
    return np.fromiter(map(_CODES.__getitem__, own), np.uint64, len(own))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    hold("substrings", _forget)
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 2 * WINDOW)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the name of any substring follows."""
    value = _BYTES[data] if data.dtype == np.uint8 else mix(data + _STEP)
    return np.r_[np.uint64(0), np.cumsum(value * _powers(len(data))[0], dtype=np.uint64)]


def names(total: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """64-bit names of substrings: equal strings have equal names."""
    down = _powers(len(total))[1]
    return mix((total[start + length] - total[start]) * down[start] + np.asarray(length, np.uint64).reshape(-1) * _STEP)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """The name of every k neighbours, by one multiplication a symbol."""
    n = len(data) - k + 1
    return names(sums(data), np.arange(n), k) if n > 0 else np.zeros(0, np.uint64)


def stretches(texts: list[np.ndarray], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in arrays of about CHUNK symbols: data, numbers of the texts, offsets in them, begins (and the end)."""
    parts: list[np.ndarray] = []
    number: list[int] = []
    offset: list[int] = []
    size = 0

    def flush():
        edges = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts), np.array(number), np.array(offset), edges

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), CHUNK):
            part = text[at : at + CHUNK + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > CHUNK + window:
                yield flush()
                parts, number, offset, size = [], [], [], 0
            parts.append(part)
            number.append(i)
            offset.append(at)
            size += len(part)
    if parts:
        yield flush()


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated ``count`` times, and the values from ``first`` on."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + first[rows]


def anchored(lo: np.ndarray, hi: np.ndarray, triggers: np.ndarray, reach: int):
    """Of window starts in the ranges [lo, hi]: units (trigger, first, last start) by first trigger, and the ranges left without one."""
    f, last = np.searchsorted(triggers, lo), np.searchsorted(triggers, hi)
    rows, at = _spread(f, last - f + 1)  # the one past the last may be missing or too far
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3, (lo, hi)
    ends = np.r_[triggers, np.int64(1) << 60]
    t = ends[at]
    first = np.where(at > f[rows], np.r_[triggers, 0][np.maximum(at, 1) - 1] + 1, lo[rows])
    end = np.minimum(hi[rows], t)
    near = np.maximum(first, t - reach)
    some, rest = near <= end, (first < near) & (first <= end)
    return (t[some], near[some], end[some]), (first[rest], np.minimum(end, near - 1)[rest])


def units(data: np.ndarray, edges: np.ndarray, p: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each unit's trigger, first and last start, least distance of its range, and core's and hull's names."""
    total = sums(data)
    h = names(total, np.arange(len(data) - p.trigger + 1), p.trigger)
    lo, hi = edges[:-1], edges[1:] - p.window
    found = []
    for every in p.every:
        own, (lo, hi) = anchored(lo, hi, np.flatnonzero(h & np.uint64(every - 1) == 0), p.reach)
        found.append(own)
    _, alone = _spread(lo, hi - lo + 1)
    t, first, last = (np.concatenate(x) for x in zip(*found, (alone, alone, alone), strict=True))
    g = p.ranges[0]
    low = (t - last) // g
    rows, k = _spread(low, (t - first) // g - low + 1)
    t, a = t[rows], k * g
    first, last = np.maximum(first[rows], t - a - g + 1), np.minimum(last[rows], t - a)
    core = names(total, t - a, a + p.window - np.minimum(a + g - 1, p.reach))
    return t, first, last, a, core, names(total, first, last - first + p.window)


def _runs(number: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, those that continue each other in one text being one."""
    if not len(first):
        return number, first, last
    order = np.lexsort((first, number))
    number, first, last = number[order], first[order], last[order]
    cut = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (first[1:] != last[:-1] + 1)])
    return number[cut], first[cut], last[np.r_[cut[1:], len(last)] - 1]


def _within(total: np.ndarray, core: np.ndarray, start: np.ndarray, before: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of substrings around a core whose name stands for its symbols: ``length`` others, ``before`` of them before it."""
    return mix(names(total, start, length) ^ mix(core + before.astype(np.uint64) * _STEP + np.uint64(1)))


@dataclass
class Units:
    """Units of a level: window starts [first, last] whose trigger t is a or more after them, and the symbols around the core."""

    row: np.ndarray  # where the unit comes from
    t: np.ndarray
    a: np.ndarray
    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    hull: np.ndarray
    data: np.ndarray
    left: np.ndarray  # places in data: of the hull's begin, the core's begin and end without it, and the hull's end
    begin: np.ndarray
    end: np.ndarray
    right: np.ndarray

    def sides(self, rows: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The symbols that hulls have before and after their cores."""
        raw, s = self.data.tobytes(), self.data.itemsize
        cut = lambda x, y: [raw[i:j] for i, j in zip((x[rows] * s).tolist(), (y[rows] * s).tolist(), strict=True)]
        return cut(self.left, self.begin), cut(self.end, self.right)


def smaller(batch: pa.RecordBatch, p: Parse, level: int) -> Units:
    """Units of one level, as rows, in the ranges of the next one."""
    t, a, first, last, core = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "a", "first", "last", "core"))
    sides = [batch.column(c).to_pylist() for c in ("left", "right")]
    data = np.frombuffer(b"".join(x for pair in zip(*sides, strict=True) for x in pair), np.uint64 if p.words else np.uint8)
    n = np.array([[len(x) for x in side] for side in sides]) // data.itemsize
    middle = np.cumsum(n.sum(axis=0)) - n[1]
    g, cap = p.ranges[level], np.minimum(a + p.ranges[level - 1] - 1, p.reach)
    low = (t - last) // g
    rows, k = _spread(low, (t - first) // g - low + 1)
    low = k * g
    t, a, cap, middle = t[rows], a[rows], cap[rows], middle[rows]
    near, far = np.maximum(low, t - last[rows]), np.minimum(low + g - 1, t - first[rows])
    left, begin = middle - (far - a), middle - (low - a)
    end, right = middle + cap - np.minimum(low + g - 1, p.reach), middle + cap - near
    total = sums(data)
    own = core.view(np.uint64)[rows]
    hull = _within(total, own, left, far - a, right - left)
    new = _within(total, own, begin, low - a, end - begin) if g > 1 else hull
    return Units(rows, t, low, t - far, t - near, new, hull, data, left, begin, end, right)


#: Kinds of rows: a run of repeated windows, a unit to be cut smaller, and one that stands for settled units in the counts.
RUN, OPEN, SETTLED = 0, 1, 2
_UNIT = "kind int, key binary, t long, a long, first long, last long, core long, left binary, right binary, name long"
_KINDS = dict(zip([f.split()[0] for f in _UNIT.split(", ")], [pa.int32(), pa.binary(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64()], strict=True))


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns not given are null."""
    given = {"kind": np.full(n, kind, np.int32)} | columns
    arrays = [x if isinstance(x := given.get(c), pa.Array) else pa.nulls(n, k) if x is None else pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x, k) for c, k in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_KINDS))


def _judged(u: Units, keys: pa.Array, real: np.ndarray, settled: np.ndarray, dead: np.ndarray, needed: np.ndarray, move: np.ndarray | int) -> pa.RecordBatch:
    """A level's rows: runs of settled units, open ones, and one settled unit of a name where its core is needed; ``real`` ones have keys."""
    run = np.flatnonzero(settled & real)
    which, lo, hi = _runs(u.row[run], (u.first + move)[run], (u.last + move)[run])
    open_ = np.flatnonzero(~settled & real & ~dead)
    stands = np.flatnonzero(needed & (settled | ~real))
    stands = stands[np.unique(u.hull[stands], return_index=True)[1]]
    out = [_rows(RUN, len(which), key=keys.take(pa.array(which)), first=lo, last=hi)]
    for kind, at in ((OPEN, open_), (SETTLED, stands)):
        left, right = u.sides(at)
        key = {"key": keys.take(pa.array(u.row[at]))} if kind == OPEN else {}
        out.append(_rows(kind, len(at), t=(u.t + move)[at], a=u.a[at], first=(u.first + move)[at], last=(u.last + move)[at], core=u.core[at], left=pa.array(left, pa.binary()), right=pa.array(right, pa.binary()), name=u.hull[at], **key))
    return pa.concat_batches(out)


def _size(n: int) -> tuple[int, int]:
    """Logarithms of a bitmap's bits and of the tasks that count, for about n names."""
    bits = fitted(n, 8, LEAST_BITS, MOST_BITS)
    return bits, int(np.clip(np.ceil(np.log2((n + 1) / TASK_NAMES)), 3, min(12, bits - 3)))


def _named(h: np.ndarray, size: tuple[int, int], *more: np.ndarray) -> pa.RecordBatch:
    """Names, and what goes with them, by bucket; a name that is there more often comes twice, and ``extra`` counts the rest."""
    bits, log = size
    value, at, count = np.unique(h, return_index=True, return_counts=True)
    bucket = lambda x: (x & np.uint64((1 << bits) - 1)) >> np.uint64(bits - log)
    extra = np.bincount(bucket(value).astype(np.int64), weights=np.maximum(count - 2, 0), minlength=1 << log).astype(np.int64)
    at = np.concatenate([at, at[count > 1]])
    out = dealt(bucket(h[at]), log, np.stack([x[at] for x in (h, *more)], axis=1))
    return out.append_column("extra", pa.array(extra[out.column(0).to_numpy()]))


def _counted(named: DataFrame, size: tuple[int, int], width: int) -> DataFrame:
    """Names counted by bucket: slices of bitmaps of those there once and more often, what goes with single ones, and how often the others are there."""
    bits, log = size

    def count(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("raw").to_pylist()), "<u8").reshape(-1, width)
        x = x[np.argsort(x[:, 0], kind="stable")]
        first = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
        single = np.diff(np.r_[first, len(x)]) == 1
        at = x[first, 0] & np.uint64((1 << (bits - log)) - 1)
        out = [flags(at[single], 1 << (bits - log)), flags(at[~single], 1 << (bits - log)), x[first[single], -1].tobytes()]
        n = len(x) - int(single.sum()) + sum(t.column("extra").to_pylist())
        columns = {c: pa.array([v], pa.binary()) for c, v in zip(("once", "again", "key"), out, strict=True)}
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32())} | columns | {"n": pa.array([n], pa.int64())})

    return named.groupBy("bucket").applyInArrow(tidy(count), "bucket int, once binary, again binary, key binary, n long")


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW, by_words: bool = False, parse: Parse | None = None) -> DataFrame:
    """Repeated windows of the whole table: (key, spans), a span being a run of window starts of the text of that key.

    A text of several rows is repeated in all its windows.  With ``by_words``
    the windows and spans are of words.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "substrings")
    p = parse or parse_of(window, by_words)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")) if by_words else F.octet_length(text)
    sizes = docs.select(text_key(F.col(text_col)).alias("key"), size.alias("size")).groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    sizes = scratch.table("sizes", sizes)
    copies = sizes.filter("n > 1")
    symbols_in, texts = sizes.agg(F.sum("size"), F.count("*")).first()
    several = scratch.send(bitmap(copies.select(F.xxhash64("key").alias("key")), _size(texts)[0]))
    # a range ends with each trigger, and a range's length after the last end
    about = _size(2 * (symbols_in or 0) // p.ranges[0] + texts)
    named = "bucket int, raw binary, extra long"

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[Units, np.ndarray]]:
        for data, number, offset, edges in stretches([symbols(t, by_words) for t in batch.column(1).to_pylist()], window):
            t, first, last, a, core, hull = units(data, edges, p)
            which = np.searchsorted(edges, first, side="right") - 1
            yield Units(number[which], t, a, first, last, core, hull, data, first, t - a, t + window - np.minimum(a + p.ranges[0] - 1, p.reach), last + window), (offset - edges[:-1])[which]

    def cores(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [u.core for u, _ in cut(batch)]
        return _named(np.concatenate(found), about) if found else None

    counts = scratch.table("cores", _counted(distinct_scan(docs, text_col, several, cores, named), about, 1))
    shared = scratch.send(gathered(counts, "again", about[1], about[0]))
    # only units of shared cores have their hulls counted
    few = _size(counts.agg(F.sum("n")).first()[0] or 0)

    def hulls(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(u.hull[some], u.core[some]) for u, _ in cut(batch) if (some := in_bitmap(u.core, shared.value)).any()]
        if not found:
            return None
        hull, core = (np.concatenate(x) for x in zip(*found, strict=True))
        return _named(hull, few, core)

    def marks(table: str, named_rows: DataFrame, size: tuple[int, int]):
        """The counted hulls, and bitmaps of those there once and of their cores."""
        counts = scratch.table(table, _counted(named_rows, size, 2))
        return counts, scratch.send(gathered(counts, "once", size[1], size[0])), scratch.send(bitmap(counts, size[0]))

    _, once, needed = marks("hulls", distinct_scan(docs, text_col, several, hulls, named), few)

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for u, move in cut(batch):
            some = np.flatnonzero(in_bitmap(u.core, shared.value))
            u = Units(*(getattr(u, f.name) if f.name == "data" else getattr(u, f.name)[some] for f in fields(Units)))
            settled, real = ~in_bitmap(u.hull, once.value), np.ones(len(some), bool)
            out.append(_judged(u, batch.column(0), real, settled, ~real, in_bitmap(u.core, needed.value), move[some]))
        return pa.concat_batches(out) if out else None

    done = [scratch.table("settled0", distinct_scan(docs, text_col, several, settle, _UNIT))]
    scratch.drop("cores", "hulls")
    for level in range(1, len(p.ranges)):
        unit = [c for c in done[-1].columns if c != "name"]
        stand = done[-1].filter(F.col("kind") == SETTLED).groupBy("name").agg(F.first(F.struct(*unit)).alias("u")).select("u.*")
        rest = scratch.table(f"open{level}", done[-1].filter(F.col("kind") == OPEN).select(unit).unionByName(stand))
        size = _size(rest.count() * min(8, p.ranges[level - 1] // p.ranges[level]))
        last = p.ranges[level] == 1

        def hulls_of(batch: pa.RecordBatch, level: int = level, size=size) -> pa.RecordBatch:
            u = smaller(batch, p, level)
            twice = np.r_[np.arange(len(u.row)), np.flatnonzero((batch.column(0).to_numpy() == SETTLED)[u.row])]
            return _named(u.hull[twice], size, u.core[twice])

        def cores_of(batch: pa.RecordBatch, level: int = level, size=size) -> pa.RecordBatch:
            u = smaller(batch, p, level)
            return _named(u.core[np.r_[np.arange(len(u.row)), np.flatnonzero((batch.column(0).to_numpy() == SETTLED)[u.row])]], size)

        counts, once, needed = marks(f"hulls{level}", scan(rest, hulls_of, named), size)
        if not last:  # the hulls of single windows are their cores
            counts = scratch.table(f"cores{level}", _counted(scan(rest, cores_of, named), size, 1))
        again = scratch.send(gathered(counts, "again", size[1], size[0]))

        def judge(batch: pa.RecordBatch, level: int = level, last: bool = last, once=once, again=again, needed=needed) -> pa.RecordBatch:
            u = smaller(batch, p, level)
            settled, dead = ~in_bitmap(u.hull, once.value), ~in_bitmap(u.core, again.value)
            # a unit that only a bitmap's chance hit leaves open needs its settled twin as well
            wanted = ~settled & ~dead if last else in_bitmap(u.core, needed.value) | ~settled
            return _judged(u, batch.column(1), (batch.column(0).to_numpy() == OPEN)[u.row], settled, dead, wanted, 0)

        done.append(scratch.table(f"settled{level}", scan(rest, judge, _UNIT)))
        scratch.drop(f"open{level}", f"hulls{level}", f"cores{level}")
    # single windows that bitmaps cannot tell apart are counted by themselves
    unclear = done[-1].filter(F.col("kind") != RUN)
    twice = unclear.groupBy("name").agg(F.sum(F.col("kind")).alias("n")).filter("n > 1").select("name")
    runs = [d.filter(F.col("kind") == RUN) for d in done] + [unclear.filter(F.col("kind") == OPEN).join(scratch.table("twice", twice), "name", "left_semi")]
    whole = copies.filter(F.col("size") >= window).select("key", F.lit(0).cast("long").alias("lo"), (F.col("size") - window).cast("long").alias("hi"))
    for r in runs:
        whole = whole.unionByName(r.select("key", F.col("first").alias("lo"), F.col("last").alias("hi")))
    spans = scratch.table("spans", whole.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    scratch.close("spans")
    return spans


def merged(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [begin, end) of runs of window starts; touching ones are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + window))
        else:
            out.append((lo, hi + window))
    return out


def passages(spans: list[dict], raw: bytes, words: int) -> list[tuple[int, int]]:
    """Byte runs [begin, end) of a text in which repeated runs of ``words`` words lie, from the spans of its words."""
    places = [m.span() for m in _WORD.finditer(raw)]
    return [(places[s["lo"]][0], places[s["hi"] + words - 1][1]) for s in spans]


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch or overlap being one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its removed runs."""
    if not runs:
        return raw
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def with_spans(docs: DataFrame, text_col: str, spans: DataFrame, process: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema) -> DataFrame:
    """``process`` of every batch of ``docs`` and its rows' repeated ``spans`` (key, spans).

    Only rows whose text has repeats, by a bitmap of their keys, are joined
    with the spans; the others have none.
    """
    near = "spans"
    while any(c.startswith(near) for c in docs.columns):
        near = "_" + near
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("key").alias("key")), fitted(spans.count())))
    d = docs.withColumn(f"{near}_key", text_key(F.col(text_col))).withColumn(f"{near}_hash", F.xxhash64(f"{near}_key"))
    own = docs.columns

    def part(batch: pa.RecordBatch, some: bool) -> pa.RecordBatch | None:
        mask = in_bitmap(batch.column(f"{near}_hash").to_numpy(zero_copy_only=False), touched.value) == some
        return batch.filter(pa.array(mask)) if mask.any() else None

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rest = part(batch, False)
        return process(rest.select(own), [None] * rest.num_rows) if rest is not None else None

    spans = spans.select(F.col("key").alias(f"{near}_of"), F.col("spans").alias(near))
    joined = scan(d, lambda b: part(b, True), d.schema).join(spans, F.col(f"{near}_key") == F.col(f"{near}_of"), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in own], near)
    return scan(d, plain, schema).unionByName(scan(joined, lambda b: process(b.select(own), b.column(near).to_pylist()), schema))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What removal does to each document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Null text counts as empty; null ids stay null; rows of equal texts of at
    least ``window`` bytes lose everything.
    """

    def run(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = []
        for text, own in zip(batch.column("text").to_pylist(), spans, strict=True):
            raw, runs = (text or "").encode(), merged(own, window)
            left = kept(raw, runs)
            rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
        a, b, c, e = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(e)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(d, "text", repeated_spans(d, "text", window), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, words: int = 0) -> DataFrame:
    """``docs``, all rows and columns, with repeated windows cut from the text.

    With ``words``, passages of that many words that start at two places or
    more are cut as well, however few bytes they have.  Bytes of a character
    that is cut in two go as well.  A column n_chars, if there, is set to the
    new length; null texts stay null.
    """

    def left(text: str, spans: list[dict]) -> str:
        raw = text.encode()
        runs = merged([s for s in spans if not s["coded"]], window)
        if own := [s for s in spans if s["coded"]]:
            runs = joined(runs + passages(own, raw, words))
        return kept(raw, runs).decode("utf-8", "ignore")

    def run(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        place = batch.schema.get_field_index(text_col)
        texts = [left(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), spans, strict=True)]
        return batch.set_column(place, text_col, pa.array(texts, pa.string()))

    def marked(spans: DataFrame, coded: bool) -> DataFrame:
        return spans.select("key", F.transform("spans", lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.lit(coded).alias("coded"))).alias("spans"))

    spans = marked(repeated_spans(docs, text_col, window), False)
    if words:
        spans = spans.unionByName(marked(repeated_spans(docs, text_col, words, by_words=True), True))
        spans = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = with_spans(docs, text_col, spans, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
