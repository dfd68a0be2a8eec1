"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` ids.  Each partition of
pieces is packed best-fit decreasing; dual feasible functions bound from below
the bins that any packing of it needs.  A partition whose bins exceed that
bound releases its emptiest bins; released documents of several partitions
are exchanged, that is dealt together, and packed again, until nothing is
released or one partition is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, scan, tidy, tune
from mnemora.llm.tokens import DEFAULT, SPAN, loaded

CAPACITY = 2048
#: Pieces that one task packs; bounds its memory.
PARTITION_PIECES = 150_000
#: Bins that a partition releases for each bin of its gap, and one lot besides.
RELEASE = 32
#: Exchanges after which the last packing stands.
ROUNDS = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids, with ``end_id`` after them, into pieces of ``capacity``; the last may be shorter.

    Null text counts as empty and gives one piece of one id; null ids stay
    null; repeated rows give repeated pieces.  With ``keep_ids`` the ids come
    along as ``ids array<int>``.
    """
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(vocabulary)
        last = np.array([end_id], dtype="<u4").tobytes()
        rows: list[list] = [[] for _ in range(5 + keep_ids)]
        texts = batch.column(1).to_pylist()
        kinds = list(dict.fromkeys(texts))
        seen = {text: ids.tobytes() + last for text, ids in zip(kinds, bpe.encode_all([text or "" for text in kinds]), strict=True)}
        for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            ids = seen[text]
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row = (key, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if keep_ids else []))
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, types, strict=False)], names[: len(rows)])

    return scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, PIECES + ", ids array<int>" * keep_ids, at_once=SPAN * 3 // 4)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """The least number of bins, before rounding up, that dual feasible functions prove for counts of each length.

    The functions: the identity; for each e up to half the capacity, lengths
    over capacity - e count as full and those under e as nothing; and for
    k = 1..40 the step function that rounds (k + 1) x / capacity down.
    """
    n = np.asarray(counts, dtype=np.float64)
    x = np.arange(len(n), dtype=np.int64)
    tokens = np.cumsum(n * x)
    items = np.cumsum(n)
    best = tokens[-1] / capacity
    e = np.arange(1, capacity // 2 + 1)
    full = items[-1] - items[np.minimum(capacity - e, len(n) - 1)]
    middle = tokens[np.minimum(capacity - e, len(n) - 1)] - tokens[e - 1]
    best = max(best, float(np.max(full + middle / capacity, initial=0)))
    for k in range(1, 41):
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, x / capacity, (scaled // capacity) / k)
        best = max(best, float((f * n).sum()))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of lengths in the order given: each item's bin and its offset there, and the bins' free space."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r is set where a bin with r free places is open
    for i, n in enumerate(lengths.tolist()):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                open_ &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - n
        if left:
            by_free[left].append(b)
            open_ |= 1 << left
    return bins, offsets, np.array(free, dtype=np.int64)


_OUT = PIECES + ", rid long, bin long, offset long, partition_bins long, partition_bound long, released boolean"


def _packer(capacity: int, final: bool):
    def run(t: pa.Table) -> pa.Table:
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column("rid").to_numpy(), -length))
        t, length = t.take(pa.array(order)), length[order]
        bins, offsets, free = best_fit(length, capacity)
        need = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        bound = int(np.ceil(need - 1e-9))
        loose = np.zeros(len(free), dtype=bool)
        if not final and len(free) - need > 1e-6:
            gap = len(free) - bound
            at = np.argsort(-free, kind="stable")[: RELEASE * (gap + 1)]
            loose[at[free[at] > 0]] = True
        out = t.select(["doc_id", "piece", "start", "length", "ids_crc32", "rid"])
        for name, column in (("bin", bins), ("offset", offsets), ("partition_bins", np.full(len(bins), len(free))), ("partition_bound", np.full(len(bins), bound)), ("released", loose[bins])):
            out = out.append_column(name, pa.array(column))
        return out

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pack pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``capacity``.

    Adds sequence_id, offset, and the certificate of the partition that last
    packed the piece: round, partition_bins and partition_bound.  Pieces of
    equal length are taken in the order they were written.  Lengths lie in
    1..capacity; an empty input gives no rows.
    """
    spark = pieces.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    rest = scratch.table("pieces", pieces.withColumn("rid", F.monotonically_increasing_id()))
    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        n = rest.count()
        groups = max(1, -(-n // partition_pieces))
        final = turn == ROUNDS - 1 or (groups == 1 and turn > 0) or n == 0
        keyed = rest.withColumn("g", F.expr(f"int(pmod(xxhash64(rid, {turn}), {groups}))"))
        packed = keyed.groupBy("g").applyInArrow(tidy(_grouped(capacity, final or groups == 1)), _OUT + ", g int")
        packed = scratch.table(f"round{turn}", packed)
        ids = F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("g").cast("long") * F.lit(1 << 32) + F.col("bin")
        done.append(packed.filter("not released").select("doc_id", "piece", "start", "length", "ids_crc32", ids.alias("sequence_id"), "offset", F.lit(turn).alias("round"), "partition_bins", "partition_bound"))
        if final or groups == 1:
            break
        rest = packed.filter("released").select("doc_id", "piece", "start", "length", "ids_crc32", "rid")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _grouped(capacity: int, final: bool):
    inner = _packer(capacity, final)

    def run(t: pa.Table) -> pa.Table:
        out = inner(t)
        return out.append_column("g", pa.array(np.full(out.num_rows, t.column("g")[0].as_py(), dtype=np.int32)))

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, capacity, vocabulary), capacity)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The packed ids themselves: (sequence_id, ids array<int>); a sequence is bounded by the capacity."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same = [packed[k].eqNullSafe(pieces_with_ids[k]) for k in keys]
    both = packed.join(pieces_with_ids.dropDuplicates(keys), same).select("sequence_id", "offset", "ids")

    def run(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t.column("offset").to_pylist(), t.column("ids").to_pylist(), strict=True), key=lambda p: p[0])
        return pa.table({"sequence_id": pa.array([t.column("sequence_id")[0].as_py()], pa.int64()), "ids": pa.array([[i for _, ids in parts for i in ids]], pa.list_(pa.int32()))})

    return both.groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>")
