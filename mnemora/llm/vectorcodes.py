"""Vector code compression: integer product codes with codebooks fitted in Spark and a partial-distance search.

All arithmetic is on integers, so results do not depend on how rows are dealt
out.  Each round is one scan that sends at most a sum and a count an entry from
each task; the codebooks, whose size the data do not change, go back by
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, tune

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are kept within +-MOST, so that a distance fits 64 bits.
MOST = 1 << 26
#: Rows that a task searches at once, and labels whose sums may be broadcast.
ROWS, SENT_LABELS = 4096, 1000


def quantised(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole (no null or non-finite component), and these as integers, padded with zeros to ``length``.

    Without a length it is the longest here; longer ones do not come.
    """
    flat = column.flatten()
    x = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
    fine = np.isfinite(x)
    if flat.null_count:
        fine &= ~np.asarray(flat.is_null())
    present = np.asarray(column.is_valid())
    size = np.where(present, np.asarray(column.value_lengths().fill_null(0)), 0)
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~fine)])
    whole = present & (bad[start + size] == bad[start])
    length = int(size[whole].max(initial=0)) if length is None else length
    q = np.clip(np.floor(np.where(fine, x, 0.0) * SCALE), -MOST, MOST).astype(np.int64)
    out = np.zeros((int(whole.sum()), length), dtype=np.int64)
    where = np.arange(length) < size[whole][:, None]
    out[where] = q[np.repeat(whole, size)]
    return whole, out


def by_part(rows: np.ndarray) -> np.ndarray:
    """(rows, parts, positions), lengths that PARTS does not divide being padded with zeros at the end."""
    wide = -(-max(rows.shape[1], 1) // PARTS) * PARTS
    return np.pad(rows, ((0, 0), (0, wide - rows.shape[1]))).reshape(len(rows), PARTS, wide // PARTS)


def search(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance, ties to the lower index: exact.

    Positions are taken in descending order of their variance over the
    codebook; a vector leaves an entry once its distance so far exceeds the
    best whole distance that it has.  ``rows`` is (rows, parts, positions),
    ``books`` (parts, entries, positions).
    """
    n, parts, width = rows.shape
    order = np.argsort(-books.astype(np.float64).var(axis=1), axis=1, kind="stable")
    x = np.ascontiguousarray(np.take_along_axis(rows, order[None], axis=2).transpose(2, 1, 0)).reshape(width, parts * n)
    c = np.take_along_axis(books, order[:, None], axis=2)
    best, code = np.full(parts * n, np.iinfo(np.int64).max), np.zeros(parts * n, dtype=np.int64)
    for e in range(books.shape[1]):
        at = np.arange(parts * n)
        far = np.zeros(parts * n, dtype=np.int64)
        for p in range(width):
            step = x[p][at] - c[:, e, p][at // n]
            far += step * step
            keep = far <= best[at]
            if not keep.all():
                at, far = at[keep], far[keep]
        less = far < best[at]
        best[at[less]], code[at[less]] = far[less], e
    return code.reshape(parts, n).T, best.reshape(parts, n).T


def batches_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of the quantised table put together to ROWS rows: the rows, and their vectors by part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield _joined(held, length)
            held = []
    if any(b.num_rows for b in held):
        yield _joined(held, length)


def _joined(held: list[pa.RecordBatch], length: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held)
    out = np.zeros((t.num_rows, length), dtype=np.int64)
    for i, raw in enumerate(t.column("q").to_pylist()):
        v = np.frombuffer(raw, "<i4")
        out[i, : len(v)] = v
    return t, by_part(out)


def fit(rows: DataFrame, length: int) -> np.ndarray:
    """Codebooks (parts, entries, positions) of the quantised rows (vec_id, q) after ROUNDS rounds.

    They start as the parts of the ENTRIES smallest ids, null ids last and
    equal ids by their vectors; with fewer rows there are fewer entries.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(ENTRIES).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), dtype=np.int64)
    start = np.zeros((len(first), length), dtype=np.int64)
    for i, r in enumerate(first):
        v = np.frombuffer(bytes(r["q"]), "<i4")
        start[i, : len(v)] = v
    books = by_part(start).transpose(1, 0, 2).copy()
    k, width = books.shape[1:]
    for _ in range(ROUNDS):
        held = rows.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((PARTS * k, width), dtype=np.int64), np.zeros(PARTS * k, dtype=np.int64)
            for _, x in batches_of(batches, length):
                code, _ = search(x, held.value)
                at = (code + np.arange(PARTS) * k).ravel()
                flat = x.reshape(-1, width)
                order = np.argsort(at, kind="stable")
                kinds, lo, c = np.unique(at[order], return_index=True, return_counts=True)
                total[kinds] += np.add.reduceat(flat[order], lo, axis=0)
                count[kinds] += c
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["entry", "c", "total"])

        got = rows.select("q").mapInArrow(sums, "entry long, c long, total array<long>")
        got = got.select("entry", "c", F.posexplode("total")).groupBy("entry", "pos").agg(F.sum("c").alias("c"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        for r in got.collect():  # a row an entry and position
            books[r["entry"] // k, r["entry"] % k, r["pos"]] = int(r["total"]) // r["c"]
        held.destroy()
    return books


def fingerprint(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all whole vectors: (vec_id, label, code, error, codebooks_sha256).

    Vectors that are null or hold null or non-finite components are dropped.
    Components become floor(4096 * x), within +-2**26.  Vectors of another
    length count as padded with zeros to the longest, rounded up to a multiple
    of eight.  Repeated ids and vectors are rows of their own.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "codes")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, q = quantised(batch.column(2))
            kept = batch.filter(pa.array(whole))
            raw = [v.astype("<i4").tobytes() for v in q]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "q"])

    kind = vectors.schema[label_col].dataType.simpleString()
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = scratch.table("rows", slim.mapInArrow(floors, f"vec_id long, label {kind}, q binary"))
    length = (rows.agg(F.max(F.octet_length("q"))).first()[0] or 0) // 4
    books = fit(rows, length)
    held, name = spark.sparkContext.broadcast(books), fingerprint(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x in batches_of(batches, length):
            code, far = search(x, held.value)
            names = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(names, pa.string()), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    out = scratch.table("coded", rows.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long"))
    held.destroy()
    scratch.drop("rows")
    return out.withColumn("codebooks_sha256", F.lit(name))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors of its label, nulls together: (vec_id, label, code, error, label_error, codebooks_sha256).

    Labels with more than a thousandth of the rows, at most SENT_LABELS, are
    broadcast; the rows of others are joined by label.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("c"))
    total = coded.count()
    frequent = F.broadcast(sums.filter(F.col("c") * SENT_LABELS > total).select(F.col("label").alias("l"), "label_error"))
    rare = sums.filter(F.col("c") * SENT_LABELS <= total).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    out = coded.join(frequent, same)
    if not rare.isEmpty():
        out = out.unionByName(coded.join(frequent, same, "left_anti").join(rare, same))
    return out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
