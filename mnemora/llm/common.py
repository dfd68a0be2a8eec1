"""Helpers that every operator here shares: scratch tables, Arrow scans, bitmaps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.deploy import ship

#: Rows in one Arrow batch handed to Python; keeps a batch of long texts within some tens of MB.
ARROW_ROWS = 512
_OWN: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, and send this package along."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one of this process where none is set and the master is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="mnemora-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


class Scratch:
    """Tables of one operator run, written in the shared folder so that a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.sent: list = []
        self.names: list[str] = []

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read back; its lineage ends here."""
        path = f"{self.root}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def send(self, value):
        """Broadcast a value that only this run's tables are made with; ``close`` takes it back."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def drop(self, *names: str) -> None:
        """Delete tables, or all without a name, when nothing reads them any more."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()  # the driver lets go of shuffles only when it collects the frames that made them

    def close(self, *keep: str) -> None:
        """Delete all tables but ``keep`` and take back the broadcasts: what is left must not need them."""
        for b in self.sent:
            b.destroy()
        self.sent.clear()
        self.drop(*(n for n in self.names if n not in keep))
        self.names = [*keep]


_HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, clear: Callable[[], object]) -> None:
    """Declare that this process now uses the caches of one operator: those of others are emptied.

    Workers are used again for other operators, and what each keeps would add up.
    """
    if next(reversed(_HELD), None) == name:
        return
    for other, f in _HELD.items():
        if other != name:
            f()
    _HELD.clear()
    _HELD[name] = clear
    gc.collect()
    _trim()


def rest() -> None:
    """Empty this process's caches at the end of a task.

    Workers take turns, so with those that wait there are several for each at
    work, and every one of them would keep a cache filled.
    """
    for f in _HELD.values():
        f()
    _HELD.clear()
    gc.collect()
    _trim()


def _trim() -> None:
    """Give memory that nothing uses back to the system: idle workers stay, beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it just keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` of a group; what it took and no longer uses goes back to the system after each one, so few large groups are best."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        _trim()
        return out

    return run


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until each holds ``size`` bytes; the last may hold fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held.clear()
    if held:
        yield pa.concat_batches(held)


def scan(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, at_once: int = 0) -> DataFrame:
    """Map each Arrow batch of ``df``, or batches of ``at_once`` bytes put together, by ``f``; ``f`` keeps no state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, at_once):
            if batch.num_rows and (out := f(batch)) is not None:
                yield out
        rest()

    return df.mapInArrow(run, schema)


def dealt(at: np.ndarray, log: int, values: np.ndarray) -> pa.RecordBatch:
    """Values by bucket, a power of two of them: (bucket int, raw binary), ``at`` being the bucket of each."""
    order = np.argsort(at, kind="stable")
    parts = np.split(values[order], np.searchsorted(at[order], np.arange(1, 1 << log)))
    some = [i for i, p in enumerate(parts) if len(p)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["bucket", "raw"])


def gathered(parts: DataFrame, column: str, log: int, bits: int) -> np.ndarray:
    """A bitmap from its slices, the value of ``column`` by bucket: 2**log rows at most."""
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = len(out) >> log
    for row in parts.select("bucket", column).toLocalIterator():
        out[row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1], dtype=np.uint8)
    return out


def flags(at: np.ndarray, width: int) -> bytes:
    """A slice of ``width`` bits of a bitmap with those at the given places set."""
    out = np.zeros(width, dtype=np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


#: Keys that a task holds before it hands them on.
HELD = 1 << 18


def fitted(n: int, a_key: int = 8, least: int = 16, most: int = 27) -> int:
    """The logarithm of a bitmap's bits for n keys: some a key, up to a fixed size; a fuller one costs time and changes no result."""
    return int(np.clip(np.ceil(np.log2(a_key * (n + 1))), least, most))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit for each value of ``key``, a long or many of them as binary.

    Its size is fixed whatever the number of keys, so it may be sent to every
    executor.  A bit can stand for several keys; users must treat it as a
    filter that lets some other keys through.  Tasks hand on each place once
    for HELD keys, as 32-bit offsets in a slice; one task fills a slice.
    """
    log = max(0, bits - 19)
    width, mask = 1 << (bits - log), np.uint64((1 << bits) - 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held) & mask)
            held.clear()
            return dealt(at >> np.uint64(bits - log), log, (at & np.uint64(width - 1)).astype("<u4"))

        for batch in batches:
            c = batch.column(0)
            held.append(np.frombuffer(b"".join(c.to_pylist()), "<u8") if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield flush()
        if held:
            yield flush()
        rest()

    def fill(t: pa.Table) -> pa.Table:
        raw = flags(np.frombuffer(b"".join(t.column("raw").to_pylist()), "<u4"), width)
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "raw": pa.array([raw], pa.binary())})

    slices = keys.select("key").mapInArrow(parts, "bucket int, raw binary").groupBy("bucket").applyInArrow(tidy(fill), "bucket int, raw binary")
    return gathered(slices, "raw", log, bits)


def in_bitmap(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key's bit is set."""
    at = keys.astype(np.uint64) & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def hit(table, key):
    """A Boolean column: whether the long column ``key`` has its bit in a broadcast bitmap."""
    return F.arrow_udf(lambda k: pa.array(in_bitmap(k.to_numpy(zero_copy_only=False), table.value)), "boolean")(key)


def text_key(column):
    """A text's 128-bit key, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")))


def distinct_scan(docs: DataFrame, text_col: str, repeated, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, only=None) -> DataFrame:
    """Map each distinct text once, in batches of (key binary, text string), null texts being empty.

    ``repeated`` is a broadcast bitmap of xxhash64(key) for keys of several
    rows; only rows with its bit are shuffled, to be told apart.  ``only`` is
    one of the keys wanted, if not all are; some others may come along.
    """
    d = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("key"))

    def chosen(batch: pa.RecordBatch, again: bool) -> pa.RecordBatch | None:
        h = batch.column(2).to_numpy(zero_copy_only=False)
        keep = in_bitmap(h, repeated.value) == again
        if only is not None:
            keep &= in_bitmap(h, only.value)
        return batch.filter(pa.array(keep)).select(["key", "text"]) if keep.any() else None

    def once(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        return f(part) if (part := chosen(batch, False)) is not None else None

    several = scan(d, lambda b: chosen(b, True), "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))
    return scan(d, once, schema).unionByName(scan(several, f, schema))
