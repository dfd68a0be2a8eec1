"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

``read_archive`` follows the published convention for ``.warc.zst``: a first
skippable frame with magic 0x184D2A5D holds the dictionary (itself perhaps a
Zstandard frame), and every record is a frame of its own.  Headers and lengths
are validated record by record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, bitmap, fitted, hit, tune

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICT_BYTES = 16 << 10
#: Bound of the records that an archive's dictionary is trained on, and of their bytes.
DICT_RECORDS, DICT_SAMPLE = 200, 1 << 20
#: An archive's chunks hold about this many compressed bytes each.
CHUNK = 4 << 20
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive that breaks the format, with the byte offset of the record."""


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, payload_digest: str, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """A WARC/1.1 record.  A revisit has no payload block; its digest is that of the full payload."""
    block = b"" if kind == "revisit" else payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-31T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}"}
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
    fields |= extra or {}
    fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from at most DICT_RECORDS samples; None where they are too few to train on."""
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def dictionary_frame(d: zstandard.ZstdCompressionDict | None) -> bytes:
    """The leading skippable frame; its content is compressed.  Empty without a dictionary."""
    if d is None:
        return b""
    body = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(d.as_bytes())
    return SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def load_dictionary(blob: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive's first bytes and where its records begin."""
    if int.from_bytes(blob[:4], "little") != SKIPPABLE:
        return None, 0
    size = int.from_bytes(blob[4:8], "little")
    body = blob[8 : 8 + size]
    if len(body) < size:
        raise WarcError("offset 0: the dictionary frame is cut off")
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body), 8 + size


def parse_record(raw: bytes, offset: int) -> Record:
    """One record's headers and block, validated: version line, required fields, length and the closing blank lines."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError(f"offset {offset}: no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"offset {offset}: bad header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise WarcError(f"offset {offset}: missing {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"offset {offset}: the block is not as long as Content-Length says")
    return Record(offset, headers, rest[:-4])


def read_archive(blob: bytes) -> Iterator[Record]:
    """The records of a whole archive, one Zstandard frame each; raises WarcError at the first fault."""
    d, at = load_dictionary(blob)
    yield from read_frames(blob, at, d)


def read_frames(blob: bytes, at: int, d: zstandard.ZstdCompressionDict | None) -> Iterator[Record]:
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    view = memoryview(blob)
    while at < len(blob):
        if 0x184D2A50 <= int.from_bytes(blob[at : at + 4], "little") <= 0x184D2A5F:
            at += 8 + int.from_bytes(blob[at + 4 : at + 8], "little")
            continue
        if blob[at : at + 4] != FRAME:
            raise WarcError(f"offset {at}: no Zstandard frame")
        one = reader.decompressobj()
        # fed piecewise, so that the many frames after this one are not copied for each record
        parts, fed = [], at
        try:
            while not one.eof and fed < len(blob):
                parts.append(one.decompress(view[fed : fed + 65536]))
                fed = min(fed + 65536, len(blob))
        except zstandard.ZstdError as e:
            raise WarcError(f"offset {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"offset {at}: the frame is cut off")
        yield parse_record(b"".join(parts), at)
        at = fed - len(one.unused_data)


ARCHIVE = "archive string, chunk int, content binary"


def write_archives(records: DataFrame) -> DataFrame:
    """Archives from (page_id, url, payload, record_type, refers_to, payload_sha1, payload_bytes): one a partition, in chunks.

    A chunk begins with the archive's dictionary frame only if it is chunk 0,
    so an archive file is the concatenation of its chunks; every chunk ends
    at a frame's end.  Memory holds a chunk and the dictionary's samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        held: list[bytes] = []
        packer, out, size, chunk = None, [], 0, 0
        taken = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([chunk], pa.int32()), pa.array([b"".join(out)], pa.binary())], ["archive", "chunk", "content"])

        def start() -> None:
            nonlocal packer, size
            d = train(held)
            packer = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=d) if d else zstandard.ZstdCompressor(level=3, write_checksum=True)
            out.append(dictionary_frame(d))
            for raw in held:
                out.append(packer.compress(raw))
            size = sum(map(len, out))
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                key = r["page_id"]
                extra = {} if key is None else {"X-Page-Id": str(key)}
                extra["X-Payload-Bytes"] = str(r["payload_bytes"])
                raw = record_bytes(r["record_type"], f"urn:page:{'none' if key is None else key}", (r["url"] or "").replace("\r", " ").replace("\n", " "), r["payload"] or b"", base64.b32encode(r["payload_sha1"]).decode(), f"urn:page:{r['refers_to']}", extra)
                if packer is None:
                    held.append(raw)
                    taken += len(raw)
                    if len(held) >= DICT_RECORDS or taken >= DICT_SAMPLE:
                        start()
                else:
                    out.append(packer.compress(raw))
                    size += len(out[-1])
                if size >= CHUNK:
                    yield row()
                    out.clear()
                    size, chunk = 0, chunk + 1
        if held:
            start()
        if out:
            yield row()

    return records.mapInArrow(run, ARCHIVE)


def read_chunks(archives: DataFrame) -> DataFrame:
    """Every record of archives in chunks: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    The dictionary comes from each archive's chunk 0, by a join on the
    archive's name; chunks of one archive can be read by different tasks.
    A response's length and digest are taken from the block read and checked
    against its header; a revisit has those of the full payload in its header.
    """
    lead = archives.filter("chunk = 0").select("archive", F.expr(f"substring(content, 1, {DICT_BYTES * 2 + 64})").alias("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d, at = load_dictionary(r["lead"])
                rows: list[tuple] = []
                for rec in read_frames(r["content"], at if r["chunk"] == 0 else 0, d):
                    h = rec.headers
                    named = h["warc-payload-digest"].removeprefix("sha1:")
                    kind, n = h["warc-type"], int(h["x-payload-bytes"])
                    if kind == "response" and (digest(rec.payload) != named or len(rec.payload) != n):
                        raise WarcError(f"{r['archive']} offset {rec.offset}: the payload does not match its digest or length")
                    ref = h.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, n, named, kind, int(ref) if ref not in ("", "None") else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.join(lead, "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page's record: (page_id, url, payload, payload_bytes, sha1 hex, record_type, refers_to).

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest page_id are responses and the others revisit it.  Null html
    is an empty payload, null urls are empty.  Null ids come last; where all
    ids of a group are null, all are responses.  Repeated rows of the
    smallest id are all responses.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    able = p.filter(F.col("payload_bytes") >= min_bytes)
    # written, so that the join deals out both sides itself and a frequent payload can be split
    first = able.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = Scratch(pages.sparkSession, "payloads").table("first", first.select(F.col("sha").alias("sha_of_group"), "first"))
    # only rows with the bit of a payload that several have are dealt out
    some = hit(pages.sparkSession.sparkContext.broadcast(bitmap(first.select(F.xxhash64("sha_of_group").alias("key")), fitted(first.count()))), F.xxhash64("sha"))
    shared = p.filter(some).join(first, (F.col("sha") == F.col("sha_of_group")) & (F.col("payload_bytes") >= min_bytes), "left")
    again = F.coalesce((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    shared = shared.select(*p.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    return p.filter(~some).select(*p.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(shared)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The archives of ``pages``, as chunks; see ``classify`` for the records."""
    tune(pages.sparkSession)
    c = classify(pages, min_bytes).withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    return write_archives(c.select("page_id", "url", "payload", "payload_bytes", F.unhex("sha").alias("payload_sha1"), "record_type", "refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_chunks(scratch.table("archives", archive_pages(pages, min_bytes)))


def read_files(spark, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files: (path, offset, headers map, payload).  One file is one task; a fault raises."""
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for rec in read_archive(r["content"]):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([rec.offset], pa.int64()), pa.array([list(rec.headers.items())], pa.map_(pa.string(), pa.string())), pa.array([rec.payload], pa.binary())], ["path", "offset", "headers", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, offset long, headers map<string,string>, payload binary")
