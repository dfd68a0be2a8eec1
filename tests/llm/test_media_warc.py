import hashlib
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.llm import media, queries, warc
from tests.oracle import check

TEXTS = [(1, "plain"), (2, ""), (3, None), (None, "no id"), (5, "é" * 4000), (5, "é" * 4000), (7, "x" * 192), (8, "日本語 🙂 \x00 end")]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=2000))
def test_round_trip(text):
    raw = text.encode("utf-8", "ignore")
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
    stream = media.parse(media.encode(payload))
    assert media.decode(media.encode(payload)) == payload
    assert stream.crc_bad == 0 and stream.skipped == 0 and stream.samples == 384 * len(stream.offsets)
    assert stream.table["frames"] == len(stream.offsets) and stream.tags["TLEN"] == str(stream.samples * 1000 // 32000)


def test_resynchronisation_and_checksums():
    payload = bytes(range(32, 224)) * 20
    blob = media.encode(payload)
    clean = media.parse(blob)
    at = clean.offsets[4]
    spoiled = blob[:at] + b"\xff\xfbnoise" + blob[at:]
    again = media.parse(spoiled)
    assert again.skipped == 7 and len(again.offsets) == len(clean.offsets) and media.decode(spoiled, again) == payload
    wrong = bytearray(blob)
    wrong[clean.offsets[2] + 8] ^= 1
    assert media.parse(bytes(wrong)).crc_bad == 1
    cut = media.parse(blob[: clean.offsets[-1] + 30])
    assert len(cut.offsets) == len(clean.offsets) - 1
    assert media.parse(b"").samples == 0 and media.parse(b"\x00" * 500).skipped == 500
    with pytest.raises(ValueError):
        media.encode(b"\xff" * 192)
    with pytest.raises(ValueError):
        media.encode(b"x")


def test_layer_three_with_xing():
    head = b"\xff\xfb\x90\xc0"  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, mono
    h = media.header(head)
    assert (h.layer, h.kbits, h.hertz, h.length, h.samples) == (3, 128, 44100, 417, 1152)
    xing = (head + b"\0" * 17 + b"Xing" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1251).to_bytes(4, "big")).ljust(417, b"\0")
    s = media.parse(xing + head.ljust(417, b"\0") * 2)
    assert s.table["kind"] == "Xing" and s.table["frames"] == 2 and s.seconds == (2304, 44100) and s.offsets == [417, 834]


def test_media_table(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("feature", F.lit("clash"))
    got = media.text_media(df, keep_media=True).collect()
    assert len(got) == len(TEXTS)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(TEXTS, key=lambda x: (x[0] or 0, len((x[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        pad = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert media.text_media(df.limit(0)).count() == 0
    info = media.media_info(spark.createDataFrame([(bytearray(media.encode(b" " * 192)),), (None,), (bytearray(b"xx"),)], "media binary"))
    assert [r["mpeg"] and (r["mpeg"]["frames"], r["mpeg"]["skipped"]) for r in info.collect()] == [(1, 0), None, (0, 2)]


PAGES = [(3, "u", "<p>a</p>"), (1, "u\r\nX: y", "<p>a</p>"), (9, None, "<p>a</p>"), (4, "v", None), (5, "v", ""), (None, "w", "<p>a</p>"), (None, "w", "lone"), (7, "z", "é" * 9000), (1, "u", "<p>a</p>")]


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(same, default=None)
        again = len(body) >= least and first is not None and i != first and sum((h or "").encode() == body for _, _, h in rows) > 1
        out.append((i, len(body), warc.digest(body), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip_of_pages(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("first", F.lit(1))
    got = warc.round_trip(df, least).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(PAGES, least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_op10_oracle(spark, sf):
    check(spark, sf, queries.queries()["op10_warc_zstd"], queries.oracle_sql()["op10_warc_zstd"])


def archive(n=40):
    records = [warc.record_bytes("response", f"urn:{k}", "http://x/", f"<html>page {k} of many pages</html>".encode() * 9, "D") for k in range(n)]
    d = warc.train(records)
    packer = zstandard.ZstdCompressor(dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(write_checksum=True)
    return warc.dictionary_frame(d) + b"".join(packer.compress(r) for r in records), records


def test_reader_validates():
    blob, records = archive()
    got = list(warc.read_archive(blob))
    assert len(got) == 40 and got[7].payload == records[7].split(b"\r\n\r\n", 1)[1][:-4]
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in records[:3])
    assert len(list(warc.read_archive(plain))) == 3
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(blob[:-5]))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(plain + b"junk"))
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"HTTP/1.1"), records[0].replace(b"WARC-Type", b"X-Type"), records[0].replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(zstandard.ZstdCompressor().compress(bad)))


def test_files(spark, tmp_path):
    blob, _ = archive(9)
    (tmp_path / "a.warc.zst").write_bytes(blob)
    got = warc.read_files(spark, f"{tmp_path}/*.warc.zst").collect()
    assert len(got) == 9 and got[0]["headers"]["warc-type"] == "response"


@pytest.mark.parametrize(("first", "rate", "mode", "joint"), [(0xFD, 0xC4, 0x00, 32), (0xFD, 0x24, 0xC0, 32), (0xFD, 0xC8, 0x50, 8), (0xF5, 0x84, 0x00, 32), (0xFD, 0x88, 0x60, 12)])
def test_layer_two_checksums(first, rate, mode, joint):
    """The cover by a plain bit reader: allocations, then two bits a channel for each subband with samples."""
    rng = np.random.default_rng(first + rate + mode)
    head = bytes([0xFF, first & 0xFE, rate, mode])
    h = media.header(head)
    assert h.layer == 2 and h.checked
    body = rng.integers(0, 256, h.length - 6, dtype=np.uint8).tobytes()
    bits = "".join(f"{b:08b}" for b in body)
    place, chosen = 0, 0
    for band, width in enumerate(media.allocation_bits(h)):
        shared = not h.mono and band >= joint
        for _ in range(1 if h.mono or shared else 2):
            some = int(bits[place : place + width], 2) > 0
            chosen += some * (2 if shared else 1)
            place += width
    n = place + 2 * chosen
    crc = 0xFFFF
    for bit in f"{rate:08b}{mode:08b}" + bits[:n]:
        top = (crc >> 15) ^ int(bit)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    good = head + crc.to_bytes(2, "big") + body
    assert media.checksum(good, 0, h) is True and media.checksum(head + (crc ^ 1).to_bytes(2, "big") + body, 0, h) is False
