"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words that a document shares with a benchmark item seed
the search (running Karp-Rabin hashes against the items' hashes); a shorter
item is its own seed.  For each
pair with a seed, the longest match of words not yet marked is marked in both
texts, again and again, until none of ``min_match`` words is left.  The part
of the item that the tiles cover decides, so passages in another order are
found as well.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import scan, tune

MIN_MATCH = 5
COVERAGE = 0.5
#: Benchmark characters that one pass over the documents holds; a larger benchmark takes several passes.
BLOCK_CHARS = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
# ASCII letters to lower case, ASCII digits kept, every other ASCII character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode().translate(_FOLD).split()


def tiles(item: list[int], doc: list[int], seeds: list[tuple[int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in doc) from seeds, places where min_match words agree.

    The longest match of unmarked words is marked, again and again (ties:
    first in the item, then in the document).  A match that marked words
    cut is put back as what is left of it, so every next one is the longest.
    """
    done_i, done_d, out = bytearray(len(item)), bytearray(len(doc)), []
    queue = []
    for i, j in set(seeds):
        if i and j and item[i - 1] == doc[j - 1]:
            continue  # not where the match begins
        n = min_match
        while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
            n += 1
        queue.append((-n, i, j))
    heapq.heapify(queue)
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        if not any(done_i[i : i + n]) and not any(done_d[j : j + n]):
            done_i[i : i + n] = done_d[j : j + n] = b"\x01" * n
            out.append((n, i, j))
            continue
        run = 0
        for k in range(n + 1):
            if k < n and not done_i[i + k] and not done_d[j + k]:
                run += 1
            else:
                if run >= min_match:
                    heapq.heappush(queue, (-run, i + k - run, j + k - run))
                run = 0
    return out


@dataclass
class Block:
    """Benchmark items ready for search: word numbers from 1, items, and by length of seed the sorted hashes and their places."""

    ids: list[int | None]
    items: list[list[int]]
    vocabulary: dict[bytes, int]
    seeds: dict[int, np.ndarray]
    places: dict[int, dict[int, list[tuple[int, int]]]]


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for i in range(k):
        out = out * BASE + codes[i : i + len(out)].astype(np.uint64)
    return out


def block(rows: list[tuple[int | None, str | None]], min_match: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    ids, items, places = [], [], {}
    for key, text in rows:
        codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text or "")]
        if not codes:
            continue
        length = min(min_match, len(codes))  # an item of fewer words is matched whole
        for at, h in enumerate(_hashes(np.array(codes), length).tolist()):
            places.setdefault(length, {}).setdefault(h, []).append((len(items), at))
        ids.append(key)
        items.append(codes)
    return Block(ids, items, vocabulary, {n: np.sort(np.array(list(p), dtype=np.uint64)) for n, p in places.items()}, places)


def search(b: Block, text: str | None) -> list[tuple[int, int, int, int]]:
    """(item's number, words covered, tiles, longest tile) for every item that shares a seed with a text."""
    get = b.vocabulary.get
    codes = [get(w, 0) for w in words(text or "")]
    array = np.array(codes)
    unknown = np.concatenate(([0], np.cumsum(array == 0)))
    out = []
    for length, own in b.seeds.items():
        if len(codes) < length:
            continue
        at = np.flatnonzero(unknown[length:] == unknown[:-length])
        h = _hashes(array, length)
        at = at[own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]]
        pairs: dict[int, list[tuple[int, int]]] = {}
        for j in at.tolist():
            for k, i in b.places[length][int(h[j])]:
                if b.items[k][i : i + length] == codes[j : j + length]:
                    pairs.setdefault(k, []).append((i, j))
        for k, seeds in pairs.items():
            if got := tiles(b.items[k], codes, seeds, length):
                out.append((k, sum(n for n, _, _ in got), len(got), max(n for n, _, _ in got)))
    return out


def blocks(benchmark: DataFrame, min_match: int, block_chars: int, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in parts of about ``block_chars`` characters, by a hash of the id and text."""
    b = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= block_chars else -(-2 * chars // block_chars)
    return [b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


PAIRS = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long, coverage double"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every (document, item) whose tiles cover at least ``coverage`` of the item's words.

    Null or empty texts share nothing.  Items of fewer than ``min_match``
    words are found where they stand whole.  Null ids stay null; repeated
    documents or items give repeated rows.  Other columns are not read.
    """
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for part in blocks(benchmark, min_match, block_chars, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(block([(r["item_id"], r["text"]) for r in part.collect()], min_match))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            b, rows = held.value, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, covered, n, longest in search(b, text):
                    if covered >= coverage * len(b.items[k]):
                        rows.append((key, b.ids[k], len(b.items[k]), covered, n, longest, covered / len(b.items[k])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in PAIRS.split(", ")])

        found = scan(d, run, PAIRS)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no benchmark item contaminates; see ``contaminated_pairs``."""
    tune(docs.sparkSession)
    out = docs
    for part in blocks(benchmark, min_match, block_chars, "item_id", "text"):
        held = docs.sparkSession.sparkContext.broadcast(block([(r["item_id"], r["text"]) for r in part.collect()], min_match))

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            b = held.value
            keep = [not any(covered >= coverage * len(b.items[k]) for k, covered, _, _ in search(b, text)) for text in batch.column(text_col).to_pylist()]
            return batch.filter(pa.array(keep))

        out = scan(out, run, docs.schema)
    return out
