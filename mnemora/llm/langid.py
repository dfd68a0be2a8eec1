"""Language identification by interpolated Kneser-Ney character models.

One model of four-character contexts a language, kept as sorted arrays of
n-gram hashes.  A text goes to the language of lowest cross-entropy a
character; a calibration on further labelled rows turns the margin to the
second language into a probability and gives each language the cross-entropy
from which on a text is rejected.

Words are the unit of counting: a text is the multiset of its words, each
with a space at its end and spaces before it as context, so the models gather
every word of every training text while n-grams are formed once for a
distinct word of a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, tune
from mnemora.llm.toxicity import fold

ORDER = 4
#: Steps a nat in which the calibration counts margins, and the margin from which on they are one.
STEPS, WIDEST = 4096, 16.0
#: Distinct words a task counts before it hands its counts on, and words whose scores a process keeps.
COUNT_WORDS, CACHE_WORDS = 300_000, 200_000
UNDETERMINED = "und"
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; every ASCII character that is no letter separates them."""
    return text.lower().encode().translate(_SPLIT).split()


def letters(word: bytes) -> str:
    """A word's letters alone."""
    s = word.decode()
    return s if s.isalpha() else "".join(c for c in s if c.isalpha())


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every character of every word as a 64-bit n-gram of ORDER 16-bit codes, and the word that it is in.

    Characters beyond the basic plane share the code 0xFFFF.
    """
    padded = [" " * (ORDER - 1) + t + " " for t in texts]
    codes = np.minimum(np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4"), 0xFFFF).astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    word = np.repeat(np.arange(len(padded)), lengths)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= ORDER - 1
    gram = codes.copy()
    for k in range(1, ORDER):
        gram[k:] |= codes[:-k] << np.uint64(16 * k)
    return gram[inside], word[inside]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash; one to one, so equal hashes are equal n-grams of an order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = [np.uint64((1 << 16 * n) - 1) for n in range(4)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]


@dataclass
class Model:
    """Kneser-Ney probabilities of all languages over joint sorted hash arrays.

    ``known`` holds the hashes of n-grams of full order seen in any language,
    ``log_p`` their interpolated log probabilities a language.  ``parts[n]``
    and ``back[n]`` hold, for order n, the discounted part of an n-gram and
    the weight that its context passes on, for n-grams not seen whole.
    """

    languages: list[str]
    known: np.ndarray
    log_p: np.ndarray
    parts: dict[int, tuple[np.ndarray, np.ndarray]]
    back: dict[int, tuple[np.ndarray, np.ndarray]]
    uniform: float
    slope: float = 20.0
    offset: float = 0.0
    limits: tuple[float, ...] = ()

    def _look(self, keys: np.ndarray, values: np.ndarray, grams: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(grams), len(self.languages)), missing)
        h = mix(grams)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], values[at], missing)

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after the others: a row an n-gram, a column a language."""
        p = np.full((len(grams), len(self.languages)), self.uniform)
        for n in range(1, ORDER + 1):
            part = self._look(*self.parts[n], grams & _LOW[n], 0.0)
            weight = self._look(*self.back[n], (grams >> np.uint64(16)) & _LOW[n - 1], 1.0)
            p = part + weight * p
        return np.log(np.maximum(p, 1e-300))

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """For each word the log probability in each language, and last the characters counted; zeros without letters."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        grams, word = windows(texts)
        h = mix(grams)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        log_p = self.log_p[at]
        if len(new := np.flatnonzero(self.known[at] != h)):
            log_p[new] = self.log_prob(grams[new])
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, weights=log_p[:, k], minlength=len(texts))
        out[:, -1] = np.bincount(word, minlength=len(texts))
        out[[not t for t in texts]] = 0
        return out


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model | None:
    """Build the model from each language's full-order n-grams and counts; None without any."""
    counts = {k: v for k, v in sorted(counts.items()) if len(v[0])}
    if not counts:
        return None
    languages = list(counts)
    symbols = np.unique(np.concatenate([g & _LOW[1] for g, _ in counts.values()]))
    uniform = 1.0 / (len(symbols) + 1)
    part_of: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
    back_of: dict[int, list] = {n: [] for n in range(1, ORDER + 1)}
    for grams, number in counts.values():
        order = np.argsort(grams)
        gram, c = grams[order], number[order].astype(np.float64)
        for n in range(ORDER, 0, -1):
            ones, twos = float((c == 1).sum()), float((c == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, start, size = np.unique(gram >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(c, start)
            part_of[n].append((gram, np.maximum(c - discount, 0) / np.repeat(total, size)))
            left = np.add.reduceat(np.minimum(c, discount), start)
            back_of[n].append((context, left / total))
            if n > 1:  # the next order counts in how many different contexts a shorter n-gram stands
                gram, c = np.unique(gram & _LOW[n - 1], return_counts=True)
                c = c.astype(np.float64)

    def joint(rows: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([g for g, _ in rows]))
        values = np.full((len(keys), len(rows)), missing)
        for k, (g, v) in enumerate(rows):
            values[np.searchsorted(keys, g), k] = v
        h = mix(keys)
        order = np.argsort(h)
        return h[order], values[order]

    model = Model(languages, np.zeros(0, np.uint64), np.zeros((0, len(languages))), {n: joint(r, 0.0) for n, r in part_of.items()}, {n: joint(r, 1.0) for n, r in back_of.items()}, uniform)
    seen = np.unique(np.concatenate([g for g, _ in counts.values()]))
    h = mix(seen)
    order = np.argsort(h)
    model.known, model.log_p = h[order], model.log_prob(seen[order])
    return model


class Scorer:
    """Scores whole texts with a model, a distinct word at a time."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((1 << 16, len(model.languages) + 1))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in each language, and the characters counted, of each text."""
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, text in enumerate(texts):
            row = words(text or "")
            kinds = set(row)
            if len(self.at) + len(kinds) > CACHE_WORDS:
                self.at = {}
            if new := [w for w in kinds if w not in self.at]:
                begin = len(self.at)
                while begin + len(new) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                for k in range(0, len(new), 20_000):
                    some = new[k : k + 20_000]
                    self.table[begin + k : begin + k + len(some)] = self.model.word_scores([letters(w) for w in some])
                self.at.update(zip(new, range(begin, begin + len(new)), strict=True))
            if row:
                out[i] = self.table[np.fromiter(map(self.at.__getitem__, row), np.int64, len(row))].sum(axis=0)
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n


def ngram_counts(docs: DataFrame) -> DataFrame:
    """Full-order n-gram counts of (lang, checked, text): (lang, gram, n, base), over all rows and over those not checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, checked), counter in counts.items():
                texts = [letters(w) for w in counter]
                weight = np.fromiter(counter.values(), np.int64, len(texts))
                weight[[not t for t in texts]] = 0
                grams, word = windows(texts)
                kinds, place = np.unique(grams, return_inverse=True)
                n = np.bincount(place, weights=weight[word]).astype(np.int64)
                kinds, n = kinds[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(n), pa.array(n * (not checked))], ["lang", "gram", "n", "base"])
            counts.clear()

        for batch in batches:
            for lang, checked, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts.setdefault((lang, checked), Counter()).update(words(text))
            if sum(map(len, counts.values())) > COUNT_WORDS:
                yield from flush()
        yield from flush()

    return docs.select("lang", "checked", "text").mapInArrow(run, "lang string, gram long, n long, base long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("base").alias("base"))


def train(docs: DataFrame, held_fold: int = 0, folds: int = 5) -> Model | None:
    """Fit on all labelled documents outside the held-out fold; None where there are none.

    One of the other folds is scored by a model of the rest, and all its rows
    calibrate the model of all.  Null texts, languages and ids take no part.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "langid")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    part = fold(F.col("doc_id"), folds)
    d = d.filter(part != held_fold).select("lang", (part == (held_fold + 1) % folds).alias("checked"), "text")
    table = scratch.table("counts", ngram_counts(d))
    names = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    counts, base = {}, {}
    for lang in names:
        got = table.filter(F.col("lang") == lang).select("gram", "n", "base").toArrow()
        gram, n, some = got.column("gram").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy(), got.column("base").to_numpy()
        counts[lang], base[lang] = (gram, n), (gram[some > 0], some[some > 0])
    scratch.drop()
    model, rest = kneser_ney(counts), kneser_ney(base)
    if model is None or rest is None:
        return model
    held = spark.sparkContext.broadcast(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = Scorer(held.value), {lang: k for k, lang in enumerate(held.value.languages)}
        seen: Counter = Counter()
        worst: dict[str, float] = {}
        for batch in batches:
            e, n = scorer.entropies(batch.column(1).to_pylist())
            for lang, own, c in zip(batch.column(0).to_pylist(), e, n, strict=True):
                if c and lang in at:  # the model of the rest cannot be right about a language that it has not
                    low, second = np.partition(own, 1)[:2] if len(own) > 1 else (own[0], own[0] + 1)
                    seen[int(round(min(second - low, WIDEST) * STEPS)), bool(own.argmin() == at[lang])] += 1
                    worst[lang] = max(worst.get(lang, 0.0), float(own[at[lang]]))
        rows = [(None, 0.0, k, right, c) for (k, right), c in seen.items()] + [(lang, v, None, None, 0) for lang, v in worst.items()]
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "worst", "step", "right", "c"])

    found = d.filter("checked").select("lang", "text").mapInArrow(run, "lang string, worst double, step long, right boolean, c long")
    rows = found.groupBy("lang", "step", "right").agg(F.max("worst").alias("worst"), F.sum("c").alias("c")).collect()  # at most the steps and the languages
    return calibrate(model, [(r["step"] / STEPS, r["right"], r["c"]) for r in rows if r["lang"] is None], {r["lang"]: r["worst"] for r in rows if r["lang"] is not None})


def calibrate(model: Model, margins: list[tuple[float, bool, int]], worst: dict[str, float]) -> Model:
    """Fit the margin's logistic curve (with Platt's smoothed targets) and each language's rejection limit.

    ``margins`` are (margin, right, rows).  The limit is the highest
    cross-entropy among the language's own rows, and a tenth more; a language
    without such rows has the highest limit of the others.
    """
    if not margins:
        return model
    margin, right, rows = (np.array(c) for c in zip(*margins, strict=True))
    hits, misses = rows[right].sum(), rows[~right].sum()
    target = np.where(right, (hits + 1) / (hits + 2), 1 / (misses + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([(rows * (p - target) * margin).sum() + 1e-3 * slope, (rows * (p - target)).sum()])
        w = rows * p * (1 - p)
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - np.clip(step[0], -10, 10), offset - np.clip(step[1], -10, 10)
    if not (np.isfinite(slope) and slope > 0):
        slope, offset = 20.0, 0.0
    model.slope, model.offset = float(slope), float(offset)
    model.limits = tuple(1.1 * worst.get(lang, max(worst.values())) for lang in model.languages)
    return model


OUT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, held_fold: int = 0, folds: int = 5, model: Model | None = None) -> DataFrame:
    """The language of each whole text: (doc_id, held_out, lang_pred, score, cross_entropy, rejected).

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned.  ``rejected`` marks texts whose best cross-entropy
    is beyond the language's calibrated limit; they keep the best language.
    Null ids stay null and are not held out; repeated rows give equal results.
    """
    model = model or train(docs, held_fold, folds)
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = F.col("doc_id").cast("long")
    d = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), (key.isNotNull() & (fold(key, folds) == held_fold)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer = Scorer(m) if m else None
        for batch in batches:
            size = batch.num_rows
            if scorer is None:
                lang, score, low, rejected = [UNDETERMINED] * size, np.zeros(size), [None] * size, [False] * size
            else:
                e, n = scorer.entropies(batch.column(1).to_pylist())
                best = e.argmin(axis=1)
                low = e[np.arange(size), best]
                margin = (np.partition(e, 1, axis=1)[:, 1] if e.shape[1] > 1 else low + 1) - low
                score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -30, 30))), 0.0)
                lang = [m.languages[k] if c else UNDETERMINED for k, c in zip(best, n, strict=True)]
                limit = np.array(m.limits or [np.inf] * len(m.languages))[best]
                rejected = (n == 0) | (low > limit)
                low = [x if c else None for x, c in zip(low.tolist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang), pa.array(score), pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return d.mapInArrow(run, OUT)
