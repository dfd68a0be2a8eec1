"""A counterfactual-regularised toxicity classifier.

Logistic regression over the presence of words and word beginnings.  Identity
terms in labelled texts are swapped for others, and the squared change of the
logit is a penalty in the loss, so a group's mere mention moves no score.
Each term is swapped for every other of its group and for a word without
features: terms of a group thus weigh alike, and none of them much.
The classifier is fitted on a bounded sample of labelled rows; every text is
scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch, hold, scan, tune
from mnemora.llm.decontam import words

#: Labelled rows that a classifier is fitted on, by lowest hash of the id.
SAMPLE = 20_000
THRESHOLD = 0.7
#: Weight of the counterfactual penalty, and of the squared weights.
SWAP, RIDGE = 1.0, 0.02
#: Lengths in characters of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
#: Least log-likelihood ratio of a feature with the label, about a chance of one in 600.
EVIDENCE = 10.0
CACHE_WORDS = 200_000

# Identity terms, fixed values: groups whose terms are exchanged for one another, in English, German, Spanish and French.
IDENTITY = {
    "religion en": ["atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant", "sikh"],
    "religion de": ["atheisten", "buddhisten", "christen", "hindus", "juden", "katholiken", "muslime", "protestanten"],
    "religion es": ["ateos", "budistas", "católicos", "cristianos", "hindúes", "judíos", "musulmanes", "protestantes"],
    "religion fr": ["athées", "bouddhistes", "catholiques", "chrétiens", "hindous", "juifs", "musulmans", "protestants"],
    "origin en": ["african", "american", "arab", "asian", "black", "european", "immigrant", "indian", "latino", "white"],
    "origin de": ["afrikaner", "amerikaner", "araber", "asiaten", "einwanderer", "europäer", "türken"],
    "origin es": ["africanos", "americanos", "árabes", "asiáticos", "europeos", "gitanos", "inmigrantes"],
    "origin fr": ["africains", "américains", "arabes", "asiatiques", "européens", "immigrés", "roms"],
    "gender en": ["female", "male", "man", "men", "transgender", "woman", "women"],
    "gender de": ["frau", "frauen", "mann", "männer", "transgender"],
    "gender es": ["hombre", "hombres", "mujer", "mujeres", "transgénero"],
    "gender fr": ["femme", "femmes", "homme", "hommes", "transgenre"],
    "orientation en": ["bisexual", "gay", "heterosexual", "homosexual", "lesbian", "straight"],
    "orientation de": ["bisexuelle", "heterosexuelle", "lesben", "schwule"],
    "orientation es": ["bisexuales", "gais", "heterosexuales", "lesbianas"],
    "orientation fr": ["bisexuels", "gays", "hétérosexuels", "lesbiennes"],
    "ability en": ["blind", "deaf", "disabled", "elderly", "young"],
    "ability de": ["alte", "behinderte", "blinde", "gehörlose", "junge"],
    "ability es": ["ancianos", "ciegos", "discapacitados", "jóvenes", "sordos"],
    "ability fr": ["aveugles", "handicapés", "jeunes", "sourds", "vieux"],
}


def features(word: bytes) -> list[bytes]:
    """A word's features: itself, and for longer words its beginnings, marked by a final hyphen."""
    chars = word.decode()
    return [word, *(chars[:n].encode() + b"-" for n in STEMS if len(chars) > n)]


#: The features of the words seen last, and the weights that they belong to.
_SEEN: dict[bytes, tuple[bytes, ...]] = {}
_OF: dict[str, dict] = {}


def _forget() -> None:
    _SEEN.clear()
    _OF.clear()


@dataclass
class Classifier:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -3.0

    def present(self, text: str | None) -> set[bytes]:
        """The classifier's features that a whole text has."""
        cache, own = _SEEN, self.weights
        if len(cache) > CACHE_WORDS or _OF.get("weights") is not own:
            cache.clear()
            _OF["weights"] = own
        hold("toxicity", _forget)
        out: set[bytes] = set()
        for w in set(words(text or "")):
            got = cache.get(w)
            if got is None:
                cache[w] = got = tuple(f for f in features(w) if f in own)
            if got:
                out.update(got)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.present(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: list[list[int]], y: np.ndarray, swapped: list[tuple[list[int], list[int]]], n: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss, the ridge and the swap penalty.

    ``x`` has each row's features, ``swapped`` the features that each swap
    takes from a labelled row and adds to it.  Steps are diagonally scaled gradient steps:
    each coordinate's curvature is bounded by a quarter of its rows, times the
    most features of a row, so the loss falls at every step.
    """
    flat = lambda lists: np.concatenate([np.asarray(r, dtype=np.int64) for r in lists]) if lists else np.zeros(0, np.int64)
    rows, cols = np.repeat(np.arange(len(x)), [len(r) for r in x]), flat(x)
    both = [[*a, *b] for a, b in swapped]
    pair, pair_cols = np.repeat(np.arange(len(both)), [len(r) for r in both]), flat(both)
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in swapped]) if swapped else np.zeros(0)
    most = max([len(r) for r in x], default=0) + 1
    most_pair = max([len(r) for r in both], default=0)
    curve = np.bincount(cols, minlength=n) * most / 4 + 2 * SWAP * most_pair * np.bincount(pair_cols, minlength=n) + RIDGE
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    v, vb = w, b
    for k in range(steps):
        z = np.bincount(rows, weights=v[cols], minlength=len(x)) + vb
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(cols, weights=err[rows], minlength=n) + RIDGE * v
        if len(both):
            change = np.bincount(pair, weights=sign * v[pair_cols], minlength=len(both))
            grad += 2 * SWAP * np.bincount(pair_cols, weights=sign * change[pair], minlength=n)
        w_new, b_new = v - grad / curve, vb - err.sum() / max(len(x) * most / 4, 1)
        mix = k / (k + 3)
        v, vb = w_new + mix * (w_new - w), b_new + mix * (b_new - b)
        w, b = w_new, b_new
    return w, float(b)


def counterfactuals(there: set[bytes], groups: list[list[bytes]]) -> list[tuple[bytes, bytes | None]]:
    """The swaps of a text's words: each identity term for every other of its group that the text lacks, and for none."""
    return [(t, o) for group in groups for t in group if t in there for o in [None, *(o for o in group if o not in there)]]


def fold(column, n: int):
    """The fold of an id: CRC-32 of its decimal digits, modulo n; null counts as fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, held_fold: int = 1, folds: int = 3, sample: int = SAMPLE, identity: dict[str, list[str]] = IDENTITY) -> Classifier:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, those of lowest hashed id;
    equal texts among them count once.

    Null labels and ids, and labels without a document, are left out; an id
    with several labels, or a text with several, counts as toxic if one says
    so.  Without labelled rows, or with labels of one kind
    only, the classifier has no features and scores every text below a half.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    key = F.col("doc_id").cast("long")
    chosen = labels.select(key.alias("labelled_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(fold(F.col("labelled_id"), folds) != held_fold)
    d = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = chosen.groupBy("labelled_id").agg(F.max("toxic").alias("toxic")).join(d.select(F.col("doc_id").alias("labelled_id")), "labelled_id", "left_semi")
    chosen = scratch.table("chosen", chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample))
    rows = d.join(F.broadcast(chosen), d["doc_id"] == chosen["labelled_id"]).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    rows = scratch.table("sample", rows.select("doc_id", "text", "toxic"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, list[int]] = {}
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for f in {f for w in set(words(text or "")) for f in features(w)}:
                seen.setdefault(f, [0, 0])[1 if toxic else 0] += 1
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())], ["f", "toxic", "clean"])

    rows_of = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    rate = (rows_of.get(True, 0) + 1) / (sum(rows_of.values()) + 2)
    counts = scan(rows, count, "f binary, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a feature must point to toxic texts more often than not, and beyond chance
    both = F.col("toxic") + F.col("clean")
    part = F.col("toxic") / both
    ratio = 2 * (F.col("toxic") * F.log(part / rate) + F.when(part < 1, F.col("clean") * F.log((1 - part) / (1 - rate))).otherwise(0))
    told = counts.filter((F.col("toxic") > 0) & (part >= 0.5)).withColumn("evidence", ratio).filter(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "f").collect()  # bounded by the sample
    terms = [t.encode() for group in identity.values() for t in group]
    names = list(dict.fromkeys([bytes(r["f"]) for r in told] + terms))
    at = {f: k for k, f in enumerate(names)}
    model = Classifier(dict.fromkeys(names, 0.0))
    groups = [[t.encode() for t in group] for group in identity.values()]

    def vector(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sorted(model.weights)
        place = {f: at[f] for f in own}
        x, y, swaps = [], [], []
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x.append(sorted(place[f] for f in model.present(text)))
            y.append(toxic)
            there = set(words(text or ""))
            swaps.append([changed(there, out, put) for out, put in counterfactuals(there, groups)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.int32()), pa.array(swaps, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["x", "y", "swapped"])

    def changed(there: set[bytes], out: bytes, put: bytes | None) -> list[list[int]]:
        """The features that a swap takes away and those that it adds; all others stay."""
        others = {f for w in there - {out} for f in features(w)}
        gone, come = set(features(out)) - others, set(features(put)) - others if put else set()
        return [sorted(at[f] for f in fs if f in at) for fs in (gone - come, come - gone)]

    got = scan(rows.orderBy("doc_id"), vector, "x array<int>, y int, swapped array<array<array<int>>>").collect()  # at most ``sample`` rows of few numbers
    scratch.drop()
    y = np.array([1.0 if r["y"] else 0.0 for r in got])
    if not told or not len(y) or y.min() == y.max():
        return Classifier()
    w, b = fit([r["x"] for r in got], y, [(a, b) for r in got for a, b in r["swapped"]], len(names))
    return Classifier({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, b)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_fold: int = 1, folds: int = 3) -> DataFrame:
    """Each document's score and prediction: (doc_id, held_out, score, predicted).

    Null and empty texts get the score of a text without features.  Null ids
    stay null and are not held out; repeated rows get equal scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_fold, folds))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id").cast("long"), folds) == held_fold).alias("held_out"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([model.value.score(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return scan(d, run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold.

    Null and empty texts stay, and so do rows with a null id; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return scan(docs, lambda b: b.filter(pa.array([model.value.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_())), docs.schema)
