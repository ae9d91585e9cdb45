"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

What is known: trusted positives (documents labelled good; a bounded sample of `trusted` of them) and unlabelled text (every
document, its label unread). No negative label is ever used. Let a be the share of good documents, l the logistic loss. The risk

    a E_P[l(g)] + max(0, E_U[l(-g)] - a E_P[l(-g)])

is minimised over g, a linear function of a text's traits, their squares and a constant. The part in the brackets estimates the
risk on poor documents; when it falls below zero the model overfits, so that part counts as zero and the step turns: it raises the
part again. Above zero the estimate is convex with this loss, and steps are Newton steps shortened until the risk falls.

The class prior a is estimated without negatives too: a first model tells half of the positives from unlabelled
text; among the texts that it scores above a threshold the share of unlabelled text over the share of the other half of the
positives is at least a, and the threshold with the smallest upper confidence bound on that ratio gives the estimate.

Traits are counted in one Arrow pass over whole texts and written once (some 90 bytes a document). Every step is an aggregate
over that table, so unlabelled text is used whole at any size; a pass returns a vector and a matrix of sums, added up in Spark.

Defined cases: null, empty and blank texts have all traits zero and are scored like any other; texts of any length are counted
whole; repeated rows count as often as they come; a null id counts as not held out and is scored; null labels, labels without a document
and labels other than 1 teach nothing; without positives every score is 0.5; without unlabelled text there are no rows to score. Extra columns are
ignored. Only the text is an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize
from .texthash import Joined, release, text_batches

TRUSTED = 20_000
FOLDS, FOLD = 4, 2
STEPS, TRIES = 20, (1.0, 0.5, 0.2, 0.05, 0.01)
RIDGE = 5.0
BINS = 1000
TRAITS = (
    "words", "characters a word", "characters a word, spread", "upper", "digits", "space", "stops", "marks", "symbols", "beyond ascii", "different words", "most frequent word",
    "different pairs", "different triples", "words without a letter", "words that end in a symbol", "lines", "repeated lines", "words a stop", "words that start upper",
)
_KINDS = {"space": b" \t\n\x0b\x0c\r", "stops": b".?;:", "marks": b",'\"()-!/", "digits": b"0123456789"}


def _byte_kinds() -> np.ndarray:
    """0 letter, 1 upper, 2 digit, 3 space, 4 stop, 5 mark, 6 other symbol, 7 beyond ASCII (continuation bytes: 8)."""
    kind = np.full(256, 6, np.int64)
    kind[97:123], kind[65:91], kind[128:192], kind[192:] = 0, 1, 8, 7
    for number, name in ((2, "digits"), (3, "space"), (4, "stops"), (5, "marks")):
        kind[list(_KINDS[name])] = number
    return kind


_KIND = _byte_kinds()


def _runs(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values, count of the most frequent value) of each text."""
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    start = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))) if len(o) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((start, [len(o)])))
    most = np.zeros(texts)
    np.maximum.at(most, o[start], size)
    return np.bincount(o[start], minlength=texts), most


def traits(texts: list[bytes]) -> np.ndarray:
    """A row of TRAITS for each text: counts are logarithms, all else shares."""
    out = np.zeros((len(texts), len(TRAITS)))
    if not texts:
        return out
    put = lambda name, x: out.__setitem__((slice(None), TRAITS.index(name)), x)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(len(texts)), size) * 9 + _KIND[raw], minlength=9 * len(texts)).reshape(-1, 9)
    letters = np.maximum(1, kinds[:, 0] + kinds[:, 1] + kinds[:, 7])
    points = np.maximum(1, kinds[:, :8].sum(axis=1))
    put("upper", kinds[:, 1] / letters)
    for name, number in (("digits", 2), ("space", 3), ("stops", 4), ("marks", 5), ("symbols", 6), ("beyond ascii", 7)):
        put(name, kinds[:, number] / points)
    j = Joined(texts)
    n = np.diff(np.concatenate(([0], j.doc_ends)))
    some, owner = np.maximum(1, n), np.repeat(np.arange(len(texts)), n)
    long = (j.ends - j.starts).astype(float)
    mean = np.bincount(owner, long, len(texts)) / some
    put("words", np.log1p(n))
    put("characters a word", mean)
    put("characters a word, spread", np.sqrt(np.maximum(0, np.bincount(owner, long * long, len(texts)) / some - mean * mean)))
    different, most = _runs(owner, j.word_hashes(), len(texts))
    put("different words", different / some)
    put("most frequent word", most / some)
    for name, k in (("different pairs", 2), ("different triples", 3)):
        first, h = j.windows(k)
        put(name, _runs(owner[first], h, len(texts))[0] / np.maximum(1, n - k + 1))
    if len(owner):
        data = _KIND[np.frombuffer(j.data, np.uint8)]
        letter = np.concatenate(([0], np.cumsum((data < 2) | (data > 6))))
        put("words without a letter", np.bincount(owner, letter[j.ends] == letter[j.starts], len(texts)) / some)
        last = data[j.ends - 1]
        put("words that end in a symbol", np.bincount(owner, last == 6, len(texts)) / some)
        put("words a stop", np.log1p(n / (1 + np.bincount(owner, last == 4, len(texts)))))
        put("words that start upper", np.bincount(owner, data[j.starts] == 1, len(texts)) / some)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    count = np.fromiter(map(len, lines), np.int64, len(texts))
    put("lines", np.log1p(count))
    put("repeated lines", (count - np.fromiter((len(set(x)) for x in lines), np.int64, len(texts))) / np.maximum(1, count))
    out[n == 0] = 0
    return out


def trait_table(docs: DataFrame) -> DataFrame:
    """doc_id and traits (float32, packed) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for at, some in text_batches(texts):
                x = traits(some).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "traits"])
        release()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, traits binary")


def _matrix(column: pa.Array | list[bytes]) -> np.ndarray:
    rows = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(-1, len(TRAITS)).astype(float)


def _sums(table: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of what `of` (traits as a matrix -> vector of `width` sums) gives. Added up in Spark: `width` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                total += of(_matrix(b.column(0).slice(at, 8192)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    out = np.zeros(width)
    for r in table.select("traits").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


class Model:
    """g of traits: linear in standardised traits, their squares and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, w: np.ndarray | None = None):
        self.mean, self.spread = mean, spread
        self.w = np.zeros(2 * len(mean) + 1) if w is None else w

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack((np.ones((len(z), 1)), z, z * z / 6))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.w, -30, 30)))

    def with_weights(self, w: np.ndarray) -> Model:
        return Model(self.mean, self.spread, w)


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def non_negative_risk(prior: float, good: np.ndarray, good_as_poor: np.ndarray, unlabelled_as_poor: np.ndarray) -> np.ndarray:
    """The risk from the mean losses of positives as good and as poor, and of unlabelled text as poor."""
    return prior * good + np.maximum(0, unlabelled_as_poor - prior * good_as_poor)


def _fit(table: DataFrame, n: int, positives: np.ndarray, prior: float | None, model: Model) -> Model:
    """The least risk with `prior`; with None, positives against unlabelled text (both with weight one half)."""
    xp, d = model.inputs(positives), len(model.w)
    w = model.w.copy()

    def at_unlabelled(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            f = model.inputs(x)
            g = f @ w
            p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            return np.concatenate(([_loss(-g).sum()], p @ f, ((f * (p * (1 - p))[:, None]).T @ f)[np.triu_indices(d)]))

        s = _sums(table, of, 1 + d + d * (d + 1) // 2) / n
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = s[1 + d :]
        return s[0], s[1 : 1 + d], h + np.triu(h, 1).T

    def at_positives(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
        g = xp @ w
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        return _loss(g).mean(), _loss(-g).mean(), (p - 1) @ xp / len(xp), p @ xp / len(xp), (xp * (p * (1 - p))[:, None]).T @ xp / len(xp)

    # weights are standard normal beforehand: what few positives say counts less
    ridge = np.full(d, RIDGE / len(xp))
    ridge[0] = 0

    def risk(w: np.ndarray, unlabelled: float) -> float:
        good, poor = at_positives(w)[:2]
        return (0.5 * (good + unlabelled) if prior is None else float(non_negative_risk(prior, good, poor, unlabelled))) + 0.5 * float(ridge @ (w * w))

    for _ in range(STEPS):
        u, gu, hu = at_unlabelled(w)
        _, poor, g_good, g_poor, hp = at_positives(w)
        if prior is None:
            gradient, curve = 0.5 * (g_good + gu), 0.5 * (hp + hu)
        elif u - prior * poor >= 0:
            # the losses of a positive as good and as poor differ by g: what is left is convex
            gradient, curve = prior * (g_good - g_poor) + gu, hu
        else:
            gradient, curve = prior * g_poor - gu, hu
        gradient = gradient + ridge * w
        step = np.linalg.solve(curve + np.diag(ridge + 1e-6), gradient)
        tried = [w - t * step for t in TRIES]
        losses = _sums(table, lambda x, tried=tried: np.array([_loss(-(model.inputs(x) @ v)).sum() for v in tried]), len(tried)) / n
        risks = [risk(v, x) for v, x in zip(tried, losses)]
        best, now = int(np.argmin(risks)), risk(w, u)
        if not risks[best] < now:
            break
        w = tried[best]
        if now - risks[best] < 1e-5 * abs(now):
            break
    return model.with_weights(w)


def class_prior(positive_counts: np.ndarray, unlabelled_counts: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in unlabelled text, from counts of scores in bins: the best bin's ratio, by the smallest upper confidence bound."""
    above = lambda c: np.cumsum(c[::-1])[::-1] / max(1, c.sum())
    p, u = above(positive_counts), above(unlabelled_counts)
    width = sum(math.sqrt(math.log(4 / delta) / (2 * max(1, c.sum()))) for c in (positive_counts, unlabelled_counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(p > 0, (u + width) / p, np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(u[best] / p[best], 0.01, 0.99)) if np.isfinite(bound[best]) else 0.5


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(BINS - 1, (scores * BINS).astype(np.int64)), minlength=BINS).astype(float)


def positive_rows(table: DataFrame, labels: DataFrame, most: int) -> np.ndarray:
    """Traits of at most `most` documents labelled good, none of the held-out fold: the same for the same labels, in order of a hash."""
    usable = labels.where("doc_id is not null and quality = 1").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != FOLD)
    picked = usable.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # rows with the same id are one sample, so what is collected stays bounded
    found = table.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("traits").alias("traits"))
    return _matrix([bytes(r.traits) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()])


def fit(table: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> tuple[Model, float] | None:
    """(model, class prior) of a table of traits; None without positives."""
    positives = positive_rows(table, labels, trusted)
    if len(positives) < 4:
        return None
    k = len(TRAITS)
    s = _sums(table, lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0))), 2 * k + 1)
    n = int(s[0])
    mean = s[1 : k + 1] / n
    blank = Model(mean, np.sqrt(np.maximum(s[k + 1 :] / n - mean * mean, 1e-6)))
    first = _fit(table, n, positives[::2], None, blank)
    prior = class_prior(_bins(first.score(positives[1::2])), _sums(table, lambda x: _bins(first.score(x)), BINS))
    return _fit(table, n, positives, prior, blank), prior


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7, trusted: int = TRUSTED) -> DataFrame:
    """doc_id, held_out, score, predicted (score at `least` or more), class_prior of every row of docs."""
    table = materialize(trait_table(docs), "positive-traits")
    found = fit(table, labels, trusted)
    shared = docs.sparkSession.sparkContext.broadcast(found[0] if found else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = model.score(_matrix(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False))
    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), F.lit(found[1] if found else None).cast("double").alias("class_prior"))
