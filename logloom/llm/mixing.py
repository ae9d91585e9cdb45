"""Mixing to target weights with soft membership.

A softmax classifier over hashed words, trained on a bounded sample of labelled documents, gives
each document a posterior over domains. Rates r >= 0 are then fitted so that the expected tokens of each
domain, sum(r * tokens * posterior), match the targets: projected-gradient least squares, distributed. A pass is one
aggregate over all documents, without Python: the residual of each domain gives a gradient, gradients add up, and a document's rate is one
less its part of their sum, projected on the bound (a lazy projection). So a rate is a function of the document's posterior and
as many numbers as there are domains, and a pass carries no other state. Gradients are taken per token: documents alike in
posterior get the same rate, whatever their length. The step along the summed gradient is scaled by the inverse of the merit's second derivative (a
Newton step on the sum), shortened until the merit falls; where that doesn't help, it is the plain gradient step. Targets that can't be met get the least-squares fit, and a warning with the shares reached.

Defined cases: null, empty and blank texts have no tokens, a posterior from the classifier's bias alone and the
rate that goes with it; repeated rows count as often as they come; null ids are mixed like others; null labels
and labels without a document teach nothing; without labels all posteriors are even; a target of a domain
that no document belongs to is missed and stays missed; an empty table gives no rows; extra columns are
kept by `resample`, whatever they are called, and ignored by `mixing_rates`.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize
from .texthash import Joined, release, text_batches

BUCKETS = 1 << 12
SAMPLE = 1000
#: Documents of the sample that are in doubles at once.
BLOCK = 256
PASSES = 80
TOLERANCE = 1e-5
#: Weights, one after another, of staying near a rate of one against the squared misfit.
KEEP = tuple(10.0**-i for i in range(1, 8))
log = logging.getLogger(__name__)


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic: toxic, else poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id is not null and domain is not null")


def _shares(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: share of its words in each bucket, and its number of words."""
    x, n = np.zeros((len(texts), buckets), np.float32), np.zeros(len(texts), np.int64)
    for at, some in text_batches(texts):
        j = Joined(some)
        size = np.diff(j.doc_ends, prepend=0)
        doc = np.repeat(np.arange(len(some)), size) + at
        np.add.at(x, (doc, (j.word_hashes() % np.uint64(buckets)).astype(np.int64)), 1)
        n[at : at + len(some)] = size
    x /= np.maximum(n, 1)[:, None].astype(np.float32)
    return x, n


def train(rows: list[tuple[str | None, int]], domains: int, buckets: int = BUCKETS, steps: int = 200) -> np.ndarray:
    """(buckets + 1) x domains weights; the last row is the bias."""
    w = np.zeros((buckets + 1, domains))
    if not rows:
        return w
    y = np.eye(domains)[[d for _, d in rows]]
    x, _ = _shares([(t or "").encode() for t, _ in rows], buckets)
    weight = (1 / np.maximum(y.sum(0), 1))[[d for _, d in rows]][:, None]
    scale, m = 30.0, np.zeros_like(w)
    for _ in range(steps):
        g = 1e-4 * w
        for at in range(0, len(x), BLOCK):  # in doubles only a block at a time: the driver holds this
            part = x[at : at + BLOCK].astype(np.float64)
            z = scale * (part @ w[:-1]) + w[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - y[at : at + BLOCK]) * weight[at : at + BLOCK]
            g[:-1] += scale * (part.T @ p)
            g[-1] += p.sum(0)
        m = 0.9 * m + g
        w -= 0.3 * m
    w[:-1] *= scale
    return w


def _own(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column is called so."""
    while name in columns:
        name = "_" + name
    return name


def posteriors(docs: DataFrame, weights: np.ndarray, n: str = "n_tokens", p: str = "p") -> DataFrame:
    """docs (with a column text) and n, its words, and p, the posterior of each domain.

    Only texts go to Python and only a few numbers a row come back: the other columns wait in the JVM."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("struct<n:long,p:array<double>>")
    def score(text: pa.Array) -> pa.Array:
        w, text = held.value, text.cast(pa.binary())
        buckets = len(w) - 1
        sizes, ps, at = [], [], 0
        while at < len(text):
            some, held_ = [], 0
            while at + len(some) < len(text) and len(some) < 1000 and held_ < 1 << 19:
                some.append(text[at + len(some)].as_py() or b"")
                held_ += len(some[-1])
            j = Joined(some)
            size = np.diff(j.doc_ends, prepend=0)
            full = np.flatnonzero(size)
            z = np.tile(w[-1], (len(some), 1))
            if len(full):
                own = w[(j.word_hashes() % np.uint64(buckets)).astype(np.int64)]
                z[full] += np.add.reduceat(own, (j.doc_ends - size)[full], axis=0) / size[full][:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            sizes.append(size)
            ps.append(p / p.sum(1, keepdims=True))
            at += len(some)
        release()
        give_back()
        n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        p = np.concatenate(ps) if ps else np.empty((0, w.shape[1]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], names=["n", "p"])

    both = _own(docs.columns, "_score")
    return docs.withColumn(both, score(F.col("text").cast("string"))).select(*docs.columns, F.col(both)["n"].alias(n), F.col(both)["p"].alias(p))


def _rates(p: np.ndarray, gradients: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """The rates of documents with posteriors p: one less the accumulated gradients, projected once."""
    return np.maximum(least, 1 - p @ np.sum(gradients, axis=0)) if gradients else np.maximum(least, np.ones(len(p)))


def _rate(shift: np.ndarray, least: float, p: Column) -> Column:
    return F.greatest(F.lit(float(least)), F.lit(1.0) - sum(p[i] * float(g) for i, g in enumerate(shift)))


def _sums(table: DataFrame, shift: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """At the rates of `shift`: expected tokens of each domain, the posteriors' Gram matrix over tokens of documents
    whose rate isn't at its bound, and the sum of tokens * (r^2 / 2, or its tangent where the bound holds)."""
    k = len(shift)
    n, p = F.col("n_tokens").cast("double"), F.col("p")
    u = F.lit(1.0) - sum(p[i] * float(g) for i, g in enumerate(shift))
    row = table.select(n.alias("n"), p.alias("p"), u.alias("u")).withColumn("r", F.greatest(F.lit(float(least)), F.col("u")))
    free = F.when(F.col("u") >= least, F.col("n")).otherwise(0.0)
    sums = [F.sum(F.col("r") * F.col("n") * p[i]).alias(f"s{i}") for i in range(k)]
    gram = [F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    half = F.sum(F.col("n") * F.when(F.col("u") >= least, F.col("u") * F.col("u") / 2).otherwise(F.col("u") * least - least * least / 2)).alias("half")
    got = row.agg(*sums, *gram, half).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = got[f"g{i}_{j}"] or 0.0
    return np.array([got[f"s{i}"] or 0.0 for i in range(k)]), g, got["half"] or 0.0


def _tokens(table: DataFrame) -> float:
    return float(table.agg(F.sum("n_tokens")).first()[0] or 0)


@dataclass
class Fit:
    """shift: the accumulated gradients; a document's rate is max(least, 1 - p . shift). reached and wanted: tokens of each domain as
    a share of those there are; converged: whether the passes were enough."""

    shift: np.ndarray
    reached: np.ndarray
    wanted: np.ndarray
    passes: int
    converged: bool

    @property
    def residual(self) -> float:
        return float(np.abs(self.reached - self.wanted).max(initial=0.0))


def solve(table: DataFrame, targets: list[float], budget: float, least: float = 0.0, passes: int = PASSES, tolerance: float = TOLERANCE) -> Fit:
    """Projected-gradient least squares in its lazy form: gradients add up in `shift` and the sum is projected on the bound.

    The objective is |A r - t|^2 / 2 + keep * |r - 1|^2 / 2 (norms weigh documents by tokens); the second part picks the rates nearest to one among
    those that fit alike, and falls from KEEP[0] to KEEP[-1] (or until the fit gains nothing), each start being the end before it. A pass gives the residual and the Gram matrix of
    unbounded documents, which scales the gradient. A scaled step has to lower the convex merit function whose gradient it is, else it is
    cut to a quarter, and in the end the plain step is taken, whose length of 1 / (1 + keep) is under the Lipschitz bound and always lowers it."""
    k = len(targets)
    wanted = budget * np.array(targets, float) / max(sum(targets), 1e-300)
    shift = np.zeros(k)
    total = _tokens(table)
    if total == 0:
        return Fit(shift, np.zeros(k), wanted, 0, True)

    def at(x: np.ndarray, keep: float):
        s, g, half = _sums(table, x, least)
        # the merit function, minus its gradient, its second derivative where it has one, and the tokens reached
        return half / total + wanted @ x + keep * (x @ x) / 2, s / total - wanted - keep * x, g / total + keep * np.eye(k), s / total

    used, best = 0, None
    for keep in KEEP:
        merit, up, curve, reached = at(shift, keep)
        used += 1
        while np.abs(up).max() > tolerance / 10 and used < passes:
            scaled, step = np.linalg.solve(curve, up), 1.0
            while True:
                plain = step < 1e-4
                tried = shift + (up / (1 + keep) if plain else step * scaled)
                found = at(tried, keep)
                used += 1
                if plain or found[0] <= merit - 1e-4 * step * (up @ scaled) + 1e-15:
                    break
                step /= 4
            shift, (merit, up, curve, reached) = tried, found
            if plain:  # what scaled steps could gain is under rounding
                break
        loss = float(np.square(reached - wanted).sum())
        gain = 0.0
        if best is None or loss < best[0]:
            gain, best = np.inf if best is None else best[0] - loss, (loss, shift, reached)
        if np.abs(reached - wanted).max() <= tolerance or used >= passes or gain < tolerance * loss / 10:
            break
    return Fit(best[1], best[2], wanted, used, used < passes)


def fit(table: DataFrame, targets: list[float], budget: float, least: float = 0.0, passes: int = PASSES, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The accumulated gradients that give every document's rate; see `solve`."""
    return [solve(table, targets, budget, least, passes, tolerance).shift]


def _fitted(scored: DataFrame, names: list[str], targets: dict[str, float], budget: float, least: float) -> Fit:
    found = solve(scored, [targets[d] for d in names], budget, least)
    if found.residual > 0.001 or not found.converged:
        shares = ", ".join(f"{d} {r:.4f} of {w:.4f}" for d, r, w in zip(names, found.reached, found.wanted))
        log.warning("mixing misses its targets (tokens over all tokens, reached of wanted): %s; %d passes, converged: %s", shares, found.passes, found.converged)
    return found


def classifier(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most `sample` labelled documents of each domain, the same for the same labels."""
    picked = None
    for d in names:
        some = labels.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    by_id = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with the same id are one sample, so what is collected stays bounded
    found = by_id.join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = [(r.text, names.index(r.domain)) for r in found.collect()]
    weights, taught = train(sorted(rows, key=lambda r: (r[1], r[0] or "")), len(names)), bool(rows)
    del rows
    give_back()
    # the sample has as many documents of each domain; posteriors are for the shares that all labels have
    count = {r.domain: r["count"] for r in labels.where(F.col("domain").isin(*names)).groupBy("domain").count().collect()}
    if taught:
        share = np.array([count.get(d, 0) + 0.5 for d in names])
        weights[-1] += np.log(share / share.sum())
    return weights


def _copies(rate: Column, doc_id: Column) -> Column:
    """rate rounded up or down by a number that its id fixes, so that the expected count is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 32)) / float(1 << 32)).cast("long")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = 1.0, least: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, p_<domain> of each target, rate, copies.

    targets: weight of each domain's tokens, scaled to sum to one; budget: expected tokens, as a multiple of those there are;
    least: no rate is under it (one keeps every document)."""
    names = sorted(targets)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(posteriors(src, classifier(docs, labels, names, sample)).drop("text"), "mixing-posteriors")
    shift = _fitted(table, names, targets, budget, least).shift
    out = table.withColumn("rate", _rate(shift, least, F.col("p")))
    return out.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)], "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = 1.0, least: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """docs with each row repeated as often as its rate says (rows of rate zero go); columns stay."""
    names = sorted(targets)
    n, p, copies, copy, stay = (_own(docs.columns, x) for x in ("_n", "_p", "_copies", "_copy", "_stay"))
    scored = posteriors(docs, classifier(docs, labels, names, sample), n, p)
    # the fit needs no text: what is written is a few numbers a row, and texts are scored again when they are repeated
    table = materialize(scored.select(F.col(n).alias("n_tokens"), F.col(p).alias("p")), "mixing-posteriors")
    shift = _fitted(table, names, targets, budget, least).shift
    discard(table)
    # a number that isn't deterministic keeps the filter above the scores: pushed below them, it would score once more
    counted = scored.withColumns({copies: _copies(_rate(shift, least, F.col(p)), F.col("doc_id").cast("long")), stay: F.monotonically_increasing_id()})
    counted = counted.where((F.col(copies) > 0) & (F.col(stay) >= 0))
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)
