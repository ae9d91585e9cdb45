"""Toxicity: a two-tag linear-chain conditional random field over words.

Training (driver, on a bounded sample of labelled rows, `sample` documents a class): words of
toxic documents whose spelling, or four- or five-letter beginning, is far more frequent in toxic than in
clean documents are tagged toxic, all others clean; the field's weights (word, beginnings, tag
changes) are fitted to these tagged words by gradient steps on the exact conditional likelihood.
A logistic function of what the marginals of a document add up to is fitted to the document labels.

Scoring (Arrow batches, every whole text): forward-backward over chunks of words, joined
through the chunks' 2 x 2 transfer products, so long texts cost no more per word than short ones.
Marginals give the score; words with a marginal of a half or more give the offending offsets.

Defined cases: null, empty and blank texts have no words and get the score of no evidence; repeated
rows are scored as often as they come; a null id counts as held out of nothing
(held_out false) and is scored; labels that are null, or of unknown documents, teach nothing; without
labels of both classes the score is the share of toxic labels smoothed towards a half; an empty
table gives no rows; extra columns are ignored. Inputs of a score are the words of the text alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import fingerprint_texts

SAMPLE = 1500
FOLDS = 5
CHUNK = 64
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def features(word: bytes) -> list[bytes]:
    """The word in lower case without punctuation around it, and its beginnings."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGE.decode())
    return [b"w" + w.encode(), b"4" + w[:4].encode(), b"5" + w[:5].encode()] if len(w) > 2 else []


@dataclass
class Field:
    """Emission weights (toxic against clean), log transition odds and the document layer."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emission(self, word: bytes) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of every word; emit is flat, sizes the words of each text. With `pairs`, also the
    expected number of each tag change over all texts."""
    n, out = len(emit), np.zeros(len(emit))
    change = np.zeros((2, 2))
    if not n:
        return (out, change) if pairs else out
    full = np.flatnonzero(sizes)
    chunks = -(-sizes[full] // CHUNK)
    total = int(chunks.sum())
    text_of = np.repeat(np.arange(len(full)), chunks)
    first_chunk = np.cumsum(chunks) - chunks
    number = np.arange(total) - first_chunk[text_of]
    begin = (np.cumsum(sizes[full]) - sizes[full])[text_of] + number * CHUNK
    width = np.minimum(CHUNK, sizes[full][text_of] - number * CHUNK)
    e = np.zeros((CHUNK, total))
    at = np.arange(CHUNK)[:, None]
    real = at < width[None, :]
    where = np.minimum(begin[None, :] + at, n - 1)
    e[real] = np.exp(np.clip(emit[where[real]], -30, 30))
    t00, t01, t10, t11 = np.exp(trans).ravel()
    # transfer product of each chunk: state before its first word -> state after its last
    p = np.zeros((total, 2, 2))
    p[:, 0, 0] = p[:, 1, 1] = 1.0
    for k in range(CHUNK):
        live = real[k][:, None]
        a, b = p[:, :, 0], p[:, :, 1]
        p = np.where(live[..., None], np.stack((a * t00 + b * t10, (a * t01 + b * t11) * e[k][:, None]), axis=2), p)
        if k % 8 == 7:
            p /= p.sum(axis=(1, 2))[:, None, None]
    p /= p.sum(axis=(1, 2))[:, None, None]
    before, after = np.ones((total, 2)), np.ones((total, 2))
    v, u = np.ones((len(full), 2)), np.ones((len(full), 2))
    for k in range(int(chunks.max())):
        has = np.flatnonzero(chunks > k)
        c = first_chunk[has] + k
        before[c] = v[has]
        w = np.einsum("ni,nij->nj", v[has], p[c])
        v[has] = w / w.sum(axis=1, keepdims=True)
        c = first_chunk[has] + chunks[has] - 1 - k
        after[c] = u[has]
        w = np.einsum("nij,nj->ni", p[c], u[has])
        u[has] = w / w.sum(axis=1, keepdims=True)
    fw = np.zeros((CHUNK, total, 2))
    v = before
    for k in range(CHUNK):
        w = np.stack((v[:, 0] * t00 + v[:, 1] * t10, (v[:, 0] * t01 + v[:, 1] * t11) * e[k]), axis=1)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        v = np.where(real[k][:, None], w, v)
        fw[k] = v
    u = after
    prob = np.zeros((CHUNK, total))
    for k in range(CHUNK - 1, -1, -1):
        both = fw[k] * u
        prob[k] = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
        if pairs:
            prev = fw[k - 1] if k else before
            j = prev[:, :, None] * np.array([[t00, t01], [t10, t11]])[None] * np.stack((np.ones(total), e[k]), axis=1)[:, None, :] * u[:, None, :]
            j /= np.maximum(j.sum(axis=(1, 2)), 1e-300)[:, None, None]
            # the first word of a text has no word before it
            change += j[real[k] & ((number > 0) | (k > 0))].sum(axis=0)
        w = np.stack((u[:, 0] * t00 + u[:, 1] * e[k] * t01, u[:, 0] * t10 + u[:, 1] * e[k] * t11), axis=1)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        u = np.where(real[k][:, None], w, u)
    out[where[real]] = prob[real]
    return (out, change) if pairs else out


def summary(prob: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: 1, log of one plus the expected toxic words, the largest marginal."""
    x = np.zeros((len(sizes), 3))
    x[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        x[full, 1] = np.log1p(np.add.reduceat(prob, starts))
        x[full, 2] = np.maximum.reduceat(prob, starts)
    return x


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (l2 + 1e-6) * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -4, 4)
    return w


def _unlike(rows: list[tuple[str, int]], bits: int = 4) -> list[tuple[str, int]]:
    """rows without blank texts, and of those with one label whose fingerprints differ in at most `bits` bits only the first in
    order: a text that was copied teaches once. The sample is bounded, so are the pairs."""
    rows = sorted({(t, y) for t, y in rows if t.strip()})
    fps = fingerprint_texts([t.encode() for t, _ in rows])
    kept: list[tuple[str, int]] = []
    held = {0: np.empty(len(rows), np.uint64), 1: np.empty(len(rows), np.uint64)}
    n = {0: 0, 1: 0}
    for (t, y), f in zip(rows, fps):
        if not n[y] or np.bitwise_count(held[y][: n[y]] ^ f).min() > bits:
            held[y][n[y]] = f
            n[y] += 1
            kept.append((t, y))
    return kept


def train(rows: list[tuple[str | None, int]], steps: int = 30, l2: float = 1e-3) -> Field:
    """rows: (text, toxic). Near copies with one label teach once."""
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    prior = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    model = Field(layer=np.array([math.log(prior / (1 - prior)), 0.0, 0.0]))
    kept = _unlike(rows)
    if len({y for _, y in kept}) < 2:
        return model
    docs = [(t.encode().split(), y) for t, y in kept]
    known: dict[bytes, list[bytes]] = {}
    df = (Counter(), Counter())
    for ws, y in docs:
        fs = set()
        for w in set(ws):
            if w not in known:
                known[w] = features(w)
            fs.update(known[w])
        df[y].update(fs)
    n = [sum(1 for _, y in docs if y == k) for k in (0, 1)]
    least, often = max(3, n[1] // 200), max(3, n[1] // 50)
    odds = {f: math.log((c + 0.5) / (n[1] + 1)) - math.log((df[0][f] + 0.5) / (n[0] + 1)) for f, c in df[1].items() if c >= often}
    toxic = {f for f, o in odds.items() if o >= 3}
    names = sorted(f for f in set(df[0]) | set(df[1]) if df[0][f] + df[1][f] >= least)
    index = {f: i for i, f in enumerate(names)}
    vocab = {w: i for i, w in enumerate(known)}
    rows_i, cols_i = [], []
    for w, i in vocab.items():
        for f in known[w]:
            if f in index:
                rows_i.append(i)
                cols_i.append(index[f])
    rows_i, cols_i = np.array(rows_i, np.int64), np.array(cols_i, np.int64)
    is_toxic = np.array([any(f in toxic for f in known[w]) for w in vocab], bool)
    tokens = np.array([vocab[w] for ws, _ in docs for w in ws], np.int64)
    sizes = np.array([len(ws) for ws, _ in docs], np.int64)
    gold = is_toxic[tokens] & np.repeat(np.array([y for _, y in docs], bool), sizes)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes)[:-1]] = False
    inner[0] = False
    seen_change = np.zeros((2, 2))
    np.add.at(seen_change, (gold[:-1].astype(int)[inner[1:]], gold[1:].astype(int)[inner[1:]]), 1)
    seen_word = np.bincount(tokens, gold.astype(float), len(vocab))
    theta, acc = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)
    theta[-1] = model.bias
    trans, acc_t = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    total = max(1.0, float(gold.sum()))
    for _ in range(steps):
        emit = theta[-1] + np.bincount(rows_i, theta[cols_i], len(vocab))
        prob, change = marginals(emit[tokens], sizes, trans, pairs=True)
        off = (np.bincount(tokens, prob, len(vocab)) - seen_word) / total
        g = np.concatenate((np.bincount(cols_i, off[rows_i], len(names)), [off.sum()])) + l2 * theta / total
        gt = (change - seen_change) / total + l2 * trans
        acc += g * g
        acc_t += gt * gt
        theta -= 0.5 * g / np.sqrt(acc)
        trans -= 0.1 * gt / np.sqrt(acc_t)
    model.bias, model.trans = float(theta[-1]), trans - trans[0, 0]
    model.weights = {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 0.02}
    emit = theta[-1] + np.bincount(rows_i, theta[cols_i], len(vocab))
    model.layer = _logistic(summary(marginals(emit[tokens], sizes, model.trans), sizes), np.array([y for _, y in docs], float))
    return model


class Scorer:
    def __init__(self, model: Field, most: int = 500_000):
        self.model, self.most, self.known = model, most, {}

    def score(self, texts: list[bytes]):
        """(scores, spans): spans of a text as (start, end) in code points."""
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        if len(self.known) > self.most:
            self.known.clear()
        for w in set().union(*split).difference(self.known) if split else ():
            self.known[w] = self.model.emission(w)
        emit = np.fromiter((e for ws in split for e in map(self.known.__getitem__, ws)), np.float64, int(sizes.sum()))
        prob = marginals(emit, sizes, self.model.trans)
        x = summary(prob, sizes)
        score = 1 / (1 + np.exp(-np.clip(x @ self.model.layer, -30, 30)))
        ends, spans = np.cumsum(sizes), [[] for _ in texts]
        hit = np.flatnonzero(prob >= 0.5)
        owner = np.searchsorted(ends, hit, side="right")
        for i in np.unique(owner):
            places = list(_WORD.finditer(texts[i].decode("utf-8", "replace")))
            spans[i] = [places[j].span() for j in hit[owner == i] - (ends[i] - sizes[i])]
        return score, spans


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str | None, int]]:
    """At most `sample` documents of each class, the same for the same labels; none of the held-out fold."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for y in (0, 1):
        some = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with the same id are one sample, so what is collected stays bounded
    found = src.join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in found.collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans ("start:end", comma-joined) of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels, sample)))

    def run(batches):
        scorer = Scorer(model.value)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            at, ids = 0, b.column(0)
            while at < len(texts):
                some, held = [], 0
                while at + len(some) < len(texts) and len(some) < 2000 and held < 2_000_000:
                    some.append(texts[at + len(some)].as_py() or b"")
                    held += len(some[-1])
                score, spans = scorer.score(some)
                joined = [",".join(f"{a}:{z}" for a, z in s) for s in spans]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(score), pa.array([len(s) for s in spans], pa.int64()), pa.array(joined, pa.string())], names=["doc_id", "score", "n_spans", "spans"])
                at += len(some)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = src.mapInArrow(run, "doc_id long, score double, n_spans long, spans string")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")
