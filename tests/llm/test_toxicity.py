import itertools
import math
import random

import numpy as np
from logloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string, toxic string"


def brute_marginals(emit, trans):
    n = len(emit)
    w = np.zeros(n)
    z, change = 0.0, np.zeros((2, 2))
    # a text's first tag comes from a start that is an even mix of both states
    for tags in itertools.product((0, 1), repeat=n):
        start = math.exp(trans[0, tags[0]]) + math.exp(trans[1, tags[0]])
        p = start * math.exp(sum(e for e, t in zip(emit, tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        z += p
        w += p * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            change[a, b] += p
    return w / z, change / z


def test_marginals_match_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 7, 3, 0, 10, 2])
    emit = rng.normal(size=sizes.sum()) * 2
    trans = rng.normal(size=(2, 2))
    got, change = toxicity.marginals(emit, sizes, trans, pairs=True)
    at, want, total = 0, [], np.zeros((2, 2))
    for n in sizes:
        if n:
            w, c = brute_marginals(emit[at : at + n], trans)
            want += w.tolist()
            total += c
        at += n
    assert np.allclose(got, want) and np.allclose(change, total)


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        ws = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}" for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                ws.insert(rng.randint(0, len(ws)), rng.choice(["grobble", "Grobbling!", "snarf,"]))
        rows.append((i, " ".join(ws), "s", "t"))
        labels.append((i, 1, y))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus(600)
    rows += [(900, None, "", ""), (901, "", "", ""), (902, " \n", "", ""), (None, "grobble", "", ""), (903, "pita kelo " * 9000 + "snarf grobble snarf", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df, lab).collect()}
    truth = {i: y for i, _, y in labels}
    held = [i for i in truth if toxicity.fold_of(i) == 0]
    assert all(got[i].held_out == (toxicity.fold_of(i) == 0) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score == got[902].score < 0.5
    assert got[903].predicted == 1 and got[None].held_out is False
    text = dict((r[0], r[1]) for r in rows)
    for i in held:
        for s in filter(None, got[i].spans.split(",")):
            a, b = map(int, s.split(":"))
            assert text[i][a:b].lower()[:4] in ("grob", "snar")


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    assert [r.score for r in toxicity.toxicity_scores(df, none).collect()] == [0.5]
    assert toxicity.toxicity_scores(spark.createDataFrame([], SCHEMA), none).collect() == []
