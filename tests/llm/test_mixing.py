import random
import tracemalloc

import numpy as np
import pytest
from logloom.llm import mixing

SCHEMA = "doc_id long, text string, p string, rate int, row string, x int"
WORDS = {"good": "alpha beta gamma delta", "poor": "### $$$ !!! ***", "toxic": "snarf grob zonk blat"}


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        d = rng.choices(["good", "poor", "toxic"], [0.6, 0.3, 0.1])[0]
        own, common = WORDS[d].split(), WORDS["good"].split()
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.7 else common) for _ in range(rng.randint(1, 120))), "a", 5, "r", 0))
        labels.append((i, 0 if d == "poor" else 1, int(d == "toxic")))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA).repartition(3), mixing.domain_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_targets_are_met(spark):
    rows, labels = corpus()
    rows += [(900, None, "", 0, "", 0), (901, "", "", 0, "", 0), (None, "alpha beta", "", 0, "", 0), (3, rows[3][1], "", 0, "", 0), (902, "alpha " * 20000, "", 0, "", 0)]
    df, lab = frames(spark, rows, labels + [(None, 1, 1), (5000, 1, 0), (7, None, None)])
    targets = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    got = mixing.mixing_rates(df, lab, targets, 1.2).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    p = got[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    s = (got.rate * got.n_tokens).to_numpy() @ p / got.n_tokens.sum()
    assert np.allclose(s, 1.2 * np.array([0.7, 0.2, 0.1]), atol=1e-4)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.ceil(got.rate))).all()
    truth = {i: "toxic" if t else "good" if q else "poor" for i, q, t in labels}
    known = got[got.doc_id.isin(truth) & (got.n_tokens > 20)]
    guess = known[["p_good", "p_poor", "p_toxic"]].to_numpy().argmax(1)
    assert np.mean([["good", "poor", "toxic"][g] == truth[i] for g, i in zip(guess, known.doc_id)]) > 0.95


def test_clipped_rates_reach_the_least_squares_optimum(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 50, 60)
    t = [0.98, 0.01, 0.01]
    table = spark.createDataFrame([(int(a), [float(v) for v in q]) for a, q in zip(n, p)], "n_tokens long, p array<double>")
    gradients = mixing.fit(table, t, 1.0, passes=40)
    r = mixing._rates(p, gradients)
    loss = lambda r: np.square((r * n) @ p / n.sum() - t).sum()
    best = np.ones(60)
    for _ in range(50_000):
        best = np.maximum(0, best - 0.5 * p @ ((best * n) @ p / n.sum() - t))
    assert (r >= 0).all() and (r == 0).any() and loss(r) <= loss(best) + 1e-6


@pytest.mark.parametrize("budget", [1.1])
def test_resample_keeps_columns_and_good_documents(spark, budget):
    rows, labels = corpus(4)
    df, lab = frames(spark, rows, labels)
    out = mixing.resample(df, lab, {"good": 0.95, "poor": 0.03, "toxic": 0.02}, budget)
    assert out.columns == df.columns
    got = out.collect()
    kept = {r.doc_id for r in got}
    strong = [i for i, q, t in labels if q and not t and len(rows[i][1].split()) > 20]
    assert all(i in kept for i in strong) and len(kept) < len(rows)
    assert {(r.doc_id, r.text, r.p, r.rate, r.row, r.x) for r in got} <= set(rows)


def test_empty_and_unlabelled(spark):
    none = mixing.domain_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixing_rates(empty, none, {"good": 1.0}).collect() == []
    one = mixing.mixing_rates(spark.createDataFrame([(1, "a b", "", 0, "", 0)], SCHEMA), none, {"good": 1.0, "poor": 1.0}).collect()
    assert one[0].p_good == one[0].p_poor == 0.5 and abs(one[0].rate - 1) < 1e-6


def instance(rng):
    k = int(rng.integers(2, 5))
    p = rng.dirichlet(rng.uniform(0.1, 1.0, k), 40)
    return p, rng.integers(0, 60, 40), rng.uniform(0.5, 2.0) * rng.dirichlet(rng.uniform(0.1, 1.0, k))  # many targets can't be met


def sums(p, n, shift, least):
    u = 1 - p @ shift
    r, free = np.maximum(least, u), u >= least
    return (r * n) @ p, (p * (n * free)[:, None]).T @ p, (n * np.where(free, u * u / 2, u * least - least * least / 2)).sum()


def optimum(p, n, t, least):
    """Accelerated projected gradient with restarts."""
    best, prior, i = np.ones(len(n)), np.ones(len(n)), 0
    for _ in range(20_000):
        ahead = best + i / (i + 3) * (best - prior)
        new = np.maximum(least, ahead - p @ ((ahead * n) @ p / n.sum() - t))
        i = 0 if ((ahead - new) * (new - best) * n).sum() > 0 else i + 1
        prior, best = best, new
    return best


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_random_instances_reach_the_optimum_with_and_without_a_least_rate(spark, monkeypatch, least):
    rng = np.random.default_rng(7 + int(least))
    for case in range(41):
        p, n, t = instance(rng)
        table = spark.createDataFrame([(int(a), [float(v) for v in q]) for a, q in zip(n, p)], "n_tokens long, p array<double>")
        if case == 0:  # one instance by Spark's sums, the others by the same sums in numpy
            for a, b in zip(mixing._sums(table, np.arange(p.shape[1]) / 2.0, least), sums(p, n, np.arange(p.shape[1]) / 2.0, least)):
                assert np.allclose(a, b)
            found = mixing.solve(table, list(t), t.sum(), least)
            monkeypatch.setattr(mixing, "_sums", lambda table, shift, least: sums(*table, shift, least))
            monkeypatch.setattr(mixing, "_tokens", lambda table: float(table[1].sum()))
        else:
            found = mixing.solve((p, n), list(t), t.sum(), least)
        r = mixing._rates(p, [found.shift], least)
        off = lambda r: (r * n) @ p / n.sum() - t
        assert (r >= least).all() and found.converged
        assert np.square(off(r)).sum() <= np.square(off(optimum(p, n, t, least))).sum() + 1e-5, case
        assert np.allclose(found.reached, (r * n) @ p / n.sum()) and found.residual == pytest.approx(np.abs(off(r)).max())


def test_resample_with_clashing_names(spark):
    rows, labels = corpus(2, 60)
    df, lab = frames(spark, rows, labels)
    df = df.toDF("doc_id", "text", "_n", "_p", "_copies", "_score")
    out = mixing.resample(df, lab, {"good": 0.8, "poor": 0.1, "toxic": 0.1})
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)


def test_no_text_is_written_and_each_row_is_scored_once_at_the_end(spark, monkeypatch):
    rows, labels = corpus()
    df, lab = frames(spark, rows, labels)
    written, real = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda t, name: written.append(t.columns) or real(t, name))
    out = mixing.resample(df, lab, {"good": 0.8, "poor": 0.1, "toxic": 0.1}, 1.3, 1.0)
    assert written and not any("text" in c for c in written)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in rows}


def test_training_holds_the_sample_in_doubles_by_blocks():
    rows = [(f"w{i} w{i % 7}", i % 3) for i in range(2000)]
    tracemalloc.start()
    mixing.train(rows, 3, steps=2)
    assert tracemalloc.get_traced_memory()[1] < len(rows) * mixing.BUCKETS * 8
    tracemalloc.stop()
