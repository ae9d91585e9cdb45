import numpy as np
import pytest
from logloom.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, pivots string, n string"


def brute(ids, x, cosine):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    m = u @ u.T >= cosine
    np.fill_diagonal(m, False)
    return m


def planted(seed, n, dense):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 16)) * rng.uniform(0.02, 0.35, size=(n - n // 2, 1))
    x[:dense] = x[0] + rng.normal(size=(dense, 16)) * 0.05
    return x


@pytest.mark.parametrize("dense,chunk", [(1, 1024), (200, 30)])
def test_recall_counts_and_components(spark, dense, chunk):
    x = planted(3, 900, dense)
    ids = np.arange(900) * 3
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 0, "", "") for i, r in zip(ids, x)], SCHEMA).repartition(4)
    got = {r.vec_id: r for r in pivots.embedding_components(df, 0.95, chunk=chunk).collect()}
    m = brute(ids, x, 0.95)
    want = m.sum(1)
    have = np.array([got[int(i)].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum() and have.sum() % 2 == 0
    # no component joins what brute force keeps apart
    label = np.arange(900)
    while True:
        new = np.array([min(label[j] for j in [*np.flatnonzero(m[i]), i]) for i in range(900)])
        if (new == label).all():
            break
        label = new
    for i in range(900):
        c = got[int(ids[i])].component_id
        assert label[c // 3] == label[i] and got[int(ids[i])].kept == (c == ids[i])
    if have.sum() == want.sum():
        assert all(got[int(ids[i])].component_id == ids[label[i]] for i in range(900))


def test_invalid_vectors_and_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]), (8, [1.0, 2.0]), (9, []), (None, v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.embedding_components(spark.createDataFrame([(i, x, 0, "", "") for i, x in rows], SCHEMA), min_shared=1).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, False), **{i: (0, i, True) for i in range(3, 10)}}


def test_empty(spark):
    assert pivots.embedding_components(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("spread,chunk", [(0.0, 1024), (0.05, 1024), (0.05, 40)])
def test_one_cluster_with_the_defaults(spark, spread, chunk):
    rng = np.random.default_rng(5)
    x = rng.normal(size=16) + rng.normal(size=(150, 16)) * spread
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, "", "") for i, r in enumerate(x)], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.embedding_components(df, chunk=chunk).collect()}
    want = brute(np.arange(150), x, 0.95).sum(1)
    assert want.min() > 0 and got == {i: (want[i], 0, i == 0) for i in range(150)}


def test_lengths_doubles_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(60)] + [(100, [1.0] * 8), (101, [1.0] * 8), (102, [2.0] * 8)]
    rows += [(0, rows[1][1]), (110, [1e200, 1e200]), (111, [1e200, 1.0000001e200]), (112, [1e-300, 0.0]), (113, [1.0, 1e-9]), (114, [1.0])]
    got = pivots.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect())
    want = [(0, 0, 0, True), (0, 1, 0, True), (1, 1, 0, False)] + [(i, 0, i, True) for i in range(2, 60)]
    want += [(i, 2, 100, i == 100) for i in (100, 101, 102)] + [(110, 1, 110, True), (111, 1, 110, False), (112, 1, 112, True), (113, 1, 112, False), (114, 0, 114, True)]
    assert got == want


def test_double_precision_at_the_threshold(spark):
    a, b = [1.0, 0.0], [0.95, (1 - 0.95**2) ** 0.5 * (1 + 1e-12)]  # just under 0.95, by less than floats can tell
    assert np.float32(np.dot(a, b) / np.linalg.norm(b)) >= np.float32(0.95)
    got = pivots.embedding_components(spark.createDataFrame([(1, a), (2, b)], "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in got] == [0, 0]


@pytest.mark.parametrize("dims", [32, 64, 128])
def test_recall_in_more_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(1500, dims))
    x[750:] = x[:750] + rng.normal(size=(750, dims)) * rng.uniform(0.05, 0.33, size=(750, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    have = {r.vec_id: r.n_links for r in pivots.embedding_components(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert all(have[i] <= want[i] for i in range(1500)) and sum(have.values()) >= 0.9 * want.sum() > 900
