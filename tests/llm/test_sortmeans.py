import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.sortmeans import cluster_digest, cluster_vectors, nearest, scan_orders

SCHEMA = "vec_id long, embedding array<float>, label int, distance string"


def brute(rows, k, rounds, length, seed=2, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == length and all(x is not None and math.isfinite(x) and abs(x) < 2**27 / scale for x in e)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cs = [list(v) for _, v in by_hash[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    per = {j: sum(d for d, c in found if c == j) for j in range(len(cs))}
    return sorted(((i is None, i or 0, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found)))


def held(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_against_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(150)]  # a coarse grid: many ties
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in range(150, 220)]
    rows += rows[:5] + [(None, [0.5, 0.5, 0.5, 0.5]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1e30, 0.0, 0.0, 0.0]), (906, [400.0, -900.5, 0.0, 3e4])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(5)
    for k, rounds in ((7, 5), (40, 3), (1, 2)):
        assert held(cluster_digest(df, k=k, rounds=rounds, length=4)) == brute(rows, k, rounds, 4)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    assert held(cluster_digest(df, length=2)) == brute(rows, 40, 5, 2)
    none = cluster_digest(df.where("vec_id > 9"), length=2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    assert cluster_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>")), length=2).count() == 0


def test_scan_prunes_and_misses_nothing():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (40, 8))
    x = centers[rng.integers(0, 40, 3000)] + rng.integers(-200, 200, (3000, 8))
    found, least, looked = nearest(x, rng.integers(0, 40, 3000), centers, *scan_orders(centers))
    d = ((x[:, None] - centers[None]) ** 2).sum(-1)
    assert (found == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    again, _, looked = nearest(x, found, centers, *scan_orders(centers))
    assert (again == found).all() and looked < 3000 * 40 / 4


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    import duckdb

    from logloom.llm import queries as q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = sorted(con.execute(q.oracle_sql()["op13_sortmeans"]).fetchall())
    got = sorted(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in q.queries()["op13_sortmeans"](spark, f"/root/testdata/{sf}").collect())
    assert got == want
