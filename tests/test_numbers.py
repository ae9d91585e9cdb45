import random

from pyspark.sql import functions as F

from logloom.functions.numbers import exact_sum, half_up
from logloom.operators import scoring
from logloom.queries import QUERIES


def _events(spark, path, users):
    rows = [(n, "2024-01-01", u, kind, v) for n, (u, kind, v) in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "props": F.lit("{}")}).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_halves_are_those_of_sql(spark):
    got = spark.createDataFrame([(1.005,), (0.285,), (8.345,), (-2.5,), (float("nan"),), (None,)], "x double").select(half_up(F.col("x"), 2).alias("two"), half_up(F.col("x"), 0).alias("none")).collect()
    # as DuckDB rounds them; the shortest decimals would give 1.01 and 0.29
    assert [r.two for r in got[:4]] == [1.0, 0.28, 8.35, -2.5] and [r.none for r in got[:4]] == [1.0, 0.0, 8.0, -3.0]
    assert got[4].two != got[4].two and got[5].two is None


def test_sums_in_any_order(spark):
    values = [random.Random(1).randint(1, 10**5) / 100 for _ in range(2000)]
    want = sum(round(100 * v) for v in values) / 100
    rows = [(0, v) for v in values] + [(1, v) for v in sorted(values)] + [(2, 1e30), (2, 1.0), (3, float("inf")), (4, None)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {0: want, 1: want, 2: 1e30, 3: float("inf"), 4: None}


def test_timeout_risk_at_a_half(spark, tmp_path):
    sf = _events(spark, tmp_path, [(1, "view", v) for v in (3000.0, *[0.1] * 5, 1.0)] + [(2, "view", 3728.5)])
    got = {r.log_id: (r.ms, r.severity, r.confidence) for r in QUERIES["cpu_timeout_risk"](spark, sf).collect()}
    assert got == {1: (3001.5, "MEDIUM", 0.8002), 2: (3728.5, "HIGH", 0.8728)}


#: Their sum is 350; added up in this order as doubles it is 350.00000000000006.
TIPPING = [18.51, 21.44, 89.41, 97.86, 29.18, 37.1, 56.5]


def test_an_average_on_the_bound_is_not_expensive(spark, tmp_path):
    sf = _events(spark, tmp_path, [(1, "signup", 500.0), (1, "purchase", 400.0), *[(1, "view", v) for v in TIPPING], (1, "error", 51.0)])
    assert {tuple(r) for r in QUERIES["expensive_methods"](spark, sf).collect()} == {(1, "error")}


def test_hotspots_with_equal_totals_go_by_their_first_call(spark, tmp_path):
    sf = _events(spark, tmp_path, [(1, "click", 350.0), *[(1, "view", v) for v in TIPPING], (1, "error", 100.0)])
    got = {(r.method, r.place): (r.own_ms, r.pct) for r in QUERIES["cpu_hotspots"](spark, sf).collect()}
    assert got == {("click", 1): (350.0, 43.75), ("view", 2): (350.0, 43.75)}


def test_health_at_a_half(spark):
    issues = [("CRITICAL", 0.58), ("HIGH", 0.81), ("LOW", 0.82), ("HIGH", 0.73), ("LOW", 0.7), ("CRITICAL", 0.55), ("LOW", 0.53)]  # cost 57.5
    orders = [issues, issues[::-1], sorted(issues), sorted(issues, key=lambda i: i[1])]
    rows = [(log, n, f"t{n}", s, c) for log, some in enumerate(orders) for n, (s, c) in enumerate(some)]
    df = spark.createDataFrame(rows, "log_id int, det_seq int, type string, severity string, confidence double").coalesce(1)
    assert {r.log_id: r.health for r in scoring.health_score(df).collect()} == dict.fromkeys(range(4), 43)
