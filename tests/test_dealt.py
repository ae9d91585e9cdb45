from pyspark.sql import functions as F

from logloom.operators import correlation, render


def test_rows_without_a_key_are_dealt_out(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") < 3, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    right = spark.createDataFrame([("k0", 1), ("k1", 2), (None, 3)], "k string, v int").unionByName(spark.range(4000).select(F.concat(F.lit("z"), "id").alias("k"), F.lit(0).alias("v")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = correlation.left_join_dealt(left, right, "k", ["id"]).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.v for r in out if r.v is not None} == {0: 1, 1: 2} and len(out) == 4000 and {r.id for r in out if r.k is None} == set(range(3, 4000))
    sizes = [sum(r.p == p for r in out) for p in range(8)]
    assert max(sizes) < 1000  # a join on the null itself has all in one


def test_events_of_problems_are_dealt_into_parts(spark):
    issues = spark.createDataFrame([(1, d, [d * 10 + i for i in range(8)]) for d in range(50)], "log_id int, det_seq int, event_ids array<int>")
    events = spark.createDataFrame([(1, d * 10 + i, "T", i) for d in range(50) for i in range(1, 9)], "log_id int, id int, type string, line_number int")
    want = {d: " -> ".join(f"T @{i}" for i in range(1, 6)) for d in range(50)}
    for parts in (None, 13):
        out = render.problem_context(issues, events, parts=parts)
        assert {r.det_seq: r.timeline for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == 13
