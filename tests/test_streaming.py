from pyspark.sql import functions as F

from logloom.sources.logs import read_logs, skipped_files
from logloom.streaming import logs as S

LOG = "60.0 APEX_CODE,FINE\n09:00:00.1 (100)|EXECUTION_STARTED\n09:00:00.2 (200)|METHOD_ENTRY|[1]|A.f\n09:00:00.3 (300)|METHOD_EXIT|[1]|A.f\n"


def test_files_stream_as_tokens(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"l{i}.log").write_text(LOG)
    (tmp_path / "other.txt").write_text(LOG)
    out = S.run_to_memory(S.stream_tokens(S.stream_logs(spark, str(tmp_path))), "stream_tokens_test")
    got = sorted((r.log_id, r.line_number, r.event_type) for r in out.collect())
    assert got == [(f"l{i}", n, t) for i in range(3) for n, t in ((2, "EXECUTION_STARTED"), (3, "METHOD_ENTRY"), (4, "METHOD_EXIT"))]
    assert sorted(r.log_id for r in read_logs(spark, str(tmp_path), "*.log").collect()) == ["l0", "l1", "l2"]
    assert read_logs(spark, str(tmp_path), max_bytes=10).count() == 0
    assert sorted(map(tuple, skipped_files(spark, str(tmp_path), "*.log", max_bytes=10).collect())) == [(f"l{i}", len(LOG), "TOO_LARGE") for i in range(3)]
    assert skipped_files(spark, str(tmp_path)).count() == 0


def test_watch_counts_and_depths(spark, tmp_path):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, -1), ("b", 1, -1), ("b", 2, 1), ("a", 3, -1)]
    spark.createDataFrame(rows, "log_id string, id long, step int").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema("log_id string, id long, step int, ts timestamp").parquet(str(tmp_path / "s"))
    seen = S.run_to_memory(S.watch(stream().withColumn("key", F.concat("log_id", "id")), "ts", "key"), "watch_test")
    assert seen.count() == 5
    counts = S.run_to_memory(S.running_counts(stream(), ["log_id"]), "counts_test", "complete")
    assert {r.log_id: r.n for r in counts.collect()} == {"a": 4, "b": 2}
    depths = S.run_to_memory(S.call_depths(stream().where("not (log_id = 'a' and id = 3)"), idle=None), "depths_test")
    assert {(r.log_id, r.id): r.depth for r in depths.collect()} == {("a", 1): 0, ("a", 2): 1, ("b", 1): 0, ("b", 2): 0}


def test_watch_holds_nothing_in_the_driver(spark, tmp_path):
    from logloom.queries import QUERIES

    rows = spark.range(500).select((F.col("id") % 400).alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"))
    rows.write.parquet(f"{tmp_path}/all")
    spark.read.parquet(f"{tmp_path}/all").coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "events.parquet")
    got = QUERIES["stream_watch"](spark, str(tmp_path))
    assert sorted(r.event_id for r in got.collect()) == list(range(400))
    assert got.inputFiles() and not spark.catalog.tableExists("stream_watch")
