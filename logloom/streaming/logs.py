"""Streams: arriving log files, a watched catalogue, running summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import log_lines, tokens
from ..sources.tables import shared_dir

#: State of many keys on the executors' disks, not in their memory.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def stream_logs(spark: SparkSession, path: str, glob: str = "*.log", files_per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive: (log_id, content, size)."""
    df = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("log_id"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"))


def stream_tokens(logs: DataFrame) -> DataFrame:
    """Tokens of arriving logs; stateless, so without ids and tree, as a streaming parse has it."""
    return tokens(log_lines(logs))


def watch(catalog: DataFrame, time: str = "ts", key: str = "id", late: str = "1 hour") -> DataFrame:
    """Each entry of a catalogue once; what was seen is forgotten after `late`, so state stays bounded."""
    return catalog.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_counts(events: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """Counts so far by keys (complete mode), or by keys and event-time windows (append mode)."""
    if window is None:
        return events.groupBy(*keys).agg(F.count("*").alias("n"))
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def call_depths(events: DataFrame, idle: str | None = "1 hour") -> DataFrame:
    """(log_id, id, depth) of streamed events (log_id, id, step): each log's open calls are kept as state until it is idle.

    A stream that ends by itself (availableNow) needs idle=None: it would wait for its timers."""
    import pandas as pd

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        depth = state.get[0] if state.exists else 0
        rows = []
        for f in frames:
            for i, step in sorted(zip(f["id"], f["step"])):
                rows.append((key[0], i, depth))
                depth = max(0, depth + step)
        state.update((depth,))
        if idle is not None:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=["log_id", "id", "depth"])

    return events.select("log_id", "id", "step").groupBy("log_id").applyInPandasWithState(run, "log_id string, id long, depth int", "depth int", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Everything there is, once, written by the executors to the shared folder: no row passes through the driver."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is, once, as a table in the driver's memory: for results of few rows."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
