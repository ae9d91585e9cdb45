"""JSON documents and tagged JSON lines, out and in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = ("header", "summary", "event", "issue", "footer")


def compact_event(events: DataFrame) -> DataFrame:
    """(log_id, id, type, line, ts, dur, data): the fields that are set, as one JSON string."""
    core = {"log_id", "id", "parent_id", "type", "timestamp", "line_number", "duration", "depth", "close_id"}
    data = F.to_json(F.struct(*[c for c in events.columns if c not in core]))  # null fields are left out
    return events.select("log_id", "id", "type", F.col("line_number").alias("line"), F.col("timestamp").alias("ts"), *([F.col("duration").alias("dur")] if "duration" in events.columns else []), data.alias("data"))


def tagged(df: DataFrame, record: str, order: Column | None = None) -> DataFrame:
    """(log_id, part, pos, line): each row as a JSON line with its record type."""
    line = F.to_json(F.struct(F.lit(record).alias("recordType"), *df.columns))
    return df.select("log_id", F.lit(RECORDS.index(record)).alias("part"), (F.lit(0).cast("long") if order is None else order.cast("long")).alias("pos"), line.alias("line"))


def json_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """All records of all logs; ordered by log_id, part, pos they are one document a log."""
    out = None
    for name, df in parts.items():
        some = tagged(df, name, F.col("id") if name == "event" else F.col("det_seq") if name == "issue" else None)
        out = some if out is None else out.unionByName(some)
    return out


def write_json_lines(parts: dict[str, DataFrame], path: str) -> None:
    lines = json_lines(parts)
    lines.repartition("log_id").sortWithinPartitions("log_id", "part", "pos").select("log_id", "line").write.mode("overwrite").partitionBy("log_id").text(path)


def read_json_lines(spark: SparkSession, path: str, record: str, schema: str) -> DataFrame:
    """The records of one type, by the given schema."""
    raw = spark.read.text(path)
    return raw.where(F.get_json_object("value", "$.recordType") == record).select("log_id", F.from_json("value", schema).alias("r")).select("log_id", "r.*")
