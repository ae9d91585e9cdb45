"""Raw logs as tables of lines, their headers, and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize_line

MAX_FILE_BYTES = 50 << 20


def read_logs(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(log_id, content, size): one row a file, named like the file without its ending; larger files are left out here and listed by `skipped_files`."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
    return df.where(F.col("size") <= max_bytes).select(F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1).alias("log_id"), "content", "size")


def skipped_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(log_id, size, status TOO_LARGE) of the files that `read_logs` leaves out; their content isn't read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    big = reader.load(path).where(F.col("length") > max_bytes)
    return big.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*?)(\.[^.]*)?$", 1).alias("log_id"), F.col("length").alias("size"), F.lit("TOO_LARGE").alias("status"))


def log_lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_number from 1, value)."""
    return logs.select("log_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "value")).select("log_id", (F.col("pos") + 1).alias("line_number"), "value")


def tokens(lines: DataFrame) -> DataFrame:
    """(log_id, line_number, wall_time, timestamp, event_type, segments) of the lines that are events."""
    return lines.select("log_id", "line_number", tokenize_line(F.col("value")).alias("t")).where("t is not null").select("log_id", "line_number", "t.*")


def headers(lines: DataFrame) -> DataFrame:
    """(log_id, api_version, debug_levels) from the first header among the first five lines."""
    shape = r"^(\d+\.\d+)\s+([A-Z_,;]+)"
    head = lines.where(F.col("line_number").between(1, 5) & F.col("value").rlike(shape))
    first = head.groupBy("log_id").agg(F.min_by("value", "line_number").alias("h"))
    return first.select("log_id", F.regexp_extract("h", shape, 1).alias("api_version"), F.expr("str_to_map(rtrim(';', regexp_extract(h, '^([0-9.]+)\\\\s+([A-Z_,;]+)', 2)), ';', ',')").alias("debug_levels"))


def continuation_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, event_line, line_number, value): each line that is no event with the event line before it."""
    from pyspark.sql import Window

    marked = lines.join(events.select("log_id", "line_number", F.col("line_number").alias("event_line")), ["log_id", "line_number"], "left")
    before = Window.partitionBy("log_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marked.withColumn("owner", F.last("event_line", ignorenulls=True).over(before))
    return filled.where("event_line is null and owner is not null and trim(value) <> ''").select("log_id", F.col("owner").alias("event_line"), "line_number", "value")
