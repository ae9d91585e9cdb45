"""Trees, contexts and documents for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_duration


def tree_lines(tree: DataFrame, label: Column, least_duration: float | None = None, max_depth: int | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """(log_id, id, line): events indented by depth, with their duration."""
    out = tree
    if least_duration is not None:
        out = out.where(F.col("duration") >= least_duration)
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    time = F.coalesce(F.concat(F.lit(" ("), format_duration(F.col("duration")), F.lit(")")), F.lit(""))
    return out.select("log_id", "id", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), label, time).alias("line"))


def render_tree(tree: DataFrame, log_id, label: Column | None = None, lines: int = 500, **options) -> str:
    """One log's tree as text; at most `lines` lines come to the driver."""
    label = F.col("type") if label is None else label
    rows = tree_lines(tree.where(F.col("log_id") == log_id), label, **options).orderBy("id").limit(lines + 1).collect()
    text = [r.line for r in rows[:lines]]
    return "\n".join(text + ["..."] * (len(rows) > lines))


def slowest(tree: DataFrame, top: int = 20) -> DataFrame:
    """Each log's events with the longest durations and their share of the log's own length."""
    total = F.max("duration").over(Window.partitionBy("log_id"))
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("duration"), "id"))
    out = tree.where("duration is not null").withColumns({"pct": 100 * F.col("duration") / total, "place": place})
    return out.where(F.col("place") <= top)


def progress_bar(share: Column, width: int = 20) -> Column:
    full = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))


def problem_context(issues: DataFrame, events: DataFrame, top: int = 5, parts: int | None = None) -> DataFrame:
    """(log_id, det_seq, timeline): an issue's first events, one after another. `parts`: into how many tasks to deal the events, where a session's number of them doesn't follow the input."""
    ids, rows = issues.select("log_id", "det_seq", F.explode("event_ids").alias("id")), events.select("log_id", "id", "type", "line_number")
    if parts:
        ids, rows = ids.repartition(parts, "log_id", "id"), rows.repartition(parts, "log_id", "id")
    e = ids.join(rows, ["log_id", "id"])
    if parts:
        e = e.repartition(parts, "log_id", "det_seq")
    place = F.row_number().over(Window.partitionBy("log_id", "det_seq").orderBy("id"))
    first = e.withColumn("place", place).where(F.col("place") <= top)
    rows = F.sort_array(F.collect_list(F.struct("id", F.concat_ws(" ", "type", F.concat(F.lit("@"), "line_number")).alias("t"))))
    return first.groupBy("log_id", "det_seq").agg(F.array_join(F.transform(rows, lambda r: r["t"]), " -> ").alias("timeline"))


def markdown_issues(issues: DataFrame, most: int = 200) -> str:
    """A table of at most `most` issues, the first by priority."""
    rows = issues.orderBy("log_id", "priority").limit(most).collect()
    head = ["| log | # | severity | type | title | confidence |", "|-|-|-|-|-|-|"]
    return "\n".join(head + [f"| {r.log_id} | {r.priority} | {r.severity} | {r.type} | {r.title} | {r.confidence:.2f} |" for r in rows])
