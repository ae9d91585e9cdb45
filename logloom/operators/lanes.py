"""Execution as a graph of lanes, like a version history: each trigger is a branch with a lane of its own, as rows and for all logs at once.

A trigger's lane is its place among the log's triggers by first start; lane 0 is the main one. A row lies in the lane of the trigger that it starts or ends, else
of the nearest trigger around it. How many lanes are open at a row is a running sum of starts and ends that change a trigger's state. Ends of
anything but triggers aren't shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tree import with_ancestors

# fixed values: signs of rows by kind, and of lines
SIGNS = {"start": "◉", "end": "◈", "dml": "■", "rows": "○", "empty": "◌", "exception": "✖", "debug": "◇", "callout": "⬡", "flow": "▷", "other": "●"}
LINES = {"vertical": "│", "horizontal": "─", "branch": "╱", "merge": "╲"}
PLAIN_LINES = {"vertical": "|", "horizontal": "-", "branch": "/", "merge": "\\"}


def lanes(tree: DataFrame, trigger: Column, starts: Column, ends: Column, hidden: Column | None = None) -> DataFrame:
    """(log_id, id, lane, is_start, is_end, n_open) of the rows of a call tree that are shown.

    trigger names the trigger of rows that start or end one; an end of a trigger that never started isn't shown. hidden: rows not shown (by default,
    types of ends)."""
    hidden = F.col("type").rlike("_END|_EXIT|_FINISHED") if hidden is None else hidden
    rows = tree.select("log_id", "id", "close_id", trigger.alias("name"), (starts & trigger.isNotNull()).alias("is_start"), (ends & trigger.isNotNull()).alias("is_end"), hidden.alias("hidden"))
    named = rows.where("is_start").groupBy("log_id", "name").agg(F.min("id").alias("first"))
    named = named.withColumn("lane", F.row_number().over(Window.partitionBy("log_id").orderBy("first")))
    moves = rows.where("is_start or is_end").join(named, ["log_id", "name"]).where("is_start or id > first")
    was = F.coalesce(F.lag("is_start").over(Window.partitionBy("log_id", "name").orderBy("id")), F.lit(False))
    # an end counts behind its own row, a start at it
    moves = moves.withColumn("step", F.when(F.col("is_start") & ~was, 1).when(F.col("is_end") & was, -1).otherwise(0))
    # a row in the lane of the last trigger start around it, not counting itself
    around = with_ancestors(rows, F.col("is_start"), "trigger").groupBy("log_id", "id").agg(F.max("trigger_id").alias("_t"))
    own = moves.select("log_id", "id", F.col("lane").alias("own"), "step", F.lit(True).alias("moves"))
    outer = moves.where("is_start").select("log_id", F.col("id").alias("_t"), F.col("lane").alias("outer"))
    shown = rows.join(own, ["log_id", "id"], "left").where("(not hidden and not is_end) or moves")
    shown = shown.join(around, ["log_id", "id"], "left").join(outer, ["log_id", "_t"], "left")
    up_to = Window.partitionBy("log_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.coalesce("step", F.lit(0))).over(up_to) - F.when(F.col("is_end"), F.coalesce("step", F.lit(0))).otherwise(0)
    return shown.select("log_id", "id", F.coalesce("own", "outer", F.lit(0)).alias("lane"), F.coalesce("is_start", F.lit(False)).alias("is_start"), F.coalesce("is_end", F.lit(False)).alias("is_end"), (1 + opened).cast("long").alias("n_open"))


def row_sign(kind: Column, row_count: Column, is_start: Column, is_end: Column) -> Column:
    s = {k: F.lit(v) for k, v in SIGNS.items()}
    return (
        F.when(is_start, s["start"]).when(is_end, s["end"]).when(kind == "DML_BEGIN", s["dml"]).when(kind == "SOQL_EXECUTE_BEGIN", F.when(F.coalesce(row_count > 0, F.lit(False)), s["rows"]).otherwise(s["empty"]))
        .when(kind.isin("EXCEPTION_THROWN", "FATAL_ERROR"), s["exception"]).when(kind == "USER_DEBUG", s["debug"]).when(kind == "CALLOUT_REQUEST", s["callout"])
        .when(kind.isin("FLOW_START_INTERVIEW_BEGIN", "FLOW_ELEMENT_BEGIN"), s["flow"]).otherwise(s["other"])
    )


def lane_lines(placed: DataFrame, sign: Column, message: Column, lines: dict[str, str] = PLAIN_LINES) -> DataFrame:
    """(log_id, id, line): a row's sign in its lane, open lanes beside it up to the log's last lane, and a message."""
    widest = F.max("lane").over(Window.partitionBy("log_id"))
    bend = F.when(F.col("is_start"), lines["branch"]).when(F.col("is_end"), lines["merge"]).otherwise(lines["vertical"])

    def cell(i: Column) -> Column:
        beside = F.when(i == F.col("lane") - 1, bend).otherwise(lines["vertical"])
        return F.when(i == F.col("lane"), F.col("_sign")).when(i < F.col("n_open"), beside).otherwise(" ")

    out = placed.withColumns({"_sign": sign, "_said": message, "_widest": widest})
    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_widest")), lambda i: F.concat(cell(i), F.lit(" "))), "")
    return out.select("log_id", "id", F.concat(cells, F.lit(2 * lines["horizontal"] + " "), "_said").alias("line"))
