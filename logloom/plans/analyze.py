"""From raw logs to ranked issues: one plan over many logs, partitioned by log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detect, scoring, truncation
from ..operators.calls import signature_calls
from ..operators.events import log_stats, typed_events
from ..operators.tree import call_tree
from ..sources.logs import continuation_lines, headers, log_lines, tokens
from ..sources.tables import materialize


@dataclass
class Parsed:
    """A parse of many logs; every table has log_id."""

    logs: DataFrame
    lines: DataFrame
    events: DataFrame
    tree: DataFrame
    headers: DataFrame
    stats: DataFrame
    fixed: bool


def parse_logs(logs: DataFrame, fixed: bool = True, written: bool = True) -> Parsed:
    """logs: (log_id, content). `fixed` mends known gaps of the format's usual reading (see README); without, they are kept.

    Six detectors read the events and the tree: with `written` these are computed once, into the shared folder."""
    lines = log_lines(logs)
    keep = materialize if written else lambda df, name: df
    events = keep(typed_events(tokens(lines), fixed), "events")
    return Parsed(logs, lines, events, keep(call_tree(events), "tree"), headers(lines), log_stats(lines, events), fixed)


def log_status(p: Parsed) -> DataFrame:
    """(log_id, status, confidence): EMPTY_LOG, INVALID_FORMAT or PARSED; no log fails the run."""
    bad = p.logs.select("log_id", (F.trim("content") == "").alias("empty"), truncation.has_marker(F.col("content")).alias("cut"))
    j = bad.join(p.stats, "log_id", "left")
    status = F.when(F.col("empty") | F.col("total_lines").isNull(), "EMPTY_LOG").when(F.col("n_events") == 0, "INVALID_FORMAT").otherwise("PARSED")
    return j.select("log_id", status.alias("status"), scoring.parse_confidence(F.col("n_events"), F.col("total_lines"), F.col("cut")).alias("confidence"))


def detect_issues(p: Parsed, detectors: tuple[str, ...] = detect.DETECTORS) -> DataFrame:
    """Issues of all logs with det_seq, their order of detection in the log."""
    details = continuation_lines(p.lines, p.events) if p.fixed else None
    runs = {
        "governor_limits": lambda: detect.governor_limit_issues(detect.limit_readings(p.events, details)),
        "cpu_hotspots": lambda: detect.cpu_issues(detect.method_stats(signature_calls(p.events))),
        "query_in_loop": lambda: detect.query_loop_issues(p.tree),
        "n_plus_one": lambda: detect.n_plus_one_issues(p.tree, p.fixed),
        "recursive_trigger": lambda: detect.recursion_issues(p.tree),
        "non_selective": lambda: detect.selectivity_issues(p.tree),
    }
    out = None
    for name in detectors:
        some = runs[name]().withColumn("_d", F.lit(detect.DETECTORS.index(name)))
        out = some if out is None else out.unionByName(some)
    first = F.coalesce(F.get("event_ids", F.lit(0)), F.lit(0))
    return out.withColumn("det_seq", F.row_number().over(Window.partitionBy("log_id").orderBy("_d", first, "type", "title"))).drop("_d")


def analyze(p: Parsed) -> tuple[DataFrame, DataFrame]:
    """(issues with priority, one summary row per log; a log without issues is healthy)."""
    issues = detect_issues(p)
    ranked = scoring.prioritize(issues)
    rows = p.logs.select("log_id").join(scoring.summary(issues), "log_id", "left")
    rows = rows.withColumns({"health": F.coalesce("health", F.lit(100).cast("long")), "one_liner": F.coalesce("one_liner", F.lit("Mostly healthy"))})
    return ranked, rows.join(truncation.judge(truncation.indicators(p.logs, p.events)).select("log_id", "n_found", "is_truncated", "truncation_severity"), "log_id", "left")
