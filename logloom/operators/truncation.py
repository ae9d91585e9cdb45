"""Whether a log was cut, how badly, and what its debug levels let one see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .tree import clamped_depth

# fixed values: texts that mark a cut log
MARKERS = ("*** Skipped", "*** Truncated", "...Maximum Debug Log Size Reached...", "MAXIMUM DEBUG LOG SIZE REACHED", "* MAXIMUM DEBUG LOG SIZE REACHED *", "...log truncated...")
WARNING_BYTES, LIKELY_BYTES = 19 << 20, 19.8 * (1 << 20)
INDICATORS = ("EXPLICIT_MARKER", "SIZE_THRESHOLD", "ABRUPT_ENDING", "UNCLOSED_EVENTS", "MISSING_LIMITS", "MID_LINE_CUT", "INCOMPLETE_STACKTRACE")
# fixed values: event type -> category and the lowest level at which it is logged
IMPLIED_LEVELS = {
    "EXECUTION_STARTED": ("Apex_code", "ERROR"), "EXECUTION_FINISHED": ("Apex_code", "ERROR"), "CODE_UNIT_STARTED": ("Apex_code", "DEBUG"), "CODE_UNIT_FINISHED": ("Apex_code", "DEBUG"),
    "METHOD_ENTRY": ("Apex_code", "FINE"), "METHOD_EXIT": ("Apex_code", "FINE"), "CONSTRUCTOR_ENTRY": ("Apex_code", "FINE"), "CONSTRUCTOR_EXIT": ("Apex_code", "FINE"),
    "VARIABLE_SCOPE_BEGIN": ("Apex_code", "FINER"), "VARIABLE_SCOPE_END": ("Apex_code", "FINER"), "VARIABLE_ASSIGNMENT": ("Apex_code", "FINEST"), "STATEMENT_EXECUTE": ("Apex_code", "FINEST"),
    "USER_DEBUG": ("Apex_code", "DEBUG"), "SOQL_EXECUTE_BEGIN": ("Database", "INFO"), "SOQL_EXECUTE_END": ("Database", "INFO"), "SOQL_EXECUTE_EXPLAIN": ("Database", "FINE"),
    "DML_BEGIN": ("Database", "INFO"), "DML_END": ("Database", "INFO"), "LIMIT_USAGE": ("System", "INFO"), "LIMIT_USAGE_FOR_NS": ("System", "INFO"),
    "CUMULATIVE_LIMIT_USAGE": ("System", "INFO"), "CUMULATIVE_LIMIT_USAGE_END": ("System", "INFO"), "HEAP_ALLOCATE": ("System", "FINER"), "HEAP_DEALLOCATE": ("System", "FINER"),
    "ENTERING_MANAGED_PKG": ("Apex_profiling", "INFO"), "PUSH_TRACE_FLAGS": ("Apex_profiling", "INFO"), "POP_TRACE_FLAGS": ("Apex_profiling", "INFO"),
    "FLOW_START_INTERVIEW_BEGIN": ("Workflow", "INFO"), "FLOW_START_INTERVIEW_END": ("Workflow", "INFO"), "FLOW_ELEMENT_BEGIN": ("Workflow", "FINE"), "FLOW_ELEMENT_END": ("Workflow", "FINE"),
    "CALLOUT_REQUEST": ("Callout", "INFO"), "CALLOUT_RESPONSE": ("Callout", "INFO"), "EXCEPTION_THROWN": ("Apex_code", "ERROR"), "FATAL_ERROR": ("Apex_code", "ERROR"),
    "ASYNC_JOB_ENQUEUED": ("Apex_code", "DEBUG"), "FUTURE_CALL": ("Apex_code", "DEBUG"), "QUEUEABLE_JOB": ("Apex_code", "DEBUG"), "BATCH_APEX_START": ("Apex_code", "DEBUG"), "BATCH_APEX_END": ("Apex_code", "DEBUG"),
}
# fixed values: detector -> required levels and event types
DETECTOR_NEEDS = {
    "CPU Hotspot Detector": ({"Apex_code": "FINE", "Apex_profiling": "FINE"}, ("METHOD_ENTRY", "METHOD_EXIT")),
    "SOQL in Loop Detector": ({"Database": "INFO", "Apex_code": "DEBUG"}, ("SOQL_EXECUTE_BEGIN", "METHOD_ENTRY")),
    "N+1 Query Detector": ({"Database": "INFO"}, ("SOQL_EXECUTE_BEGIN", "SOQL_EXECUTE_END")),
    "Recursive Trigger Detector": ({"Apex_code": "DEBUG", "Workflow": "INFO"}, ("CODE_UNIT_STARTED", "CODE_UNIT_FINISHED")),
    "Non-Selective Query Detector": ({"Database": "FINE"}, ("SOQL_EXECUTE_EXPLAIN",)),
    "Governor Limits Analyzer": ({"System": "INFO"}, ("LIMIT_USAGE", "CUMULATIVE_LIMIT_USAGE")),
}
# fixed values: capability -> required levels
CAPABILITIES = {
    "Basic Issue Detection": {"Apex_code": "ERROR", "System": "INFO"}, "SOQL Analysis": {"Database": "INFO"}, "DML Analysis": {"Database": "INFO"}, "Query Performance": {"Database": "FINE"},
    "CPU Profiling": {"Apex_code": "FINE", "Apex_profiling": "FINE"}, "Execution Flow": {"Apex_code": "DEBUG"}, "Variable Tracking": {"Apex_code": "FINER"}, "Statement Level": {"Apex_code": "FINEST"},
    "Heap Analysis": {"System": "FINER"}, "Flow Analysis": {"Workflow": "INFO"}, "Callout Tracking": {"Callout": "INFO"}, "Managed Package Attribution": {"Apex_profiling": "INFO"},
}
# fixed values: capture presets, levels in the order of PRESET_CATEGORIES
PRESET_CATEGORIES = ("Apex_code", "Apex_profiling", "Callout", "Database", "System", "Validation", "Visualforce", "Workflow", "NBA", "Wave")
PRESETS = {
    "minimal": ("ERROR", "NONE", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "ERROR", "NONE", "NONE"),
    "soql_analysis": ("DEBUG", "FINE", "ERROR", "FINEST", "DEBUG", "INFO", "ERROR", "INFO", "NONE", "NONE"),
    "governor_limits": ("DEBUG", "FINEST", "INFO", "FINE", "DEBUG", "INFO", "INFO", "DEBUG", "NONE", "NONE"),
    "triggers": ("FINE", "FINE", "ERROR", "FINE", "DEBUG", "DEBUG", "ERROR", "DEBUG", "NONE", "NONE"),
    "cpu_hotspots": ("FINER", "FINEST", "INFO", "DEBUG", "DEBUG", "INFO", "INFO", "INFO", "NONE", "NONE"),
    "exceptions": ("FINER", "DEBUG", "DEBUG", "DEBUG", "FINE", "DEBUG", "DEBUG", "DEBUG", "ERROR", "ERROR"),
    "callouts": ("DEBUG", "DEBUG", "FINEST", "INFO", "DEBUG", "ERROR", "ERROR", "ERROR", "NONE", "NONE"),
    "visualforce": ("DEBUG", "FINE", "INFO", "DEBUG", "DEBUG", "DEBUG", "FINEST", "INFO", "NONE", "NONE"),
    "workflow": ("DEBUG", "INFO", "INFO", "DEBUG", "DEBUG", "DEBUG", "ERROR", "FINEST", "NONE", "NONE"),
    "full_diagnostic": ("FINEST", "FINEST", "FINEST", "FINEST", "FINEST", "FINEST", "FINEST", "FINEST", "FINE", "FINE"),
    "ai_optimized": ("FINE", "FINE", "DEBUG", "FINE", "DEBUG", "DEBUG", "INFO", "DEBUG", "NONE", "NONE"),
}


def mid_line_cut(last_line: Column) -> Column:
    """Whether a log's last line looks unfinished."""
    cut = reduce(lambda a, b: a | b, [last_line.rlike(p) for p in (r"\|[^|]+$", r"\[[^\]]*$", r"(?i)SELECT.*FROM(?!\s+\w)", r"[a-zA-Z]$")])
    return (F.length(last_line) > 0) & cut


def has_marker(content: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(content, F.lit(m)) for m in MARKERS])


def unclosed(events: DataFrame) -> DataFrame:
    """(log_id, unclosed): method and code unit entries left open at a log's end."""
    step = F.when(F.col("type").isin("METHOD_ENTRY", "CODE_UNIT_STARTED"), 1).when(F.col("type").isin("METHOD_EXIT", "CODE_UNIT_FINISHED"), -1).otherwise(0)
    return clamped_depth(events.select("log_id", "id", "type"), step).groupBy("log_id").agg(F.max_by("depth_after", "id").alias("unclosed"))


def indicators(logs: DataFrame, events: DataFrame) -> DataFrame:
    """Per log: size and one flag for each indicator."""
    exc = F.col("type").isin(*S.EXCEPTION_TYPES)
    seen = lambda t: F.coalesce(F.bool_or(F.col("type") == t), F.lit(False))
    per_log = events.groupBy("log_id").agg(seen("EXECUTION_FINISHED").alias("finished"), seen("CUMULATIVE_LIMIT_USAGE_END").alias("limits_end"), seen("EXECUTION_STARTED").alias("started"), F.max("line_number").alias("last_line"), F.max(F.when(exc, F.col("line_number"))).alias("last_exception"))
    last = F.element_at(F.split("content", "\n"), -1)
    texts = logs.select("log_id", F.octet_length("content").cast("long").alias("size"), has_marker(F.col("content")).alias("m"), mid_line_cut(last).alias("cut"))
    j = texts.join(per_log, "log_id", "left").join(unclosed(events), "log_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = (
        F.col("m"), F.col("size") >= WARNING_BYTES, ~no(F.col("finished") | F.col("limits_end")), no(F.col("unclosed") > 5),
        no(F.col("started") & ~F.col("finished") & ~F.col("limits_end")), F.col("cut"), no(F.col("last_exception") > F.col("last_line") - 10),
    )
    return j.select("log_id", "size", *[f.alias(n) for n, f in zip(INDICATORS, flags)])


def found_count() -> Column:
    return reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in INDICATORS])


def judge(found: DataFrame) -> DataFrame:
    """indicators with is_truncated, severity and confidence."""
    n = found_count()
    share = F.col("size") / float(S.MAX_LOG_BYTES)
    severity = (
        F.when(n == 0, "NONE").when(F.col("INCOMPLETE_STACKTRACE") | F.col("MID_LINE_CUT"), "CRITICAL").when(share >= 0.99, "SEVERE").when(share >= 0.95, "MODERATE")
        .when(F.col("UNCLOSED_EVENTS") & (n >= 3), "SEVERE").when(n >= 2, "MODERATE").otherwise("MINOR")
    )
    score = F.when(n == 0, 0.95).when(F.col("EXPLICIT_MARKER"), 0.99).when(F.col("SIZE_THRESHOLD") & (n >= 2), 0.95).when(n >= 3, 0.9).when(n == 2, 0.8).otherwise(0.6)
    return found.withColumns({"n_found": n, "is_truncated": n >= 1, "truncation_severity": severity, "truncation_confidence": score})


def implied_levels(spark) -> DataFrame:
    return spark.createDataFrame([(t, c, v, S.DEBUG_LEVELS.index(v)) for t, (c, v) in IMPLIED_LEVELS.items()], "type string, category string, level string, level_rank int")


def infer_levels(events: DataFrame, mapping: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, category, level, evidence): the highest level that a log's event types imply for each category."""
    counted = events.groupBy(key, "type").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(mapping), "type").groupBy(key, "category").agg(F.max_by("level", "level_rank").alias("level"), F.max("level_rank").alias("level_rank"), F.sum("n").alias("evidence"))


def detector_needs() -> list[tuple[str, str]]:
    """(detector, type) of every event type that a detector needs."""
    return [(d, t) for d, (_, types) in DETECTOR_NEEDS.items() for t in types]


def missing_types(events: DataFrame, needs: list[tuple[str, str]], key: str = "log_id") -> DataFrame:
    """(key, detector, type) of every type that a detector needs and a log lacks."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(t).alias("type")) for d, t in needs])).alias("n")
    wanted = events.select(key).distinct().select(key, each).select(key, "n.detector", "n.type")
    return wanted.join(events.select(key, "type").distinct(), [key, "type"], "left_anti")


def capabilities(levels: DataFrame, key: str = "log_id") -> DataFrame:
    """Per log and capability: FULL (all levels are there), PARTIAL (one is there or one step short) or NONE; a category without a level is none."""
    have = levels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "level_rank"))).alias("have"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(S.DEBUG_LEVELS.index(v)).alias("r")) for c, v in req.items()]).alias("req")) for n, req in CAPABILITIES.items()])
    each = have.select(key, "have", F.explode(rows).alias("x"))
    short = F.transform("x.req", lambda r: r["r"] - F.coalesce(F.element_at("have", r["c"]), F.lit(-len(S.DEBUG_LEVELS))))
    return each.select(key, F.col("x.name").alias("capability"), F.when(F.array_max(short) <= 0, "FULL").when(F.array_min(short) <= 1, "PARTIAL").otherwise("NONE").alias("status"))


def capability_score(caps: DataFrame, key: str = "log_id") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return caps.groupBy(key).agg(((100 * n("FULL") + 50 * n("PARTIAL")) / len(CAPABILITIES)).alias("capability_score"))


def reliability(score: Column, critical: Column, warning: Column, info: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - 20 * critical - 10 * warning - 2 * info))


def presets(spark) -> DataFrame:
    return spark.createDataFrame([(p, c, v, S.DEBUG_LEVELS.index(v)) for p, levels in PRESETS.items() for c, v in zip(PRESET_CATEGORIES, levels)], "preset string, category string, level string, level_rank int")


def merge_presets(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The highest level of each category over some presets; with keys, over those of each."""
    return rows.groupBy(*keys, "category").agg(F.max_by("level", "level_rank").alias("level"), F.max("level_rank").alias("level_rank"))


def preset_size(rows: DataFrame, key: str = "preset") -> DataFrame:
    """(key, points, size): weighted levels as a share of the most there can be."""
    weight = F.when(F.col("category") == "Apex_code", 3).when(F.col("category").isin("Database", "Apex_profiling"), 2).otherwise(1)
    points = F.sum(F.col("level_rank") * weight) / 98 * 100
    return rows.groupBy(key).agg(points.alias("points")).withColumn("size", F.when(F.col("points") < 30, "small").when(F.col("points") < 60, "medium").otherwise("large"))


# fixed values: presets that help with each type of issue, the best first
ISSUE_PRESETS = {
    "soql_in_loop": ("soql_analysis", "ai_optimized"),
    "n_plus_one": ("soql_analysis", "ai_optimized"),
    "non_selective_query": ("soql_analysis", "governor_limits"),
    "soql_without_where": ("soql_analysis",),
    "soql_without_limit": ("soql_analysis",),
    "cpu_time_limit": ("cpu_hotspots", "governor_limits"),
    "cpu_hotspot": ("cpu_hotspots",),
    "slow_method": ("cpu_hotspots", "ai_optimized"),
    "recursive_trigger": ("triggers", "ai_optimized"),
    "trigger_performance": ("triggers", "cpu_hotspots"),
    "bulkification": ("triggers", "soql_analysis"),
    "null_pointer": ("exceptions", "ai_optimized"),
    "dml_exception": ("exceptions", "triggers"),
    "query_exception": ("exceptions", "soql_analysis"),
    "limit_exception": ("governor_limits", "exceptions"),
    "soql_limit": ("governor_limits", "soql_analysis"),
    "dml_limit": ("governor_limits", "triggers"),
    "cpu_limit": ("governor_limits", "cpu_hotspots"),
    "heap_limit": ("governor_limits", "ai_optimized"),
    "callout_limit": ("callouts", "governor_limits"),
    "callout_timeout": ("callouts",),
    "callout_error": ("callouts", "exceptions"),
    "workflow": ("workflow",),
    "visualforce": ("visualforce",),
    "general": ("ai_optimized", "minimal"),
}


def best_preset(issues: DataFrame, key: str = "log_id", kind: str = "type", order: str = "det_seq") -> DataFrame:
    """(key, preset, votes): the preset that most of a log's issues ask for, of equal ones that asked for first."""
    names = F.create_map(*[x for t, ps in ISSUE_PRESETS.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))])
    asked = F.coalesce(F.element_at(names, F.lower(kind)), F.array(F.lit("ai_optimized")))
    votes = issues.select(key, order, F.posexplode(asked).alias("_p", "preset")).groupBy(key, "preset").agg(F.count("*").alias("votes"), F.min(F.struct(order, "_p")).alias("_first"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "_first"))
    return votes.withColumn("_r", first).where("_r = 1").select(key, "preset", "votes")


def validate_levels(levels: DataFrame, events: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, detector, n_warnings, n_errors, penalty) of each detector that a log's levels (key, category, level_rank) or event types don't suffice for.

    A warning for every required level that is too low, or unknown with none of the detector's event types there; an error if none is there."""
    rows = F.array(*[
        F.struct(F.lit(d).alias("detector"), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(S.DEBUG_LEVELS.index(v)).alias("r")) for c, v in req.items()]).alias("req"), F.array(*map(F.lit, types)).alias("types"))
        for d, (req, types) in DETECTOR_NEEDS.items()
    ])
    logs = events.groupBy(key).agg(F.collect_set("type").alias("seen"))
    have = levels.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("category", "level_rank"))).alias("have"))
    each = logs.join(have, key, "left").withColumn("have", F.coalesce("have", F.create_map().cast("map<string,int>"))).select(key, "seen", "have", F.explode(rows).alias("x"))
    none = ~F.arrays_overlap("x.types", "seen")
    short = F.filter("x.req", lambda r: F.coalesce(F.element_at("have", r["c"]) < r["r"], none))
    out = each.select(key, F.col("x.detector").alias("detector"), F.size(short).alias("n_warnings"), none.cast("int").alias("n_errors")).where("n_warnings + n_errors > 0")
    return out.withColumn("penalty", F.round(0.1 * F.col("n_warnings") + 0.2 * F.col("n_errors"), 4))


def level_adjustment(validation: DataFrame, key: str = "log_id") -> DataFrame:
    """(key, adjustment): what the confidence of a log's analysis loses, a half at most."""
    return validation.groupBy(key).agg(F.greatest(F.lit(-0.5), -F.round(F.sum("penalty"), 4)).alias("adjustment"))


def light(tree: DataFrame, finish: tuple[str, ...] = ("EXECUTION_FINISHED",)) -> DataFrame:
    """(log_id, last_complete, ended): a log's last event with a duration, and whether an event that finishes it is there."""
    return tree.groupBy("log_id").agg(F.max(F.when(F.col("duration").isNotNull(), F.col("id"))).alias("last_complete"), F.bool_or(F.col("type").isin(*finish)).alias("ended"))


def impact(cut: Column, severity: Column, lost: Column) -> Column:
    """struct of what can still be relied on, from a cut log's severity and the array of kinds of information it lost."""
    whole = ~cut | (severity == "NONE")
    sure = {
        "issues": (severity != "CRITICAL") & ~F.array_contains(lost, "EXCEPTION_DETAILS"), "performance": ~F.array_contains(lost, "PERFORMANCE_DATA"),
        "limits": ~F.array_contains(lost, "FINAL_LIMITS"), "jobs": ~F.array_contains(lost, "ASYNC_CORRELATIONS"),
    }
    return F.struct(*[(whole | c).alias(n) for n, c in sure.items()])


def recovery_strategies(cut: Column, severity: Column, kind: Column) -> Column:
    """Names of the strategies that apply to a cut log, none to a whole one."""
    names = (F.when(kind == "SIZE_LIMIT", "Reduce Debug Levels"), F.lit("Split Operation"), F.lit("Targeted Trace Flags"), F.when(severity.isin("CRITICAL", "SEVERE"), "Request Extended Logging"))
    return F.when(cut & (severity != "NONE"), F.array_compact(F.array(*names))).otherwise(F.array().cast("array<string>"))


# fixed values: levels by suspected issue; a later level of a category replaces an earlier one
BASE_LEVELS = (("Validation", "NONE"), ("Visualforce", "NONE"), ("NBA", "NONE"), ("Wave", "NONE"))
SUSPECT_LEVELS = {
    "SOQL": (("Database", "FINEST"), ("Apex_code", "FINE"), ("Apex_profiling", "FINEST"), ("Workflow", "ERROR"), ("System", "INFO")),
    "CPU": (("Apex_code", "FINE"), ("Apex_profiling", "FINEST"), ("Database", "FINE"), ("System", "DEBUG"), ("Workflow", "ERROR")),
    "TRIGGER": (("Apex_code", "FINEST"), ("Database", "FINE"), ("Workflow", "FINER"), ("System", "INFO")),
    "CALLOUT": (("Callout", "FINEST"), ("Apex_code", "FINE"), ("System", "DEBUG"), ("Database", "ERROR"), ("Workflow", "ERROR")),
    "FLOW": (("Workflow", "FINEST"), ("Validation", "INFO"), ("Apex_code", "FINE"), ("Database", "FINE"), ("System", "INFO")),
    "GENERAL": (("Apex_code", "FINE"), ("Database", "FINE"), ("Workflow", "INFO"), ("System", "INFO"), ("Callout", "INFO")),
}


def optimized_levels(suspects: DataFrame, key: str = "log_id", suspect: str = "suspect") -> DataFrame:
    """(key, category, level) to log next time; an unknown suspect counts as GENERAL."""
    rows = {s: F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("level")) for c, v in {**dict(BASE_LEVELS), **dict(levels)}.items()]) for s, levels in SUSPECT_LEVELS.items()}
    known = F.create_map(*[x for s, r in rows.items() for x in (F.lit(s), r)])
    return suspects.select(key, F.explode(F.coalesce(F.element_at(known, F.col(suspect)), rows["GENERAL"])).alias("_l")).select(key, "_l.category", "_l.level")
