"""Levels by hand: headers, inference, capabilities and limitations of small logs."""

from logloom.operators import levels, truncation

LINES = [
    ("head", 1, "59.0 APEX_CODE,FINE;APEX_PROFILING,FINE;DB,FINE;SYSTEM,INFO;CALLOUT,INFO;WORKFLOW,INFO"), ("head", 2, "database: finest"), ("head", 3, "Database:LOUD"), ("head", 4, None), ("head", 40, "System: NONE"),
    ("late", 40, "Apex Code: FINE"), ("odd", 1, "59.0 ODD,INFO"), ("odd", 2, "Apex Code: FINE and more"), ("two", 1, "Apex Code: ERROR"), ("two", 2, "APEX CODE : none"), ("two", 3, "VF:WARN"), ("empty", 1, ""),
]
EVENTS = [("head", "HEAP_ALLOCATE")] + [("late", t) for t in ("METHOD_ENTRY", "METHOD_ENTRY", "SOQL_EXECUTE_BEGIN", "NOT_KNOWN", None)] + [("plain", "NOT_KNOWN")] + [("events", t) for t in truncation.IMPLIED_LEVELS] * 30


def _detected(spark):
    lines = spark.createDataFrame(LINES, "log_id string, line_number int, value string")
    events = spark.createDataFrame(EVENTS, "log_id string, type string")
    return levels.detect(lines, events, truncation.implied_levels(spark))


def test_levels_stated_or_inferred(spark):
    got = {r.log_id: (r.method, round(r.confidence, 6), r.levels) for r in _detected(spark).collect()}
    assert got["head"] == ("HEADER", 1.0, {"Apex_code": 5, "Apex_profiling": 5, "Database": 7, "System": 3, "Callout": 3, "Workflow": 3})
    assert got["two"] == ("HEADER", 1.0, {"Apex_code": 0, "Visualforce": 2})
    # two types of two categories in five events
    assert got["late"] == ("INFERRED", round(0.2 + 0.3 + 0.005, 6), {"Apex_code": 5, "Database": 3})
    assert got["events"] == ("INFERRED", 1.0, {"Apex_code": 7, "Database": 5, "System": 6, "Apex_profiling": 3, "Workflow": 5, "Callout": 3})
    assert all(got[x] == ("UNKNOWN", 0.0, {}) for x in ("odd", "plain", "empty")) and len(got) == 7


def test_capabilities_limitations_and_report(spark):
    limited = levels.limitations(levels.assess(_detected(spark)))
    rows = {r.log_id: r for r in limited.collect()}
    status = {k: {c.name: (c.status, round(c.confidence, 4)) for c in r.capabilities} for k, r in rows.items()}
    assert status["head"]["CPU Profiling"] == ("FULL", 1.0) and status["head"]["Variable Tracking"] == ("PARTIAL", 0.5) and status["head"]["Heap Analysis"] == ("NONE", 0.0)
    # one of two levels is enough for a part, whatever the other lacks
    assert status["late"]["CPU Profiling"] == ("PARTIAL", round(0.5 * 0.505, 4))
    assert status["two"]["Basic Issue Detection"] == ("PARTIAL", 0.25)
    ids = {k: [(x.id, x.severity) for x in r.limitations] for k, r in rows.items()}
    assert ids["head"] == []
    assert ids["late"] == [
        ("INFERRED_LEVELS", "INFO"), ("APEX_PROFILING_LEVEL_LOW", "WARNING"), ("DATABASE_LEVEL_LOW", "INFO"), ("SYSTEM_LEVEL_LOW", "WARNING"), ("CALLOUT_LEVEL_LOW", "WARNING"), ("WORKFLOW_LEVEL_LOW", "WARNING"),
        ("DETECTOR_NON-SELECTIVE_QUERY_DETECTOR_UNAVAILABLE", "WARNING"), ("DETECTOR_GOVERNOR_LIMITS_ANALYZER_PARTIAL", "INFO"), ("DETECTOR_CPU_HOTSPOT_DETECTOR_PARTIAL", "INFO"), ("MISSING_SYSTEM", "CRITICAL"),
    ]
    low = {x.id: (x.category, x.current_level, x.required_level) for x in rows["late"].limitations}
    assert low["DATABASE_LEVEL_LOW"] == ("Database", "INFO", "FINE") and low["MISSING_SYSTEM"] == ("System", None, None)
    told = {r.log_id: r for r in levels.report(limited).collect()}
    # 9 of 12 in full, one in part
    assert (told["head"].reliability, told["head"].summary) == (79, "No significant limitations - analysis is reliable (79% reliability)")
    assert (told["late"].n_critical, told["late"].n_warning, told["late"].n_info, told["late"].reliability) == (1, 5, 4, 0)
    assert told["empty"].summary == "CRITICAL: 3 critical limitation(s) - analysis highly unreliable (0% reliability)"


def test_no_logs(spark):
    none = _detected(spark).where("false")
    assert levels.report(levels.limitations(levels.assess(none))).collect() == []
