"""Debug levels of a log, stated in its header or inferred, and what an analysis at these levels can't tell.

A log is one row from `detect` on: levels are a map, capabilities and limitations are arrays built by expressions over it, so nothing
after the detection is shuffled. A log with neither a header nor an event type that implies a level has method UNKNOWN and an empty map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.logs import headers
from .truncation import CAPABILITIES

# fixed values: names of categories in headers
CATEGORY_NAMES = {
    "apex_code": "Apex_code", "apexcode": "Apex_code", "apex_profiling": "Apex_profiling", "apexprofiling": "Apex_profiling", "callout": "Callout", "database": "Database", "db": "Database", "system": "System",
    "validation": "Validation", "visualforce": "Visualforce", "vf": "Visualforce", "workflow": "Workflow", "nba": "NBA", "wave": "Wave",
}
# fixed values: capability -> detectors that rest on it
CAPABILITY_DETECTORS = {
    "Basic Issue Detection": ("Governor Limits Analyzer",), "SOQL Analysis": ("SOQL in Loop Detector", "N+1 Query Detector"), "Query Performance": ("Non-Selective Query Detector",),
    "CPU Profiling": ("CPU Hotspot Detector",), "Execution Flow": ("Recursive Trigger Detector",),
}
# fixed values: levels recommended for a full analysis, categories that none can do without, points that a limitation costs
RECOMMENDED = {"Apex_code": "FINE", "Apex_profiling": "FINE", "Database": "FINE", "System": "INFO", "Callout": "INFO", "Workflow": "INFO"}
CRITICAL_CATEGORIES = ("Apex_code", "Database", "System")
COST = {"CRITICAL": 20, "WARNING": 10, "INFO": 2}


def _names(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def category_name(text: Column) -> Column:
    """The category that a header's name stands for, null for none."""
    return F.element_at(_names(CATEGORY_NAMES), F.regexp_replace(F.lower(F.trim(text)), r"[\s-]", "_"))


def level_rank(text: Column) -> Column:
    """The rank of a level's name in either case, null for none."""
    return F.element_at(_names({v: n for n, v in enumerate(S.DEBUG_LEVELS)}), F.upper(F.trim(text)))


def stated_levels(lines: DataFrame, within: int = 20) -> DataFrame:
    """(log_id, levels) of logs whose header names levels: its list, and lines `Category: LEVEL` among the first `within`; the later of two wins.

    Names that are no category or no level are passed over; a log without a name that is one gives no row."""
    listed = headers(lines).select("log_id", F.lit(0).alias("line_number"), F.explode("debug_levels").alias("c", "v"))
    shape = r"(?i)^([a-z_\s]+):\s*([a-z]+)\s*$"
    said = lines.where(F.col("line_number").between(1, within) & F.col("value").rlike(shape))
    each = said.select("log_id", "line_number", F.regexp_extract("value", shape, 1).alias("c"), F.regexp_extract("value", shape, 2).alias("v"))
    known = listed.unionByName(each).select("log_id", "line_number", category_name(F.col("c")).alias("category"), level_rank(F.col("v")).alias("r")).where("category is not null and r is not null")
    last = known.groupBy("log_id", "category").agg(F.max_by("r", F.struct("line_number", "r")).alias("r"))
    return last.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "r"))).alias("levels"))


def detect(lines: DataFrame, events: DataFrame, mapping: DataFrame) -> DataFrame:
    """(log_id, method, confidence, levels: map of category to rank, n_types, n_categories, n_events) of every log with a line or an event.

    mapping: (type, category, level_rank), of a bounded number of types. Header levels are certain; inferred ones are as sure as types, categories and events are many."""
    counted = events.groupBy("log_id", "type").agg(F.count("*").alias("n")).join(F.broadcast(mapping.select("type", "category", "level_rank")), "type", "left")
    by_category = counted.groupBy("log_id", "category").agg(F.max("level_rank").alias("r"), F.count("*").alias("types"), F.sum("n").alias("n"))
    implied = F.col("category").isNotNull()
    inferred = by_category.groupBy("log_id").agg(
        F.map_from_entries(F.collect_list(F.when(implied, F.struct("category", "r")))).alias("implied"), F.coalesce(F.sum(F.when(implied, F.col("types"))), F.lit(0)).alias("n_types"), F.count_if(implied).alias("n_categories"), F.sum("n").alias("n_events")
    )
    all_logs = lines.select("log_id").distinct().join(inferred, "log_id", "full").join(stated_levels(lines), "log_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_types", "n_categories", "n_events")}
    sure = F.least(n["n_types"] / 10, F.lit(0.5)) + F.least(n["n_categories"] / 6, F.lit(0.3)) + F.least(n["n_events"] / 1000, F.lit(0.2))
    from_header, from_types = F.col("levels").isNotNull(), n["n_types"] > 0
    none = F.create_map().cast("map<string,int>")
    return all_logs.select(
        "log_id", F.when(from_header, "HEADER").when(from_types, "INFERRED").otherwise("UNKNOWN").alias("method"), F.when(from_header, 1.0).when(from_types, sure).otherwise(0.0).alias("confidence"),
        F.coalesce("levels", "implied", none).alias("levels"), *[c.alias(name) for name, c in n.items()],
    )


def assess(detected: DataFrame) -> DataFrame:
    """detected with capabilities (array of name, status, confidence) and capability_score.

    FULL if every required level is there, PARTIAL if one is there or one step short, else NONE. Confidence is the mean of 1, 0.5 and 0 for these, times the detection's."""
    each = []
    for name, needs in CAPABILITIES.items():
        have = [(F.element_at("levels", F.lit(c)), S.DEBUG_LEVELS.index(v)) for c, v in needs.items()]
        points = [F.when(h >= r, 1.0).when(h == r - 1, 0.5).otherwise(0.0) for h, r in have]
        mean = sum(points[1:], points[0]) / len(points)
        each.append(F.struct(F.lit(name).alias("name"), F.when(mean == 1, "FULL").when(mean > 0, "PARTIAL").otherwise("NONE").alias("status"), (mean * F.col("confidence")).alias("confidence")))
    n = lambda s: F.size(F.filter("capabilities", lambda c: c["status"] == s))
    return detected.withColumn("capabilities", F.array(*each)).withColumn("capability_score", F.floor((100 * n("FULL") + 50 * n("PARTIAL")) / len(CAPABILITIES) + 0.5))


def limitations(assessed: DataFrame) -> DataFrame:
    """assessed with limitations: array of (id, severity, category, current_level, required_level) in the order of a report:
    how levels were found, categories below what is recommended, detectors that are off or limited, categories that are missing."""
    names = F.array(*map(F.lit, S.DEBUG_LEVELS))

    def one(when: Column, name: str, severity: str | Column, category: str | None = None, required: str | None = None) -> Column:
        level = F.element_at("levels", F.lit(category)) if category else F.lit(None).cast("int")
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(name).alias("id"), severity.alias("severity"), F.lit(category).cast("string").alias("category"), F.get(names, level).alias("current_level"), F.lit(required).cast("string").alias("required_level")))

    out = [one(F.col("method") == "UNKNOWN", "UNKNOWN_LEVELS", "WARNING"), one(F.col("method") == "INFERRED", "INFERRED_LEVELS", "INFO"), one(F.col("confidence") < 0.5, "LOW_CONFIDENCE", "WARNING")]
    for category, level in RECOMMENDED.items():
        have = F.element_at("levels", F.lit(category))
        out.append(one(have.isNull() | (have < S.DEBUG_LEVELS.index(level)), f"{category.upper()}_LEVEL_LOW", F.when(have.isNull(), "WARNING").otherwise("INFO"), category, level))
    status = {d: F.get(F.col("capabilities"), F.lit(n))["status"] for n, c in enumerate(CAPABILITIES) for d in CAPABILITY_DETECTORS.get(c, ())}
    for kind, end, severity in (("NONE", "UNAVAILABLE", "WARNING"), ("PARTIAL", "PARTIAL", "INFO")):
        out += [one(s == kind, f"DETECTOR_{d.replace(' ', '_').upper()}_{end}", severity) for d, s in status.items()]
    out += [one(F.element_at("levels", F.lit(c)).isNull(), f"MISSING_{c.upper()}", "CRITICAL", c) for c in CRITICAL_CATEGORIES]
    return assessed.withColumn("limitations", F.array_compact(F.array(*out)))


def report(limited: DataFrame) -> DataFrame:
    """(log_id, n_critical, n_warning, n_info, reliability, summary) of every log: the capability score less what its limitations cost, between 0 and 100."""
    of = lambda s: F.size(F.filter("limitations", lambda x: x["severity"] == s)).alias(f"n_{s.lower()}")
    counted = limited.select("log_id", "capability_score", *map(of, COST))
    spent = sum(cost * F.col(f"n_{s.lower()}") for s, cost in COST.items())
    scored = counted.withColumn("reliability", F.greatest(F.lit(0), F.least(F.lit(100), F.col("capability_score") - spent)).cast("long")).drop("capability_score")
    pct = F.concat(F.lit("("), F.col("reliability").cast("string"), F.lit("% reliability)"))
    told = (
        F.when(F.col("n_critical") > 0, F.concat(F.lit("CRITICAL: "), F.col("n_critical").cast("string"), F.lit(" critical limitation(s) - analysis highly unreliable "), pct))
        .when(F.col("n_warning") > 0, F.concat(F.lit("WARNING: "), F.col("n_warning").cast("string"), F.lit(" limitation(s) may affect analysis accuracy "), pct))
        .when(F.col("n_info") > 0, F.concat(F.lit("Minor limitations present but analysis should be reliable "), pct))
        .otherwise(F.concat(F.lit("No significant limitations - analysis is reliable "), pct))
    )
    return scored.withColumn("summary", told)
