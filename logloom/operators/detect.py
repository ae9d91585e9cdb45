"""Issue detectors: each takes events (with the call tree where it needs one) and returns issue rows.

Issues have one schema (`ISSUE`); `det_seq` orders a log's issues as the detectors run: limits, processor time,
queries in loops, one query per row, recursive triggers, unselective queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import exact_sum, exact_sum_over
from ..functions.text import ascii_words, found, normalize_query, query_object, trim_all
from .tree import with_ancestors

ISSUE = ("log_id", "detector", "type", "category", "severity", "title", "confidence", "namespace", "can_modify", "occurrences", "limit_pct", "event_ids")
DETECTORS = ("governor_limits", "cpu_hotspots", "query_in_loop", "n_plus_one", "recursive_trigger", "non_selective")

# fixed values: limit name -> short name, default maximum, warning and critical percentages, types near and over the limit
LIMITS = {
    "Number of SOQL queries": ("SOQL Queries", 100, 70, 90, "SOQL_LIMIT_NEAR", "SOQL_LIMIT_EXCEEDED"),
    "Number of query rows": ("Query Rows", 50000, 70, 90, "SOQL_LIMIT_NEAR", "SOQL_LIMIT_EXCEEDED"),
    "Number of DML statements": ("DML Statements", 150, 70, 90, "DML_LIMIT_NEAR", "DML_LIMIT_EXCEEDED"),
    "Number of DML rows": ("DML Rows", 10000, 70, 90, "DML_LIMIT_NEAR", "DML_LIMIT_EXCEEDED"),
    "Maximum CPU time": ("CPU Time", 10000, 60, 85, "CPU_TIMEOUT", "CPU_TIMEOUT"),
    "Maximum heap size": ("Heap Size", 6000000, 70, 90, "HEAP_SIZE_WARNING", "HEAP_LIMIT"),
    "Number of callouts": ("Callouts", 100, 70, 90, "CALLOUT_LIMIT", "CALLOUT_LIMIT"),
}
# fixed values: pairs of parent and child objects that are often read one by one
KNOWN_PAIRS = (("Account", "Contact"), ("Account", "Opportunity"), ("Opportunity", "OpportunityLineItem"), ("Order", "OrderItem"), ("Case", "CaseComment"))
# fixed values: filters that use an index (letters in either case)
INDEXED_FIELDS = (
    r"\bID\s*=",
    r"\bNAME\s*=",
    r"\bOWNERID\s*=",
    r"\bCREATEDBYID\s*=",
    r"\bLASTMODIFIEDBYID\s*=",
    r"\bCREATEDDATE\s*[<>=]",
    r"\bLASTMODIFIEDDATE\s*[<>=]",
    r"\bSYSTEMMODSTAMP\s*[<>=]",
    r"\bRECORDTYPEID\s*=",
    r"\bIN\s*:",
    r"\b\w+__C\s*=\s*:",
)
# fixed values: shapes of trigger names (letters in either case) and the group that holds the object
TRIGGER_NAMES = ((r"^(\w+?)_?Trigger\z", 1), (r"^(\w+?)_?Before", 1), (r"^(\w+?)_?After", 1), (r"^([\w_]+)__(\w+?)Trigger\z", 2))


def issue(df: DataFrame, detector: str, **cols) -> DataFrame:
    """Rows of the issue schema; what isn't given is null."""
    given = {"category": "performance", "can_modify": F.lit(True), **cols}
    kinds = {"confidence": "double", "occurrences": "long", "limit_pct": "double", "can_modify": "boolean", "event_ids": "array<long>"}
    out = [F.col("log_id"), F.lit(detector).alias("detector")]
    for name in ISSUE[2:]:
        value = given.get(name)
        value = F.lit(value) if value is None or isinstance(value, (str, float, int, bool)) else value
        out.append(value.cast(kinds.get(name, "string")).alias(name))
    return df.select(*out)


def ladder(value: Column, *steps: tuple[float, str], other: str) -> Column:
    """The name of the first bound that value reaches."""
    out = None
    for bound, name in steps:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(other)


def limit_severity(percent: Column) -> Column:
    return ladder(percent, (100, "CRITICAL"), (90, "HIGH"), (75, "MEDIUM"), other="LOW")


def max_used(limits: DataFrame, keys: list[str], used: str = "used", order: str = "id", carry: tuple[str, ...] = ("max",)) -> DataFrame:
    """The row with the largest use of each key; the first of equals."""
    best = F.max_by(F.struct(order, used, *carry), F.struct(F.col(used), -F.col(order)))
    return limits.where(F.col(used).isNotNull()).groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("n_readings")).select(*keys, "n_readings", "_b.*")


def judged_limits(final: DataFrame) -> DataFrame:
    """final (limit_name, used, max) with pct, severity and status of each limit, by its thresholds."""
    table = F.create_map(*[x for name, (_, top, warn, crit, near, over) in LIMITS.items() for x in (F.lit(name), F.struct(F.lit(top).alias("top"), F.lit(warn).alias("warn"), F.lit(crit).alias("crit"), F.lit(near).alias("near"), F.lit(over).alias("over")))])
    d = final.withColumn("_d", F.element_at(table, F.col("limit_name"))).withColumn("max", F.coalesce("max", "_d.top", F.lit(100)))
    warn, crit = F.coalesce("_d.warn", F.lit(70)), F.coalesce("_d.crit", F.lit(90))
    pct = F.when(F.col("max") > 0, 100.0 * F.col("used") / F.col("max")).otherwise(0.0)
    over = F.col("used") >= F.col("max")
    d = d.withColumns({"pct": pct, "exceeded": over, "status": F.when(over, "EXCEEDED").when(pct >= crit, "CRITICAL").when(pct >= warn, "WARNING").otherwise("OK")})
    return d.withColumns({
        "severity": F.when(F.col("pct") >= 100, "CRITICAL").when(F.col("pct") >= crit, "HIGH").when(F.col("pct") >= warn, "MEDIUM"),
        "type": F.when(over, F.coalesce("_d.over", F.lit("GOVERNOR_LIMITS"))).otherwise(F.coalesce("_d.near", F.lit("GOVERNOR_LIMITS"))),
        "confidence": F.when(over, 1.0).otherwise(F.least(F.lit(0.95), 0.6 + F.col("pct") / 200)),
    }).drop("_d")


def limit_readings(events: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """(log_id, id, namespace, limit_name, used, max): events' own readings, and those on the lines after cumulative ones.

    details: continuation lines (event_line, value); given, they stand in for what cumulative events don't hold."""
    own = events.where(F.col("limit_name").isNotNull()).select("log_id", "id", F.when(F.col("type") == "LIMIT_USAGE_FOR_NS", F.col("namespace")).alias("namespace"), "limit_name", "used", "max")
    if details is None:
        return own
    shape = r"^\s*([^:]+):\s*(\d+)\s+(?i:out\s+of)\s+(\d+)"
    cumulative = events.where(F.col("type") == "CUMULATIVE_LIMIT_USAGE").select("log_id", "id", F.col("line_number").alias("event_line"))
    more = details.where(F.col("value").rlike(shape)).join(cumulative, ["log_id", "event_line"])
    v = F.col("value")
    return own.unionByName(more.select("log_id", "id", F.lit(None).cast("string").alias("namespace"), trim_all(found(v, shape, 1)).alias("limit_name"), found(v, shape, 2).cast("long").alias("used"), found(v, shape, 3).cast("long").alias("max")))


def governor_limit_issues(readings: DataFrame) -> DataFrame:
    """Limits that are near or over their maximum, and namespaces that use more than 30 queries or 45 writes."""
    final = judged_limits(max_used(readings, ["log_id", "limit_name"]))
    near = issue(final.where("severity is not null or exceeded"), "governor_limits", type=F.col("type"), severity=F.coalesce("severity", F.lit("CRITICAL")), category=F.lit("governor_limits"), title=F.concat("limit_name", F.lit(": "), "used", F.lit(" of "), "max"), confidence=F.col("confidence"), occurrences=F.col("n_readings"), limit_pct=F.col("pct"), event_ids=F.array("id"))
    return near.unionByName(namespace_limit_issues(readings))


def namespace_use(readings: DataFrame, keys: list[str], namespace: str = "namespace") -> DataFrame:
    named = readings.where(F.col(namespace).isNotNull() & ~F.col(namespace).isin("", "default", "(default)"))
    used = lambda name: F.max(F.when(F.col("limit_name") == name, F.col("used")))
    return named.groupBy(*keys, namespace).agg(used("Number of SOQL queries").alias("queries"), used("Number of DML statements").alias("writes"), F.count("*").alias("n_readings"))


def namespace_limit_issues(readings: DataFrame) -> DataFrame:
    heavy = namespace_use(readings, ["log_id"]).where("queries > 30 or writes > 45")
    return issue(heavy, "governor_limits", type="MANAGED_PACKAGE_ERROR", severity="MEDIUM", category="managed_package", title=F.concat(F.lit("heavy use by "), "namespace"), confidence=0.85, namespace=F.col("namespace"), can_modify=F.lit(False), occurrences=F.col("n_readings"))


def limit_summary(readings: DataFrame) -> DataFrame:
    """Per log: how many limits stand where, and the worst as overall health."""
    final = judged_limits(max_used(readings, ["log_id", "limit_name"]))
    n = lambda s: F.count_if(F.col("status") == s)
    out = final.groupBy("log_id").agg(n("EXCEEDED").alias("exceeded"), n("CRITICAL").alias("critical"), n("WARNING").alias("warning"), n("OK").alias("ok"))
    return out.withColumn("health", F.when(F.col("exceeded") > 0, "EXCEEDED").when(F.col("critical") > 0, "CRITICAL").when(F.col("warning") > 0, "WARNING").otherwise("OK"))


def method_calls(tree: DataFrame) -> DataFrame:
    """Closed method calls with inclusive and exclusive nanoseconds; calls whose exits are in order close by position.

    tree must hold method and constructor events alone, so that every exit closes the call around it."""
    calls = tree.where(F.col("type").isin("METHOD_ENTRY", "CONSTRUCTOR_ENTRY") & F.col("duration").isNotNull())
    inner = calls.groupBy("log_id", F.col("parent_id").alias("id")).agg(F.sum("duration").alias("_inner"))
    calls = calls.join(inner, ["log_id", "id"], "left").withColumn("exclusive", F.greatest(F.lit(0), F.col("duration") - F.coalesce("_inner", F.lit(0))))
    name = F.concat_ws(".", F.coalesce("class_name", F.lit("Unknown")), F.coalesce("method_name", F.lit("Unknown")))
    return calls.select("log_id", "id", name.alias("method"), F.col("duration").alias("inclusive"), "exclusive")


def method_stats(calls: DataFrame, keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Per method: calls, inclusive and exclusive totals, largest and average, with the first call's id."""
    # sums of doubles that depend on the order of rows would tip averages and ranks that lie on a bound
    whole, own = (exact_sum(F.col(c)) if dict(calls.dtypes)[c] == "double" else F.sum(c) for c in ("inclusive", "exclusive"))
    return calls.groupBy(*keys, "method").agg(F.count("*").alias("n_calls"), whole.alias("inclusive"), own.alias("exclusive"), F.max("inclusive").alias("longest"), (whole / F.count("*")).alias("average"), F.min("id").alias("first_id"), F.sort_array(F.collect_list("id")).alias("event_ids"))


def cpu_hotspots(stats: DataFrame, unit: float = 1e6, least_total: float = 50, least_pct: float = 5, least_own: float = 50, top: int = 5, key: str = "log_id") -> DataFrame:
    """The methods with most time of their own: at most `top`, with their share of the log's time."""
    w = Window.partitionBy(key)
    total = (exact_sum_over(F.col("exclusive"), w) if dict(stats.dtypes)["exclusive"] == "double" else F.sum("exclusive").over(w)) / unit
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("exclusive"), "first_id"))
    out = stats.withColumns({"total_ms": total, "own_ms": F.col("exclusive") / unit, "place": place})
    out = out.withColumn("pct", F.when(F.col("total_ms") > 0, 100 * F.col("own_ms") / F.col("total_ms")).otherwise(0.0))
    return out.where((F.col("place") <= top) & (F.col("total_ms") >= least_total) & (F.col("pct") >= least_pct) & (F.col("own_ms") >= least_own))


def expensive_methods(stats: DataFrame, hotspots: DataFrame, unit: float = 1e6, key: str = "log_id") -> DataFrame:
    """Methods that take over 100 ms on average or 500 ms once, and are no hotspot already."""
    slow = (F.col("average") > 100 * unit) | (F.col("longest") > 500 * unit)
    return stats.where(slow).join(hotspots.select(key, "method"), [key, "method"], "left_anti")


def cpu_issues(stats: DataFrame) -> DataFrame:
    hot = cpu_hotspots(stats)
    total = stats.groupBy("log_id").agg((F.sum("exclusive") / 1e6).alias("ms")).where("ms > 5000").withColumn("pct", F.col("ms") / 100)
    timeout = issue(total, "cpu_hotspots", type="CPU_TIMEOUT", severity=ladder(F.col("pct"), (90, "CRITICAL"), (70, "HIGH"), other="MEDIUM"), category="cpu", title=F.format_string("%.0f ms of processor time", "ms"), confidence=F.least(F.lit(0.95), 0.5 + F.col("pct") / 200), limit_pct=F.col("pct"))
    spots = issue(hot, "cpu_hotspots", type="CPU_HOTSPOT", severity=ladder(F.col("pct"), (30, "HIGH"), (15, "MEDIUM"), other="LOW"), category="performance", title=F.col("method"), confidence=F.least(F.lit(0.9), 0.6 + F.col("pct") / 100), occurrences=F.col("n_calls"), event_ids=F.col("event_ids"))
    slow = expensive_methods(stats, hot).withColumn("avg_ms", F.col("average") / 1e6)
    dear = issue(slow, "cpu_hotspots", type="SLOW_METHOD", severity=ladder(F.col("avg_ms"), (500, "HIGH"), (200, "MEDIUM"), other="LOW"), category="performance", title=F.col("method"), confidence=F.when(F.col("n_calls") > 1, 0.85).otherwise(0.7), occurrences=F.col("n_calls"), event_ids=F.col("event_ids"))
    return timeout.unionByName(spots).unionByName(dear)


def repeated(events: DataFrame, pattern: Column, time: Column, log: str = "log_id", order: str = "id", least: int = 3, rapid_ms: float = 10.0) -> DataFrame:
    """Patterns that a log has `least` times or more: count, gaps between neighbours in ms, score and severity."""
    rows = events.select(log, order, pattern.alias("pattern"), time.alias("_ms")).where("pattern is not null")
    w = Window.partitionBy(log, "pattern").orderBy("_ms", order)
    gap = rows.withColumn("gap", F.col("_ms") - F.lag("_ms").over(w))
    out = gap.groupBy(log, "pattern").agg(F.count("*").alias("n"), F.avg("gap").alias("avg_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.min(order).alias("first_id"), F.sort_array(F.collect_list(order)).alias("event_ids")).where(F.col("n") >= least)
    rapid = F.col("avg_gap") < rapid_ms
    score = 0.5 + F.when(F.col("n") >= 10, 0.2).when(F.col("n") >= 5, 0.1).otherwise(0) + F.when(rapid, 0.2).otherwise(0) + F.when(F.col("max_gap") - F.col("min_gap") < 1, 0.1).otherwise(0)
    return out.withColumns({"rapid": rapid, "score": F.round(score, 4), "severity": ladder(F.col("n"), (20, "HIGH"), (10, "MEDIUM"), other="LOW")})


def method_loop_queries(tree: DataFrame) -> DataFrame:
    """Methods entered three times or more with a query under some entry: calls, queries, events, score and severity by calls."""
    name = F.concat_ws(".", "class_name", "method_name")
    entries = tree.where("type = 'METHOD_ENTRY'").select("log_id", "id", name.alias("method"))
    often = entries.groupBy("log_id", "method").agg(F.count("*").alias("n_calls"), F.sort_array(F.collect_list("id")).alias("calls")).where("n_calls >= 3")
    over = with_ancestors(tree, F.col("type") == "METHOD_ENTRY").join(tree.where("type = 'SOQL_EXECUTE_BEGIN'").select("log_id", "id"), ["log_id", "id"], "left_semi")
    hits = over.join(entries.withColumnRenamed("id", "ancestor_id"), ["log_id", "ancestor_id"]).groupBy("log_id", "method").agg(F.sort_array(F.collect_set("id")).alias("queries"))
    scored = {"n_queries": F.size("queries"), "event_ids": F.concat("calls", "queries"), "confidence": F.least(F.lit(0.95), 0.5 + F.col("n_calls") / 20)}
    return often.join(hits, ["log_id", "method"]).withColumns({**scored, "severity": ladder(F.col("n_calls"), (20, "CRITICAL"), (10, "HIGH"), other="MEDIUM")}).drop("calls", "queries")


def dedupe_issues(issues: DataFrame, ids: str = "event_ids", key: str = "log_id", order: str = "det_seq") -> DataFrame:
    """One issue for each set of events (ids compared as text), the first."""
    same = F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")
    first = F.row_number().over(Window.partitionBy(key, same).orderBy(order))
    return issues.withColumn("_r", first).where("_r = 1").drop("_r")


def query_loop_issues(tree: DataFrame) -> DataFrame:
    """Repeated queries and methods that query in a loop, in a log with at least two queries."""
    begins = tree.where("type = 'SOQL_EXECUTE_BEGIN'")
    found_ = repeated(begins, normalize_query(F.col("query")), F.col("timestamp") / 1e6).where("score >= 0.6")
    loops = issue(found_, "query_in_loop", type="SOQL_IN_LOOP", severity=ladder(F.col("n"), (20, "CRITICAL"), (10, "HIGH"), other="MEDIUM"), title=F.substring("pattern", 1, 200), confidence=F.col("score"), occurrences=F.col("n"), event_ids=F.col("event_ids")).withColumn("det_seq", F.lit(0))
    methods = method_loop_queries(tree)
    more = issue(methods, "query_in_loop", type="SOQL_IN_LOOP", severity=F.col("severity"), title=F.col("method"), confidence=F.col("confidence"), occurrences=F.col("n_calls"), event_ids=F.col("event_ids")).withColumn("det_seq", F.lit(1))
    return dedupe_issues(loops.unionByName(more)).drop("det_seq")


def n_plus_one(groups: DataFrame, parents: DataFrame, log: str = "log_id") -> DataFrame:
    """For each group of equal child queries the latest earlier query of another object whose rows fit its count.

    groups: log, group_id, object, n, first_ts; parents: log, id, ts, object, rows. The rows fit if they equal the count or
    the count is 0.8 to 1.2 times them."""
    p = parents.select(log, F.col("id").alias("parent_id"), F.col("ts").alias("parent_ts"), F.col("object").alias("parent_object"), F.col("rows").alias("parent_rows")).where("parent_rows > 0")
    fit = (F.col("parent_ts") < F.col("first_ts")) & (F.col("parent_object") != F.col("object")) & (F.col("n") / F.col("parent_rows")).between(0.8, 1.2)
    pairs = groups.join(p, log).where(fit)
    best = F.max_by(F.struct("parent_id", "parent_ts", "parent_object", "parent_rows"), F.struct("parent_ts", "parent_id"))
    return pairs.groupBy(log, "group_id", "object", "n", "first_ts").agg(best.alias("_b")).select(log, "group_id", "object", "n", "first_ts", "_b.*", (F.col("n") == F.col("_b.parent_rows")).alias("exact"))


def n_plus_one_issues(tree: DataFrame, fixed: bool = True) -> DataFrame:
    """One query per row of an earlier one. With `fixed`, a query's rows are those its end event tells."""
    begins = tree.where("type = 'SOQL_EXECUTE_BEGIN' and query is not null")
    if fixed:
        ends = tree.where("type = 'SOQL_EXECUTE_END'").select("log_id", F.col("parent_id").alias("id"), F.col("row_count").alias("_rows"))
        begins = begins.join(ends, ["log_id", "id"], "left").withColumn("row_count", F.coalesce("row_count", "_rows"))
    begins = begins.withColumns({"pattern": normalize_query(F.col("query")), "object": query_object(F.col("query")), "field": found(F.col("query"), r"(?i)WHERE\s+(\w+)\s*=")})
    groups = repeated(begins, F.col("pattern"), F.col("timestamp") / 1e6)
    first = begins.groupBy("log_id", "pattern").agg(F.min_by("object", "id").alias("object"), F.min_by("field", "id").alias("field"), F.min("timestamp").alias("first_ts"))
    groups = groups.join(first, ["log_id", "pattern"]).withColumn("group_id", F.col("first_id"))
    found_ = n_plus_one(groups.select("log_id", "group_id", "object", "n", "first_ts"), begins.select("log_id", "id", F.col("timestamp").alias("ts"), "object", F.col("row_count").alias("rows")))
    d = found_.join(groups.select("log_id", "group_id", "field", "avg_gap", "event_ids"), ["log_id", "group_id"])
    inside = lambda a, b: F.col("parent_object").contains(a) & F.col("object").contains(b)
    known = reduce(lambda x, y: x | y, [inside(a, b) | inside(b, a) for a, b in KNOWN_PAIRS])
    score = 0.5 + F.when(F.col("exact"), 0.3).otherwise(0.15) + F.when(F.col("field").rlike(r"(Id|__c)$"), 0.1).otherwise(0) + F.when(F.col("avg_gap") < 10, 0.1).otherwise(0) + F.when(known, 0.1).otherwise(0)
    d = d.withColumn("score", F.least(F.lit(1.0), score)).where("score >= 0.6")
    return issue(d, "n_plus_one", type="N_PLUS_ONE", severity=ladder(F.col("n"), (20, "CRITICAL"), (10, "HIGH"), other="MEDIUM"), title=F.concat("parent_object", F.lit(" -> "), "object"), confidence=F.col("score"), occurrences=F.col("n"), event_ids=F.col("event_ids"))


def direct_recursion(starts: DataFrame, log: str = "log_id", name: str = "unit_name", order: str = "id") -> DataFrame:
    """starts (log, name, depth, from_dml): units that run inside themselves or, more than three times, from writes."""
    w = Window.partitionBy(log, name).orderBy(order)
    rows = starts.withColumn("_nested", F.col("depth") > F.lag("depth").over(w))
    out = rows.groupBy(log, name).agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"), F.coalesce(F.bool_or("_nested"), F.lit(False)).alias("nested"), F.bool_or("from_dml").alias("from_dml"), F.sort_array(F.collect_list(order)).alias("event_ids")).where("n >= 2 and (nested or (n > 3 and from_dml))")
    score = 0.5 + F.when(F.col("n") >= 10, 0.25).when(F.col("n") >= 5, 0.15).otherwise(0) + F.when(F.col("max_depth") >= 3, 0.2).otherwise(0) + F.when(F.col("from_dml"), 0.15).otherwise(0)
    severity = F.when(F.col("max_depth") >= 5, "CRITICAL").when((F.col("max_depth") >= 3) | (F.col("n") >= 10), "HIGH").otherwise("MEDIUM")
    return out.withColumns({"score": F.round(F.least(F.lit(1.0), score), 4), "severity": severity})


def trigger_object(name: Column) -> Column:
    """The object that a trigger's name tells, else the name."""
    return F.coalesce(*[found(name, f"(?i){p}", g) for p, g in TRIGGER_NAMES], name)


def next_triggers(starts: DataFrame, writes: DataFrame, closes: DataFrame) -> DataFrame:
    """(log_id, id, next_id): the first later trigger on an object that the trigger wrote before it finished."""
    done = starts.join(closes.select("log_id", F.col("unit_name"), F.col("timestamp").alias("done_ts")), ["log_id", "unit_name"]).where("done_ts > timestamp").groupBy("log_id", "id", "timestamp").agg(F.min("done_ts").alias("done_ts"))
    wrote = done.join(writes.select("log_id", F.col("timestamp").alias("w_ts"), F.col("sobject_type").alias("object")), "log_id").where("w_ts > timestamp and w_ts < done_ts").select("log_id", "id", "timestamp", "object").distinct()
    later = starts.select("log_id", F.col("id").alias("next_id"), F.col("timestamp").alias("next_ts"), "object")
    return wrote.join(later, ["log_id", "object"]).where("next_ts > timestamp").groupBy("log_id", "id").agg(F.min_by("next_id", F.struct("next_ts", "next_id")).alias("next_id"))


def trigger_chains(starts: DataFrame, steps: DataFrame, longest: int = 11) -> DataFrame:
    """(log_id, id, chain): ids reached from each trigger by next_id, at most `longest`, never the same twice."""
    chain = starts.select("log_id", "id", F.array("id").alias("chain"), F.col("id").alias("_at"))
    step = steps.select("log_id", F.col("id").alias("_at"), "next_id")
    for _ in range(longest - 1):
        joined = chain.join(step, ["log_id", "_at"], "left")
        go = F.col("next_id").isNotNull() & ~F.array_contains("chain", F.col("next_id"))
        chain = joined.select("log_id", "id", F.when(go, F.concat("chain", F.array("next_id"))).otherwise(F.col("chain")).alias("chain"), F.when(go, F.col("next_id")).alias("_at"))
    return chain.select("log_id", "id", "chain")


def recursion_issues(tree: DataFrame) -> DataFrame:
    starts = tree.where("type = 'CODE_UNIT_STARTED' and unit_type = 'Trigger'").withColumns({"unit_name": F.coalesce("unit_name", F.lit("Unknown"))})
    writes = tree.where(F.col("type").isin("DML_BEGIN", "DML_END"))
    over = with_ancestors(tree, F.col("type") == "DML_BEGIN").select("log_id", "id").distinct().withColumn("from_dml", F.lit(True))
    placed = starts.join(over, ["log_id", "id"], "left").select("log_id", "id", "unit_name", (F.col("depth") + 1).alias("depth"), F.coalesce("from_dml", F.lit(False)).alias("from_dml"))
    direct = direct_recursion(placed)
    one = issue(direct.where("score >= 0.5"), "recursive_trigger", type="RECURSIVE_TRIGGER", severity=F.col("severity"), category="logic", title=F.col("unit_name"), confidence=F.col("score"), occurrences=F.col("n"), event_ids=F.col("event_ids"))
    named = starts.select("log_id", "id", "timestamp", "unit_name", F.coalesce("trigger_object", trigger_object(F.col("unit_name"))).alias("object"))
    steps = next_triggers(named, writes, tree.where("type = 'CODE_UNIT_FINISHED'"))
    links = trigger_chains(named, steps).where("size(chain) >= 3").select("log_id", F.col("id").alias("chain_id"), "chain", F.explode("chain").alias("id"))
    names = links.join(placed, ["log_id", "id"]).groupBy("log_id", "chain_id", "chain").agg(F.count("*").alias("n"), F.count_distinct("unit_name").alias("names"), F.max("depth").alias("max_depth"), F.min_by("unit_name", "id").alias("first_name")).where("names < n")
    severity = F.when(F.col("max_depth") >= 5, "CRITICAL").when((F.col("max_depth") >= 3) | (F.col("n") >= 10), "HIGH").otherwise("MEDIUM")
    two = issue(names, "recursive_trigger", type="RECURSIVE_TRIGGER", severity=severity, category="logic", title=F.concat(F.lit("chain from "), "first_name"), confidence=0.6, occurrences=F.col("n"), event_ids=F.col("chain"))
    return one.unionByName(two)


def plan_selectivity(cost: Column, rows: Column, operation: Column) -> tuple[Column, Column]:
    """(number of findings, severity) of a query plan: later rules decide the severity."""
    scan = F.coalesce(operation == "TableScan", F.lit(False))
    dear, many = F.coalesce(cost > 1, F.lit(False)), F.coalesce(rows > 10_000, F.lit(False))
    n = dear.cast("int") + many.cast("int") + scan.cast("int")
    severity = F.when(scan, "HIGH").when(many, F.when(rows > 100_000, "HIGH").otherwise("MEDIUM")).when(dear, F.when(cost > 2, "HIGH").otherwise("MEDIUM"))
    return n, severity


def _heuristics(query: Column) -> list[tuple[Column, float]]:
    """(finding, weight) of what a query's text shows; what is said of filters is sought in the WHERE clause alone."""
    q = F.upper(query)
    where = q.contains("WHERE")
    clause = F.trim(F.regexp_extract(q, r"WHERE\s+(.+?)(?:ORDER BY|GROUP BY|LIMIT|\z)", 1))
    filters = where & (clause != "")
    indexed = clause.rlike(ascii_words("|".join(f"(?:{p})" for p in INDEXED_FIELDS)))
    return [
        (~where, 0.3),
        (filters & clause.rlike(r"%\w|LIKE\s+'%"), 0.25),
        (filters & clause.rlike(r"NOT\s+IN|!=|<>"), 0.15),
        (filters & clause.rlike(r"\sOR\s"), 0.1),
        (filters & ~indexed, 0.2),
        (q.rlike(r"SELECT\s+\*|SELECT.*,.*,.*,.*,"), 0.1),
        (~where & ~q.contains("LIMIT"), 0.2),
    ]


def heuristic_total(query: Column) -> Column:
    """Sum of the findings' weights, null without a query."""
    return F.when(query != "", F.round(reduce(lambda a, b: a + b, [F.when(f, w).otherwise(0.0) for f, w in _heuristics(query)]), 4))


def heuristic_severity(total: Column) -> Column:
    """Null where nothing was found."""
    return F.when(total >= 0.4, "HIGH").when(total >= 0.25, "MEDIUM").when(total > 0, "LOW")


def query_heuristics(query: Column) -> Column:
    """Score of what makes a query unselective, at most 0.85; 0 without a query."""
    return F.least(F.lit(0.85), F.coalesce(heuristic_total(query), F.lit(0.0)))


def likely_non_selective(query: Column) -> Column:
    q = F.lower(query)
    return ~q.contains("where") | q.rlike(r"like\s+'%") | q.rlike(r"not\s+in|!=")


def row_count_severity(rows: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 1000, "HIGH").when(rows >= 10_000, "HIGH").when(rows >= 1000, "MEDIUM")


def selectivity_issues(tree: DataFrame) -> DataFrame:
    """Plans, else the query's text, else the number of rows: the first that finds something."""
    e = tree.where(F.col("type").isin(*S.QUERY_TYPES))
    n, by_plan = plan_selectivity(F.col("query_plan.relative_cost"), F.col("query_plan.cardinality"), F.col("query_plan.leading_operation_type"))
    score = query_heuristics(F.col("query"))
    by_text = heuristic_severity(heuristic_total(F.col("query")))
    by_rows = F.when((F.col("type") == "SOQL_EXECUTE_END") & (F.col("row_count") >= 1000), row_count_severity(F.col("row_count"), F.col("duration") / 1e6))
    e = e.withColumns({"_sev": F.coalesce(by_plan, by_text, by_rows), "_conf": F.when(by_plan.isNotNull(), F.least(F.lit(0.95), 0.6 + 0.1 * n)).when(by_text.isNotNull(), score).otherwise(F.when(F.col("row_count") >= 10_000, 0.85).otherwise(0.65))}).where("_sev is not null")
    return issue(e, "non_selective", type=F.when(F.col("_sev") == "HIGH", "NON_SELECTIVE_QUERY").otherwise("SLOW_QUERY"), severity=F.col("_sev"), title=F.coalesce(F.substring("query", 1, 200), F.lit("query plan")), confidence=F.col("_conf"), occurrences=F.lit(1), event_ids=F.array("id"))
