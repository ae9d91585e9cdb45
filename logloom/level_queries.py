"""Levels and limitations of logs over the events table, with the same result in SQL.

A log is a user's events; its types go by user and event. Users take turns in having a header with a list of levels, one with a line for each, one that names none, or no line that is a header."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import levels, truncation
from .queries import register, rounded, table

_TYPES = ("EXECUTION_STARTED", "SOQL_EXECUTE_BEGIN", "CODE_UNIT_STARTED", "METHOD_ENTRY", "LIMIT_USAGE", "USER_INFO", "SOQL_EXECUTE_EXPLAIN", "ENTERING_MANAGED_PKG", "HEAP_ALLOCATE", "FLOW_ELEMENT_BEGIN", "CALLOUT_REQUEST", "STATEMENT_EXECUTE", "VARIABLE_SCOPE_BEGIN")
_RANKS = ("NONE", "ERROR", "WARN", "INFO", "DEBUG", "FINE", "FINER", "FINEST")
#: What each type implies: plain, so that the SQL doesn't rest on the library's table.
_IMPLIED = "(VALUES ('EXECUTION_STARTED', 'Apex_code', 1), ('SOQL_EXECUTE_BEGIN', 'Database', 3), ('CODE_UNIT_STARTED', 'Apex_code', 4), ('METHOD_ENTRY', 'Apex_code', 5), ('LIMIT_USAGE', 'System', 3), ('SOQL_EXECUTE_EXPLAIN', 'Database', 5), ('ENTERING_MANAGED_PKG', 'Apex_profiling', 3), ('HEAP_ALLOCATE', 'System', 6), ('FLOW_ELEMENT_BEGIN', 'Workflow', 5), ('CALLOUT_REQUEST', 'Callout', 3), ('STATEMENT_EXECUTE', 'Apex_code', 7), ('VARIABLE_SCOPE_BEGIN', 'Apex_code', 6)) AS m(type, category, r)"
_NEEDS = "(VALUES (0, 'Apex_code', 1), (0, 'System', 3), (1, 'Database', 3), (2, 'Database', 3), (3, 'Database', 5), (4, 'Apex_code', 5), (4, 'Apex_profiling', 5), (5, 'Apex_code', 4), (6, 'Apex_code', 6), (7, 'Apex_code', 7), (8, 'System', 6), (9, 'Workflow', 3), (10, 'Callout', 3), (11, 'Apex_profiling', 3)) AS q(cap, category, r)"
_DETECTORS = "(VALUES (0, 'GOVERNOR_LIMITS_ANALYZER'), (1, 'SOQL_IN_LOOP_DETECTOR'), (1, 'N+1_QUERY_DETECTOR'), (3, 'NON-SELECTIVE_QUERY_DETECTOR'), (4, 'CPU_HOTSPOT_DETECTOR'), (5, 'RECURSIVE_TRIGGER_DETECTOR')) AS d(cap, detector)"
_BEST = "(VALUES ('Apex_code', 5), ('Apex_profiling', 5), ('Database', 5), ('System', 3), ('Callout', 3), ('Workflow', 3)) AS b(category, r)"
_NAME = "list_extract(" + repr(list(_RANKS)) + ", CAST({} AS BIGINT) + 1)"
_LEVELS = f"""u AS (SELECT DISTINCT user_id AS u FROM events), ty AS (SELECT user_id AS u, list_extract({list(_TYPES)!r}, 1 + (user_id + event_id % (1 + user_id % 5)) % 13) AS type FROM events),
said AS (SELECT u, 'Apex_code' AS category, u % 8 AS r FROM u WHERE u % 4 = 0 UNION ALL SELECT u, 'Database', u // 4 % 8 FROM u WHERE u % 4 = 0 UNION ALL SELECT u, 'Apex_profiling', 5 FROM u WHERE u % 4 = 0
 UNION ALL SELECT u, 'Apex_code', u // 4 % 8 FROM u WHERE u % 4 = 1 UNION ALL SELECT u, 'System', u // 8 % 8 FROM u WHERE u % 4 = 1 UNION ALL SELECT u, 'Workflow', 4 FROM u WHERE u % 4 = 1),
seen AS (SELECT u, type, category, r FROM (SELECT DISTINCT u, type FROM ty) JOIN {_IMPLIED} USING (type)), sized AS (SELECT u, count(*) AS n FROM ty GROUP BY 1),
ev AS (SELECT u, count(*) AS t, count(DISTINCT category) AS c FROM seen GROUP BY 1),
det AS (SELECT u.u, CASE WHEN u.u IN (SELECT u FROM said) THEN 'HEADER' WHEN t > 0 THEN 'INFERRED' ELSE 'UNKNOWN' END AS method, CASE WHEN u.u IN (SELECT u FROM said) THEN 1 WHEN t > 0 THEN least(t / 10, 0.5) + least(c / 6, 0.3) + least(n / 1000, 0.2) ELSE 0 END AS confidence FROM u LEFT JOIN ev USING (u) LEFT JOIN sized USING (u)),
lv AS (SELECT u, category, r AS have FROM said UNION ALL SELECT u, category, max(r) FROM seen WHERE u NOT IN (SELECT u FROM said) GROUP BY 1, 2),
ca AS (SELECT det.u, cap, CASE WHEN bool_and(coalesce(have >= q.r, false)) THEN 'FULL' WHEN bool_or(coalesce(have >= q.r - 1, false)) THEN 'PARTIAL' ELSE 'NONE' END AS status, avg(CASE WHEN have >= q.r THEN 1 WHEN have = q.r - 1 THEN 0.5 ELSE 0 END) * any_value(confidence) AS confidence FROM det, {_NEEDS} LEFT JOIN lv ON lv.u = det.u AND lv.category = q.category GROUP BY 1, 2),
li AS (SELECT u, 'UNKNOWN_LEVELS' AS id, 'WARNING' AS severity, NULL AS current_level FROM det WHERE method = 'UNKNOWN' UNION ALL SELECT u, 'INFERRED_LEVELS', 'INFO', NULL FROM det WHERE method = 'INFERRED' UNION ALL SELECT u, 'LOW_CONFIDENCE', 'WARNING', NULL FROM det WHERE confidence < 0.5
 UNION ALL SELECT det.u, upper(b.category) || '_LEVEL_LOW', CASE WHEN have IS NULL THEN 'WARNING' ELSE 'INFO' END, {_NAME.format('have')} FROM det CROSS JOIN {_BEST} LEFT JOIN lv ON lv.u = det.u AND lv.category = b.category WHERE have IS NULL OR have < b.r
 UNION ALL SELECT u, 'DETECTOR_' || detector || CASE status WHEN 'NONE' THEN '_UNAVAILABLE' ELSE '_PARTIAL' END, CASE status WHEN 'NONE' THEN 'WARNING' ELSE 'INFO' END, NULL FROM ca JOIN {_DETECTORS} USING (cap) WHERE status <> 'FULL'
 UNION ALL SELECT det.u, 'MISSING_' || upper(x.category), 'CRITICAL', NULL FROM det CROSS JOIN (VALUES ('Apex_code'), ('Database'), ('System')) AS x(category) LEFT JOIN lv ON lv.u = det.u AND lv.category = x.category WHERE have IS NULL)"""


def _detected(spark, sf):
    e = table(spark, sf, "events")
    u, named = F.col("user_id"), lambda n: F.element_at(F.array(*map(F.lit, _RANKS)), (n % 8 + 1).cast("int"))
    kinds = F.array(*map(F.lit, _TYPES))
    events = e.select(u.alias("log_id"), F.element_at(kinds, ((u + F.col("event_id") % (1 + u % 5)) % 13 + 1).cast("int")).alias("type"))
    by_4, by_8 = F.floor(u / 4), F.floor(u / 8)
    head = (
        F.when(u % 4 == 0, F.array(F.concat(F.lit("59.0 APEX_CODE,"), named(u), F.lit(";DB,"), named(by_4), F.lit(";APEX_PROFILING,FINE;ODD,INFO"))))
        .when(u % 4 == 1, F.array(F.lit("Apex Code: FINEST"), F.concat(F.lit("apex code:"), F.lower(named(by_4))), F.concat(F.lit("System: "), named(by_8), F.lit(" ")), F.lit("Workflow:DEBUG"), F.lit("Workflow: LOUD")))
        .when(u % 4 == 2, F.array(F.lit("59.0 ODD,INFO"), F.lit("Database: very loud"))).otherwise(F.array(F.lit("")))
    )
    lines = e.select("user_id").distinct().select(u.alias("log_id"), F.posexplode(head).alias("p", "value")).select("log_id", (F.col("p") + 1).alias("line_number"), "value")
    return levels.detect(lines, events, truncation.implied_levels(spark))


@register(f"WITH {_LEVELS} SELECT det.u AS log_id, method, round(confidence, 6)::DOUBLE AS confidence, array_to_string(list_sort(list(category || ':' || {_NAME.format('have')}) FILTER (have IS NOT NULL)), ',') AS levels FROM det LEFT JOIN lv USING (u) GROUP BY ALL")
def detected_levels(spark, sf):
    name = F.array(*map(F.lit, _RANKS))
    listed = F.array_sort(F.transform(F.map_entries("levels"), lambda x: F.concat(x["key"], F.lit(":"), F.get(name, x["value"]))))
    return _detected(spark, sf).select("log_id", "method", rounded(F.col("confidence"), 6).alias("confidence"), F.when(F.size("levels") > 0, F.array_join(listed, ",")).alias("levels"))


@register(f"WITH {_LEVELS} SELECT u AS log_id, cap, status, round(confidence, 6)::DOUBLE AS confidence FROM ca")
def level_capabilities(spark, sf):
    return levels.assess(_detected(spark, sf)).select("log_id", F.posexplode("capabilities").alias("cap", "c")).select("log_id", "cap", "c.status", rounded(F.col("c.confidence"), 6).alias("confidence"))


@register(f"WITH {_LEVELS} SELECT u AS log_id, id, severity, current_level FROM li")
def level_limitations(spark, sf):
    limited = levels.limitations(levels.assess(_detected(spark, sf)))
    return limited.select("log_id", F.explode("limitations").alias("x")).select("log_id", "x.id", "x.severity", "x.current_level")


@register(f"""WITH {_LEVELS}, sc AS (SELECT u, floor((100 * count(*) FILTER (status = 'FULL') + 50 * count(*) FILTER (status = 'PARTIAL')) / 12 + 0.5)::BIGINT AS score FROM ca GROUP BY 1),
n AS (SELECT u, score, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'INFO') AS i FROM sc LEFT JOIN li USING (u) GROUP BY 1, 2), s AS (SELECT *, greatest(0, least(100, score - 20 * c - 10 * w - 2 * i)) AS rel FROM n)
SELECT u AS log_id, c::INTEGER AS n_critical, w::INTEGER AS n_warning, i::INTEGER AS n_info, rel::BIGINT AS reliability, CASE WHEN c > 0 THEN 'CRITICAL: ' || c || ' critical limitation(s) - analysis highly unreliable (' WHEN w > 0 THEN 'WARNING: ' || w || ' limitation(s) may affect analysis accuracy (' WHEN i > 0 THEN 'Minor limitations present but analysis should be reliable (' ELSE 'No significant limitations - analysis is reliable (' END || rel || '% reliability)' AS summary FROM s""")
def level_report(spark, sf):
    return levels.report(levels.limitations(levels.assess(_detected(spark, sf))))
