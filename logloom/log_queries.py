"""Queries of the operators that look at whole logs: calls matched by name, unified views, summaries under a budget, streams with state.

As in `queries`, a user of the events table is a log; here signup and purchase open and close calls of four names that don't match up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import calls, lanes, memory, privacy, summary, unified
from .queries import _TREE, events, register, table, user_tree

_CALLS = """RECURSIVE m AS (SELECT user_id AS log_id, event_id AS id, event_type = 'signup' AS opens, 'm' || (event_id % 4) AS name, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k
  FROM events WHERE event_type IN ('signup', 'purchase')),
s AS (
  SELECT DISTINCT log_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, name VARCHAR, t BIGINT)[]) AS st, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS close_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS span, CAST(NULL AS BIGINT) AS parent_id FROM m
  UNION ALL
  SELECT log_id, k, CASE WHEN opens THEN list_append(st, {'id': id, 'name': name, 't': t}) ELSE rest END,
    CASE WHEN p > 0 THEN st[p].id END, CASE WHEN p > 0 THEN id END, CASE WHEN p > 0 THEN name END, CASE WHEN p > 0 THEN t - st[p].t END, CASE WHEN p > 0 AND len(rest) > 0 THEN rest[len(rest)].id END
  FROM (SELECT *, CASE WHEN p > 0 THEN list_concat(st[1:p - 1], st[p + 1:]) ELSE st END AS rest
    FROM (SELECT m.log_id, m.k, m.opens, m.id, m.name, m.t, s.st, CASE WHEN m.opens THEN 0 ELSE coalesce(list_max(list_filter(range(1, len(s.st) + 1), lambda i: s.st[i].name = m.name)), 0) END AS p
      FROM s JOIN m ON m.log_id = s.log_id AND m.k = s.k + 1))
), calls AS (SELECT log_id, id, close_id, name, span, parent_id FROM s WHERE close_id IS NOT NULL),
inner_ AS (SELECT log_id, parent_id AS id, sum(span) AS n FROM calls WHERE parent_id IS NOT NULL GROUP BY 1, 2),
timed AS (SELECT c.*, greatest(0, c.span - coalesce(i.n, 0)) AS own FROM calls c LEFT JOIN inner_ i ON i.log_id = c.log_id AND i.id = c.id)"""


def _calls(spark, sf):
    e = events(spark, sf).drop("duration")
    return calls.signature_calls(e, F.concat(F.lit("m"), (F.col("id") % 4).cast("string")), ("signup",), ("purchase",))


@register(f"WITH {_CALLS} SELECT log_id, id, close_id, name AS method, CAST(span AS DOUBLE) AS inclusive, CAST(own AS DOUBLE) AS exclusive, parent_id FROM timed")
def signature_calls(spark, sf):
    return _calls(spark, sf)


@register(f"WITH {_CALLS} SELECT log_id, name AS method, count(*) AS n_calls, CAST(sum(span) AS DOUBLE) AS inclusive, CAST(sum(own) AS DOUBLE) AS exclusive, CAST(max(span) AS DOUBLE) AS longest FROM timed GROUP BY 1, 2")
def signature_stats(spark, sf):
    from .operators.detect import method_stats

    return method_stats(_calls(spark, sf)).select("log_id", "method", "n_calls", "inclusive", "exclusive", "longest")


_LOGS = """logs AS (SELECT user_id AS log_id, min(epoch_us(ts)) * 1000 AS a, max(epoch_us(ts)) * 1000 AS b, 1 - (user_id % 5) / 10.0 AS extraction FROM events WHERE user_id % 11 <> 7 GROUP BY user_id),
links AS (SELECT event_id, user_id AS log_id, ['QUEUEABLE', 'BATCH', 'FUTURE', 'SCHEDULABLE'][1 + event_id % 4] AS job_type, CASE WHEN value > 60 THEN 'FAILED' WHEN value > 50 THEN 'ABORTED' WHEN value > 1 THEN 'COMPLETED' ELSE 'QUEUED' END AS status,
  CASE WHEN user_id % 13 = 5 THEN user_id + 1 WHEN user_id % 13 = 6 THEN user_id - 1 WHEN event_id % 3 > 0 THEN 4 * user_id + event_id % 5 END AS child, floor(value) AS delay, event_id % 2 AS errors, (event_id % 100) / 100.0 AS confidence
  FROM events WHERE event_type = 'signup' AND (event_id % 3 > 0 OR value > 20))"""
_FOREST = f"""WITH RECURSIVE {_LOGS}, parents AS (SELECT child, arg_min(log_id, struct_pack(c := -confidence, l := log_id)) AS parent FROM links WHERE child IS NOT NULL AND child <> log_id GROUP BY child),
nodes AS (SELECT DISTINCT n FROM (SELECT log_id AS n FROM logs UNION ALL SELECT log_id FROM links UNION ALL SELECT child FROM links) WHERE n IS NOT NULL),
up AS (SELECT n, n AS x, CAST(0 AS BIGINT) AS d FROM nodes UNION ALL SELECT n, parent, d + 1 FROM up JOIN parents ON child = x WHERE d < (SELECT count(*) FROM nodes)),
circle AS (SELECT DISTINCT x FROM up WHERE d = (SELECT count(*) FROM nodes)),
ring AS (SELECT x AS n, x, CAST(0 AS BIGINT) AS d FROM circle UNION ALL SELECT n, parent, d + 1 FROM ring JOIN parents ON child = x WHERE d < (SELECT count(*) FROM circle)),
cut AS (SELECT n FROM ring GROUP BY n HAVING min(x) = n),
kept AS (SELECT * FROM parents WHERE child NOT IN (SELECT n FROM cut)),
path AS (SELECT n, n AS x, CAST(0 AS BIGINT) AS d FROM nodes UNION ALL SELECT n, parent, d + 1 FROM path JOIN kept ON child = x),
forest AS (SELECT n AS log_id, arg_max(x, d) AS root_id, max(d) AS depth FROM path GROUP BY n)"""


def _unified(spark, sf):
    e = table(spark, sf, "events")
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    logs = e.where(u % 11 != 7).groupBy(u.alias("log_id")).agg(F.min(ns).alias("start_ns"), F.max(ns).alias("end_ns")).withColumn("extraction", 1 - (F.col("log_id") % 5) / 10)
    kinds = F.array(*map(F.lit, ("QUEUEABLE", "BATCH", "FUTURE", "SCHEDULABLE")))
    status = F.when(v > 60, "FAILED").when(v > 50, "ABORTED").when(v > 1, "COMPLETED").otherwise("QUEUED")
    child = F.when(u % 13 == 5, u + 1).when(u % 13 == 6, u - 1).when(i % 3 > 0, 4 * u + i % 5)
    links = e.where("event_type = 'signup'").where((i % 3 > 0) | (v > 20))
    links = links.select(u.alias("log_id"), F.get(kinds, (i % 4).cast("int")).alias("job_type"), status.alias("job_status"), child.alias("child_id"), F.floor(v).alias("queue_delay_ms"), (i % 2).alias("errors"), ((i % 100) / 100).alias("confidence"))
    return logs, links


@register(f"{_FOREST} SELECT f.log_id, root_id, kept.parent AS parent_id, depth, ['PARENT', 'CHILD', 'GRANDCHILD'][1 + least(depth, 2)] AS role FROM forest f LEFT JOIN kept ON kept.child = f.log_id")
def unified_forest(spark, sf):
    return unified.forest(*_unified(spark, sf))


@register(f"""{_FOREST}, own AS (SELECT root_id, count(*) AS n_logs, max(depth) AS depth, coalesce(sum((b - a) / 1e6), 0) AS ms, max(CASE WHEN depth = 0 THEN extraction END) AS extraction FROM forest LEFT JOIN logs USING (log_id) GROUP BY 1),
j AS (SELECT root_id, count(*) AS n_jobs, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'ABORTED') AS aborted, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'QUEUED') AS queued, sum(errors) AS errors, sum(delay) AS delay, count(child) AS found,
  avg(confidence) AS mean, count(*) FILTER (job_type = 'QUEUEABLE') AS q, count(*) FILTER (job_type = 'BATCH') AS b, count(*) FILTER (job_type = 'FUTURE') AS f, count(*) FILTER (job_type = 'SCHEDULABLE') AS s FROM links JOIN forest USING (log_id) GROUP BY 1)
SELECT root_id, n_logs, depth, round(ms + coalesce(delay, 0), 3) AS total_ms, coalesce(n_jobs, 0) AS n_jobs, coalesce(failed, 0) AS failed, coalesce(aborted, 0) AS aborted, coalesce(completed, 0) AS completed, coalesce(queued, 0) AS queued, CAST(coalesce(errors, 0) AS BIGINT) AS errors,
  CASE WHEN coalesce(failed + aborted, 0) = 0 THEN 'SUCCESS' WHEN failed + aborted = n_jobs THEN 'FAILURE' ELSE 'PARTIAL_FAILURE' END AS status,
  round(greatest(0, least(1, CASE WHEN n_jobs > 0 THEN (coalesce(extraction, 1) + mean) / 2 - 0.1 * (n_jobs - found) ELSE coalesce(extraction, 1) END)) + 1e-9, 4) AS confidence,
  CASE WHEN n_jobs IS NULL THEN 'Synchronous execution (no async jobs)' ELSE concat_ws(' ', 'Parent execution', 'enqueued ' || concat_ws(', ', CASE WHEN q > 0 THEN q || ' Queueable job(s)' END, CASE WHEN b > 0 THEN b || ' Batch job(s)' END, CASE WHEN f > 0 THEN f || ' @future method(s)' END,
    CASE WHEN s > 0 THEN s || ' Scheduled job(s)' END), CASE WHEN found > 0 THEN '→ ' || found || '/' || n_jobs || ' correlated to child logs' END) END AS flow
FROM own LEFT JOIN j USING (root_id)""")
def unified_rollup(spark, sf):
    out = unified.unified_summaries(*_unified(spark, sf))
    return out.select("root_id", "n_logs", "depth", F.round("total_ms", 3).alias("total_ms"), "n_jobs", "failed", "aborted", "completed", "queued", "errors", "status", F.round(F.col("confidence") + 1e-9, 4).alias("confidence"), "flow")


def _budget_rows(spark, sf):
    """Issues are a user's errors, limits what orders come to, advice as long as an event's number says."""
    e = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("log_id"), "event_id", "value", "props")
    sev = F.when(F.col("value") > 60, "CRITICAL").when(F.col("value") > 30, "HIGH").otherwise("LOW")
    issues = e.withColumns({"severity": sev, "type": F.concat(F.lit("SLOW_QUERY_"), (F.col("event_id") % 3).cast("string")), "title": F.concat(F.lit('call "'), F.repeat(F.col("props"), (F.col("event_id") % 9).cast("int")), F.lit('" failed')), "can_modify": F.col("event_id") % 2 == 0})
    issues = issues.withColumn("priority", F.row_number().over(_per_log().orderBy(F.desc("value"), "event_id")))
    totals = issues.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") != "LOW").alias("urgent"))
    limits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("log_id"), F.col("o_orderpriority").alias("limit_name")).agg(F.count("*").alias("used"), F.max("o_orderkey").alias("id"))
    limits = limits.withColumn("max", F.lit(3)).withColumn("pct", F.least(F.lit(100.0), 100.0 * F.col("used") / 3))
    advice = issues.where("priority <= 8").select("log_id", "priority", F.lit(1).alias("place"), F.concat(F.lit("Review event kind "), (F.col("event_id") % 50).cast("string"), F.repeat(F.lit(" and its callers"), (F.col("event_id") % 50 % 16).cast("int"))).alias("text"))
    rows = totals.withColumn("health", F.greatest(F.lit(0), 100 - 4 * F.col("urgent") - F.col("n")).cast("long"))
    for part in (summary.compact_issues(issues), summary.limit_warnings(limits, order="limit_name"), summary.recommended(advice)):
        rows = rows.join(part, "log_id", "left")
    rows = summary.with_generic_advice(rows).withColumn("metrics", F.struct(F.col("n").alias("events"), F.col("n").alias("issues"), F.col("urgent").alias("criticalHigh"), F.lit(0).alias("soqlCount"), F.lit(0).alias("dmlCount")))
    rows = rows.withColumn("context", F.struct((F.col("log_id") % 2 == 0).alias("truncated"), F.array(F.concat(F.lit("ns"), (F.col("log_id") % 7).cast("string"))).alias("namespaces"), (1 - (F.col("log_id") % 3) / 4).alias("confidence")))
    rows = rows.withColumn("limitations", F.transform(F.sequence(F.lit(1), (F.col("log_id") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("limitation "), F.repeat(F.lit("of what the log holds "), i))))
    return rows.withColumn("status", summary.status_line(F.col("health"), F.col("urgent"), F.col("n")))


def _per_log():
    from pyspark.sql import Window

    return Window.partitionBy("log_id")


@register("""WITH e AS (SELECT user_id AS log_id, event_id, value, CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 30 THEN 'HIGH' ELSE 'LOW' END AS sev, 'SLOW QUERY ' || (event_id % 3) AS type, 'call "' || repeat(props, event_id % 9) || '" failed' AS title, event_id % 2 = 0 AS fixable,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events WHERE event_type = 'error'),
n AS (SELECT log_id, count(*) AS n, count(*) FILTER (sev <> 'LOW') AS urgent FROM e GROUP BY 1),
h AS (SELECT *, greatest(0, 100 - 4 * urgent - n) AS health FROM n),
i AS (SELECT log_id, list(length(json_quote(type)) + length(json_quote(CASE WHEN length(title) <= 60 THEN title ELSE title[1:57] || '...' END)) + length('{"type":,"desc":,"sev":"x","fixable":}') + CASE WHEN fixable THEN 4 ELSE 5 END ORDER BY p) AS i FROM e WHERE p <= 3 GROUP BY 1),
lim AS (SELECT o_custkey AS log_id, o_orderpriority AS name, count(*) AS used, least(100.0, 100.0 * count(*) / 3) AS pct FROM orders GROUP BY 1, 2),
w0 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pct DESC, name) AS p FROM lim WHERE pct > 50),
w AS (SELECT log_id, list(2 + 2 + length(' ' || name || ': ' || used || '/3 (' || CAST(floor(pct + 0.5) AS INTEGER) || '%)') ORDER BY p) AS w FROM w0 WHERE p <= 3 GROUP BY 1),
a0 AS (SELECT log_id, 'Review event kind ' || (event_id % 50) || repeat(' and its callers', event_id % 50 % 16) AS t, min(p) AS p FROM e WHERE p <= 8 GROUP BY 1, 2),
a1 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY p, t) AS k FROM a0),
a AS (SELECT log_id, list(length(t) + 2 ORDER BY k) AS a FROM a1 WHERE k <= 5 GROUP BY 1),
x AS (SELECT h.*, coalesce(i, []) AS i, coalesce(w, []) AS w, CASE WHEN health < 50 AND len(coalesce(a, [])) < 5 THEN list_append(coalesce(a, []), length('Consider enabling debug logging at FINEST level for more detail') + 2) ELSE coalesce(a, []) END AS a,
  list_transform(range(1, log_id % 4 + 2), lambda k: length('limitation ') + 22 * k + 2) AS l,
  CASE WHEN health >= 90 THEN 'Excellent' WHEN health >= 75 THEN 'Good' WHEN health >= 60 THEN 'Fair' WHEN health >= 40 THEN 'Poor' ELSE 'Critical' END || CASE WHEN urgent > 0 THEN ' - ' || urgent || ' high priority issue' || CASE WHEN urgent > 1 THEN 's' ELSE '' END WHEN n > 0 THEN ' - ' || n || ' issue' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' detected' ELSE ' - No issues detected' END AS status
  FROM h LEFT JOIN i USING (log_id) LEFT JOIN w USING (log_id) LEFT JOIN a USING (log_id)),
b AS (SELECT *, length('{"logId":"' || log_id || '","health":' || health || ',"status":"' || status || '","metrics":{"events":' || n || ',"issues":' || n || ',"criticalHigh":' || urgent || ',"soqlCount":0,"dmlCount":0},"topIssues":[],"limitWarnings":[],"recommendations":[],"aiContext":{"truncated":'
  || CASE WHEN log_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"namespaces":["ns' || (log_id % 7) || '"],"confidence":' || ['1', '0.75', '0.5'][1 + log_id % 3] || ',"limitations":[]},"tokenCount":0}') AS base FROM x),
s AS (SELECT *, list_sum(i)::BIGINT + greatest(0, len(i) - 1) AS si, coalesce(list_sum(w), 0)::BIGINT + greatest(0, len(w) - 1) AS sw, coalesce(list_sum(a), 0)::BIGINT + greatest(0, len(a) - 1) AS sa, list_sum(l)::BIGINT + greatest(0, len(l) - 1) AS sl FROM b),
t AS (SELECT *, CAST(ceil((base + si + sw + sa + sl) / 3.5) AS BIGINT) AS first, base + CASE WHEN ceil((base + si + sw + sa + sl) / 3.5) > 500 THEN length(CAST(CAST(ceil((base + si + sw + sa + sl) / 3.5) AS BIGINT) AS VARCHAR)) - 1 ELSE 0 END AS fixed FROM s),
c1 AS (SELECT *, coalesce(list_max(list_filter(range(least(2, len(a)), len(a) + 1), lambda k: fixed + si + sw + sl + coalesce(list_sum(a[1:k]), 0) + greatest(0, k - 1) <= 1750)), least(2, len(a))) AS na FROM t),
c2 AS (SELECT *, fixed + coalesce(list_sum(a[1:na]), 0) + greatest(0, na - 1) AS f1 FROM c1),
c3 AS (SELECT *, coalesce(list_max(list_filter(range(least(1, len(w)), len(w) + 1), lambda k: f1 + si + sl + coalesce(list_sum(w[1:k]), 0) + greatest(0, k - 1) <= 1750)), least(1, len(w))) AS nw FROM c2),
c4 AS (SELECT *, f1 + coalesce(list_sum(w[1:nw]), 0) + greatest(0, nw - 1) AS f2 FROM c3),
c5 AS (SELECT *, coalesce(list_max(list_filter(range(least(1, len(i)), len(i) + 1), lambda k: f2 + sl + coalesce(list_sum(i[1:k]), 0) + greatest(0, k - 1) <= 1750)), least(1, len(i))) AS ni FROM c4),
c6 AS (SELECT *, f2 + coalesce(list_sum(i[1:ni]), 0) + greatest(0, ni - 1) AS f3 FROM c5),
c7 AS (SELECT *, CASE WHEN f3 + sl > 1750 THEN 1 ELSE len(l) END AS nl FROM c6)
SELECT log_id, CAST(ceil((f3 + list_sum(l[1:nl]) + greatest(0, nl - 1)) / 3.5) AS BIGINT) AS token_count, CAST(na AS INTEGER) AS n_recommendations, CAST(nw AS INTEGER) AS n_warnings, CAST(ni AS INTEGER) AS n_issues, CAST(nl AS INTEGER) AS n_limitations FROM c7""")
def summary_budget(spark, sf):
    return summary.fit_budget(_budget_rows(spark, sf)).drop("summary")


def _summary_items(spark, sf):
    e = table(spark, sf, "events")
    t, i, v = F.col("event_type"), F.col("event_id"), F.col("value")
    kind = F.when(t == "view", "SOQL_EXECUTE_BEGIN").when(t == "click", "DML_BEGIN").when(t == "error", "EXCEPTION_THROWN").otherwise("METHOD_ENTRY")
    severity = F.when(t == "error", F.when(v > 60, "CRITICAL").when(v > 30, "HIGH").otherwise("LOW"))
    return e.select(F.col("user_id").cast("string").alias("log_id"), F.col("ts").cast("timestamp").alias("ts"), i.alias("id"), kind.alias("type"), F.when(t == "purchase", F.concat(F.lit("ns"), (i % 5).cast("string"))).alias("namespace"), severity.alias("severity"), F.concat(F.lit("failed "), F.repeat(F.lit("again "), (i % 12).cast("int"))).alias("title"))


_SESSIONS = """WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 86400000000 THEN 0 ELSE 1 END AS starts FROM events),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS w, 'failed ' || repeat('again ', event_id % 12) AS title FROM e),
i AS (SELECT user_id, w, list(CASE WHEN value > 60 THEN 'C: ' WHEN value > 30 THEN 'H: ' ELSE 'L: ' END || CASE WHEN length(title) <= 60 THEN title ELSE title[1:57] || '...' END ORDER BY event_id)[1:3] AS top FROM g WHERE event_type = 'error' GROUP BY 1, 2)
SELECT CAST(g.user_id AS VARCHAR) AS log_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS events, count(*) FILTER (event_type = 'view') AS queries, count(*) FILTER (event_type = 'click') AS writes, count(*) FILTER (event_type = 'error') AS exceptions,
  count(*) FILTER (event_type = 'error') AS issues, count(*) FILTER (event_type = 'error' AND value > 30) AS urgent, coalesce(array_to_string(list_sort(list(DISTINCT 'ns' || (event_id % 5)) FILTER (event_type = 'purchase')), ','), '') AS namespaces, coalesce(array_to_string(any_value(top), '; '), '') AS top
FROM g LEFT JOIN i ON i.user_id = g.user_id AND i.w = g.w GROUP BY g.user_id, g.w"""


def _joined(df):
    return df.withColumns({"namespaces": F.array_join("namespaces", ","), "top": F.array_join("top", "; ")})


@register(_SESSIONS)
def session_summaries(spark, sf):
    from .streaming.sessions import session_summaries as f

    return _joined(f(_summary_items(spark, sf), "1 day"))


@register(_SESSIONS)
def stream_summaries(spark, sf):
    """The same from a stream that is started anew for each of four arrivals."""
    from .streaming import sessions

    items = _summary_items(spark, sf)
    number = F.least(F.lit(4), 1 + F.floor((F.dayofmonth("ts") - 1) / 7)).cast("int")
    return _joined(sessions.run_in_batches(items, number, 4, "ts", lambda s: sessions.stream_summaries(s, "1 day")))


_PARSED = """WITH e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
l AS (SELECT CAST(user_id AS VARCHAR) AS log_id, k + 1 AS line_number, event_id * 1000 AS t, CASE event_type WHEN 'signup' THEN 'METHOD_ENTRY' WHEN 'purchase' THEN 'METHOD_EXIT' WHEN 'error' THEN 'EXCEPTION_THROWN' WHEN 'click' THEN 'NO_SUCH_TYPE' END AS type, 'A.m' || (event_id % 5) AS seg FROM e),
ev AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_number) AS id FROM l WHERE type <> 'NO_SUCH_TYPE'), kept AS (SELECT * FROM ev WHERE id <= 40),
full_ AS (SELECT log_id, max(id) AS n, max(line_number) AS last FROM kept GROUP BY 1),
ends AS (SELECT log_id, CASE WHEN any_value(f.n) = 40 THEN any_value(f.last) ELSE max(line_number) FILTER (type IS NOT NULL) END AS last, any_value(f.n) AS n FROM l LEFT JOIN full_ f USING (log_id) GROUP BY 1),
types AS (SELECT log_id, list(type || '=' || n ORDER BY type || '=' || n) AS types FROM (SELECT log_id, type, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1)
SELECT log_id, 'event' AS record, id, line_number, type AS event_type, t AS timestamp, '[1],' || seg AS segments, NULL AS said FROM kept
UNION ALL SELECT DISTINCT log_id, 'metadata', NULL, NULL, NULL, NULL, NULL, CASE WHEN CAST(log_id AS BIGINT) % 3 = 0 THEN '{}' ELSE '{"header":"6' || (CAST(log_id AS BIGINT) % 3) || '.0 APEX_CODE,FINE;DB,INFO"}' END FROM l
UNION ALL SELECT log_id, 'complete', NULL, NULL, NULL, NULL, NULL, '{"total_lines":' || coalesce(last, 0) || ',"events":' || coalesce(n, 0) || ',"types":[' || coalesce('"' || array_to_string(types, '","') || '"', '') || ']}' FROM ends LEFT JOIN types USING (log_id)"""


def _log_lines(spark, sf):
    """Events as lines: two of three logs have a header first; views are lines that are no events, clicks events of no known type."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("id"), F.col("event_type").alias("t"), F.col("ts").cast("timestamp").alias("ts"))
    kind = F.when(F.col("t") == "signup", "METHOD_ENTRY").when(F.col("t") == "purchase", "METHOD_EXIT").when(F.col("t") == "error", "EXCEPTION_THROWN").when(F.col("t") == "click", "NO_SUCH_TYPE")
    line = F.when(kind.isNull(), F.lit("just a view")).otherwise(F.format_string("09:00:00.000 (%d)|%s|[1]|A.m%d", F.col("id") * 1000, kind, F.col("id") % 5))
    body = e.select("log_id", "ts", (F.row_number().over(Window.partitionBy("log_id").orderBy("id")) + 1).alias("line_number"), line.alias("value"))
    head = F.when(F.col("log_id") % 3 == 0, "no header").otherwise(F.concat(F.lit("6"), (F.col("log_id") % 3).cast("string"), F.lit(".0 APEX_CODE,FINE;DB,INFO")))
    first = e.groupBy("log_id").agg(F.min("ts").alias("ts")).select("log_id", "ts", F.lit(1).alias("line_number"), head.alias("value"))
    return first.unionByName(body).select(F.col("log_id").cast("string").alias("log_id"), "ts", F.col("line_number").cast("long").alias("line_number"), "value")


@register(_PARSED)
def parse_records(spark, sf):
    from .streaming.sessions import parse_records as f

    return f(_log_lines(spark, sf), 40).withColumn("segments", F.array_join("segments", ","))


@register(_PARSED)
def stream_parse(spark, sf):
    """The same from a stream that is started anew for each of three arrivals; a log's lines lie in all of them."""
    from .streaming import sessions

    lines = _log_lines(spark, sf)
    number = F.least(F.lit(3), 1 + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int")
    out = sessions.run_in_batches(lines, number, 3, "ts", lambda s: sessions.stream_records(s, "20 days", 40))
    return out.withColumn("segments", F.array_join("segments", ","))


_LANES = f"""WITH {_TREE}, r AS (SELECT log_id, id, close_id, type, 'T' || (id % 3) AS name, type = 'signup' AS st, type = 'purchase' AS en FROM tree),
n AS (SELECT log_id, name, min(id) AS first, row_number() OVER (PARTITION BY log_id ORDER BY min(id)) AS lane FROM r WHERE st GROUP BY 1, 2),
m0 AS (SELECT r.*, lane, coalesce(lag(st) OVER (PARTITION BY r.log_id, r.name ORDER BY id), false) AS was FROM r JOIN n ON n.log_id = r.log_id AND n.name = r.name WHERE (st OR en) AND (st OR id > first)),
m AS (SELECT *, CASE WHEN st AND NOT was THEN 1 WHEN en AND was THEN -1 ELSE 0 END AS step FROM m0),
shown AS (SELECT r.*, m.lane AS own, coalesce(m.step, 0) AS step, (SELECT arg_max(o.lane, o.id) FROM m o WHERE o.log_id = r.log_id AND o.st AND o.id < r.id AND (o.close_id IS NULL OR o.close_id >= r.id)) AS outer_ FROM r LEFT JOIN m ON m.log_id = r.log_id AND m.id = r.id WHERE NOT r.en OR m.id IS NOT NULL),
p AS (SELECT log_id, id, coalesce(own, outer_, 0) AS lane, st AS is_start, en AS is_end, CAST(1 + sum(step) OVER (PARTITION BY log_id ORDER BY id ROWS UNBOUNDED PRECEDING) - CASE WHEN en THEN step ELSE 0 END AS BIGINT) AS n_open FROM shown),
q AS (SELECT *, max(lane) OVER (PARTITION BY log_id) AS widest FROM p)"""


def _lanes(spark, sf):
    t = user_tree(spark, sf)
    return lanes.lanes(t, F.when(F.col("type").isin("signup", "purchase"), F.concat(F.lit("T"), (F.col("id") % 3).cast("string"))), F.col("type") == "signup", F.col("type") == "purchase", F.lit(False))


@register(f"{_LANES} SELECT log_id, id, CAST(lane AS INTEGER) AS lane, is_start, is_end, n_open FROM p")
def trigger_lanes(spark, sf):
    return _lanes(spark, sf).withColumn("lane", F.col("lane").cast("int"))


@register(f"""{_LANES} SELECT log_id, id, array_to_string(list_transform(range(0, widest + 1), lambda i: CASE WHEN i = lane THEN CASE WHEN is_start THEN '◉' WHEN is_end THEN '◈' ELSE '●' END WHEN i < n_open THEN CASE WHEN i = lane - 1 AND is_start THEN '/' WHEN i = lane - 1 AND is_end THEN chr(92) ELSE '|' END ELSE ' ' END || ' '), '') || '-- e' || id AS line FROM q""")
def lane_lines(spark, sf):
    sign = lanes.row_sign(F.lit("METHOD_ENTRY"), F.lit(None).cast("long"), F.col("is_start"), F.col("is_end"))
    return lanes.lane_lines(_lanes(spark, sf), sign, F.concat(F.lit("e"), F.col("id").cast("string")))


_WRITES = """WITH w AS (SELECT CASE WHEN event_id = (SELECT max(event_id) // 4 FROM events) THEN 'CLEAR' WHEN event_type = 'purchase' THEN 'DELETE' ELSE 'SET' END AS op, user_id || ':' || (event_id % 3) AS key, props AS value, CASE WHEN value < 40 THEN value END AS expires_at, event_id AS o FROM events),
v AS (SELECT * FROM w WHERE op <> 'CLEAR' AND o > (SELECT max(o) FROM w WHERE op = 'CLEAR')),
d AS (SELECT key, max(o) AS d FROM v WHERE op = 'DELETE' GROUP BY 1),
state AS (SELECT v.key, arg_max(struct_pack(value, expires_at), o) AS l, min(o) AS created_at, max(o) AS updated_at FROM v LEFT JOIN d USING (key) WHERE op = 'SET' AND (d IS NULL OR o > d) GROUP BY 1)"""


def _writes(spark, sf):
    e = table(spark, sf, "events")
    clear = e.agg(F.floor(F.max("event_id") / 4).alias("_c"))  # one row
    e = e.join(F.broadcast(clear))
    op = F.when(F.col("event_id") == F.col("_c"), "CLEAR").when(F.col("event_type") == "purchase", "DELETE").otherwise("SET")
    key = F.concat_ws(":", F.col("user_id"), F.col("event_id") % 3)
    return memory.kv_writes(e, op, key, F.col("props"), F.when(F.col("value") < 40, F.col("value")), F.col("event_id"), F.col("event_id"))


@register(f"{_WRITES} SELECT key, l.value AS value, l.expires_at AS expires_at, created_at, updated_at FROM state")
def kv_state(spark, sf):
    return memory.kv_state(_writes(spark, sf)).drop("order")


@register(f"{_WRITES} SELECT key, l.value AS value, l.expires_at AS expires_at, created_at, updated_at FROM state WHERE l.expires_at IS NULL OR l.expires_at >= 20")
def kv_compacted(spark, sf):
    """The state that is read from the compacted log."""
    return memory.kv_state(memory.kv_compact(_writes(spark, sf), F.lit(20.0))).drop("order")


@register(f"{_WRITES} SELECT count(*) AS total_keys, count(*) FILTER (l.expires_at < 20) AS expired_keys, CAST(sum(strlen(key) + coalesce(strlen(l.value), 0)) AS BIGINT) AS bytes FROM state")
def kv_stats(spark, sf):
    return memory.kv_stats(memory.kv_state(_writes(spark, sf)), F.lit(20.0))


_CLEAN = "text"
for _p, _f in (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "g"), (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "g"), (r"\b[a-zA-Z0-9]{15}([a-zA-Z0-9]{3})?\b", "g"), (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "g"), (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "g"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "g"), (r"""\bsessionId[=:]\s*[''"]?[\w-]+[''"]?""", "gi"), (r"""\b(access_?token|bearer|api_?key)[=:]\s*[''"]?[\w-]+[''"]?""", "gi"),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '[REDACTED]', '{_f}')"


@register(f"SELECT conv_id, turn, {_CLEAN} AS in_struct, role AS key, {_CLEAN} AS in_map, {_CLEAN} AS in_array, length(text) AS size FROM conversations")
def redact_nested(spark, sf):
    """Texts of conversations inside a struct, a map in it, and an array of structs, redacted where they are."""
    c = table(spark, sf, "conversations")
    made = c.select("conv_id", "turn", "role", F.struct(F.struct(F.col("text"), F.length("text").alias("size")).alias("said"), F.create_map("role", "text").alias("by"), F.array(F.struct(F.col("text").alias("t"))).alias("parts")).alias("whole"))
    done = privacy.redact_output(made, ["whole"])
    return done.select("conv_id", "turn", F.col("whole.said.text").alias("in_struct"), F.map_keys("whole.by")[0].alias("key"), F.element_at("whole.by", F.col("role")).alias("in_map"), F.col("whole.parts")[0]["t"].alias("in_array"), F.col("whole.said.size").cast("long").alias("size"))


_EPISODES = """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS owner, event_id AS id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'complete' WHEN 'purchase' THEN 'solution' WHEN 'view' THEN 'note' ELSE 'issue' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'S' || (event_id % 7) ELSE event_type || (event_id % 3) END AS said, ['RESOLVED', 'PARTIALLY_RESOLVED', 'ESCALATED', 'UNKNOWN'][1 + event_id % 4] AS outcome, value FROM events),
s AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 36 * 3600000000 OR lag(kind) OVER w = 'complete' THEN 1 ELSE 0 END AS opens FROM f WINDOW w AS (PARTITION BY owner ORDER BY t, id)),
e AS (SELECT *, sum(opens) OVER (PARTITION BY owner ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS n FROM s),
v AS (SELECT owner, n, kind, said, min((t, id)) AS first FROM e WHERE kind IN ('issue', 'solution') GROUP BY ALL),
l AS (SELECT owner, n, string_agg(said, ',' ORDER BY first) FILTER (kind = 'issue') AS issues, string_agg(said, ',' ORDER BY first) FILTER (kind = 'solution') AS solutions FROM v GROUP BY ALL),
ep AS (SELECT owner, arg_min(id, (t, id)) AS episode_id, min(t) // 1000 AS started_ms, max(t) // 1000 AS last_ms, max(t // 1000) FILTER (kind = 'complete') AS ended_ms, coalesce(any_value(issues), '') AS issues, coalesce(any_value(solutions), '') AS solutions,
  coalesce(any_value(outcome) FILTER (kind = 'complete'), 'UNKNOWN') AS outcome, any_value(value > 50) FILTER (kind = 'complete') AS helpful, CAST(any_value(floor(value / 20)) FILTER (kind = 'complete') AS BIGINT) AS rating FROM e LEFT JOIN l USING (owner, n) GROUP BY owner, n)"""


def _facts(spark, sf):
    """Users debug: clicks and errors are issues, purchases solutions, views only notes, a signup completes."""
    e, t, i = table(spark, sf, "events"), F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "complete").when(t == "purchase", "solution").when(t == "view", "note").otherwise("issue")
    said = F.when(t == "purchase", F.concat(F.lit("S"), (i % 7).cast("string"))).otherwise(F.concat(t, (i % 3).cast("string")))
    outcome = F.get(F.array(*map(F.lit, ("RESOLVED", "PARTIALLY_RESOLVED", "ESCALATED", "NO_SUCH"))), (i % 4).cast("int"))
    return e.select(F.col("user_id").alias("owner"), F.col("ts").cast("timestamp").alias("ts"), i.alias("id"), kind.alias("kind"), said.alias("value"), outcome.alias("outcome"), (F.col("value") > 50).alias("helpful"), F.floor(F.col("value") / 20).alias("rating"))


def _flat(done):
    return done.withColumns({c: F.array_join(c, ",") for c in ("issues", "solutions")})


@register(f"{_EPISODES} SELECT * FROM ep")
def episode_sessions(spark, sf):
    from .streaming import episodes

    return _flat(episodes.episodes(_facts(spark, sf), "36 hours"))


@register(f"{_EPISODES} SELECT * FROM ep")
def stream_episodes(spark, sf):
    """The same from a stream that is started anew for each of four arrivals."""
    from .streaming import episodes, sessions

    number = F.least(F.lit(4), 1 + F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    return _flat(sessions.run_in_batches(_facts(spark, sf), number, 4, "ts", lambda s: episodes.stream_episodes(s, "36 hours")))


@register(f"{_EPISODES} SELECT unnest(string_split(solutions, ',')) AS solution_id, count(*) FILTER (outcome = 'RESOLVED') AS success_count, count(*) FILTER (outcome <> 'RESOLVED') AS failure_count, max(ended_ms) AS last_used_ms FROM ep WHERE outcome IN ('RESOLVED', 'PARTIALLY_RESOLVED') AND solutions <> '' GROUP BY 1")
def episode_solutions(spark, sf):
    from .streaming import episodes

    return episodes.solution_outcomes(episodes.episodes(_facts(spark, sf), "36 hours"))


@register(f"{_EPISODES}, n AS (SELECT epoch_ms(TIMESTAMP '2024-01-30') AS now) SELECT (SELECT count(*) FILTER (o_custkey * 1000000000 < now) FROM orders, n) AS expired_keys, count(*) FILTER (started_ms < now - 20 * 86400000) AS old_episodes, greatest(0, count(*) FILTER (started_ms >= now - 20 * 86400000) - 100) AS extra_episodes FROM ep, n")
def memory_maintenance(spark, sf):
    """What a clean-up would take: orders stand for keys that expire at a time of their customer's."""
    from .streaming import episodes

    keys = table(spark, sf, "orders").select((F.col("o_custkey") * 1000000000).alias("expires_at"))
    now = F.unix_millis(F.lit("2024-01-30").cast("timestamp"))
    return episodes.maintenance(episodes.episodes(_facts(spark, sf), "36 hours"), keys, now, 20, 100)


@register(r"""WITH w AS (SELECT p_partkey AS id, p_brand AS code, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\W+'), lambda x: length(x) > 2))) AS word FROM part),
hit AS (SELECT DISTINCT q.id AS query_id, f.id AS fact_id, q.code AS code, f.code AS other FROM w q JOIN w f USING (word) WHERE q.id % 20 = 0),
said AS (SELECT query_id, count(*) FILTER (code <> other) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS r FROM hit) WHERE r <= 10 GROUP BY 1),
brands AS (SELECT p_brand AS code, count(*) AS n FROM part GROUP BY 1), ep AS (SELECT 'Brand#' || (o_custkey % 30) AS code, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
so AS (SELECT 'Brand#' || (s % 30) AS code, count(*) AS n FROM (SELECT l_suppkey AS s, count(*) FILTER (l_returnflag = 'N') AS good, count(*) AS uses FROM lineitem GROUP BY 1) WHERE uses >= 2 AND good >= 0.5 * uses GROUP BY 1),
a AS (SELECT p_partkey AS query_id, b.n + coalesce(said.n, 0) AS n_facts, least(10, b.n) AS n_matches, least(10, coalesce(ep.n, 0)) AS n_episodes, least(10, coalesce(so.n, 0)) AS n_solutions
  FROM part JOIN brands b ON b.code = p_brand LEFT JOIN said ON said.query_id = p_partkey LEFT JOIN ep ON ep.code = p_brand LEFT JOIN so ON so.code = p_brand WHERE p_partkey % 20 = 0)
SELECT *, least(1, (n_facts + n_matches + n_episodes + n_solutions) / 10.0)::DOUBLE AS confidence FROM a""")
def recall(spark, sf):
    """Every twentieth part asks by its name, brand and type what parts, orders and suppliers remember."""
    none = F.array().cast("array<string>")
    sig = F.struct(F.col("p_brand").alias("issue_type"), F.col("p_type").alias("error_signature"), *[none.alias(c) for c in ("objects", "namespaces", "methods", "queries", "limits")])
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_brand").alias("code"), sig.alias("signature"))
    brand = lambda c: F.concat(F.lit("Brand#"), (c % 30).cast("string"))
    done = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.array(brand(F.col("o_custkey"))).alias("issues"))
    fixes = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("success_count"), F.count_if(F.col("l_returnflag") != "N").alias("failure_count")).withColumn("issue_type", brand(F.col("l_suppkey")))
    asks = p.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return memory.recall_for(asks, p.withColumnRenamed("id", "fact_id").drop("signature"), p.select(F.col("id").alias("entry_id"), "signature"), done, fixes)
