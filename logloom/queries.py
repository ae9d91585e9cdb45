"""Each operator applied to the test tables, with the same result in SQL.

Tables stand in for logs: an event's user is its log, signup opens a call, purchase closes one, error is an
exception; conversations are logs of lines; orders and lineitem are parents and children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.numbers import exact_sum, half_up
from .operators import correlation, detect, memory, namespaces, privacy, query, render, scoring, tree, truncation
from .operators.events import code_unit, value_type
from .schema import SEVERITIES

#: Rows that a task of a query over all lines sorts, about.
ROWS_A_TASK = 500_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("log_id"), F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("duration"), "props")


_E = "e AS (SELECT user_id AS log_id, event_id AS id, event_type AS type, epoch_us(ts) AS t, value AS duration, props FROM events)"
_ENTRY, _EXIT = ("signup",), ("purchase",)
_TREE = f"""{_E}, s AS (SELECT *, CASE type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM e),
s1 AS (SELECT *, sum(d) OVER (PARTITION BY log_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM s),
s2 AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY log_id ORDER BY id ROWS UNBOUNDED PRECEDING)) AS after FROM s1),
s3 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY log_id ORDER BY id), 0) AS depth FROM s2),
t0 AS (SELECT b.log_id, b.id, b.type, b.t, CAST(b.depth AS BIGINT) AS depth, coalesce((SELECT max(p.id) FROM s3 p WHERE p.log_id = b.log_id AND p.d = 1 AND p.after = b.depth AND p.id < b.id), -1) AS parent_id FROM s3 b),
tree AS (SELECT t0.*, x.id AS close_id, CASE WHEN x.t > t0.t THEN x.t - t0.t END AS span FROM t0 LEFT JOIN t0 x ON x.log_id = t0.log_id AND x.type = 'purchase' AND x.parent_id = t0.id)"""


def user_tree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.call_tree(events(spark, sf), _ENTRY, _EXIT, root=-1)


def rounded(c: Column, places: int = 4) -> Column:
    return half_up(c, places)


def nudged(c: Column, places: int = 4) -> Column:
    """Rounded after a nudge upwards, for values that often lie halfway."""
    return half_up(c.cast("double") + 1e-9, places)


# ---- query engine ------------------------------------------------------------------------------------------------


@register("SELECT event_id AS id, user_id AS log_id, value AS duration FROM events WHERE event_type IN ('click', 'error') AND value BETWEEN 10 AND 60 AND user_id <= 100")
def event_filter(spark, sf):
    f = query.EventFilter(types=("click", "error"), min_duration=10, max_duration=60, predicate=F.col("log_id") <= 100)
    return query.query_events(events(spark, sf), f).select("id", "log_id", "duration")


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def text_search(spark, sf):
    return table(spark, sf, "documents").where(query.text_search("License", F.col("text")) | query.text_search("SRC1", F.col("source"))).select("doc_id")


@register("SELECT event_id AS id, value AS duration FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50 OFFSET 50")
def paginate(spark, sf):
    return query.paginate(events(spark, sf), 2, 50, ("duration", True))[0].select("id", "duration")


@register("SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, count(*) > 100 AS has_more FROM events")
def page_totals(spark, sf):
    return query.paginate(events(spark, sf), 2, 50, ("duration", True))[1]


@register("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, sf):
    return query.count_by(events(spark, sf), "type")


@register("SELECT source, min(doc_id) AS first_id FROM documents WHERE source <> '' GROUP BY 1")
def distinct_namespaces(spark, sf):
    return query.first_seen(table(spark, sf, "documents"), "source", "doc_id")


@register("SELECT user_id AS log_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def timeline(spark, sf):
    e = events(spark, sf)
    return e.select("log_id", "id", F.row_number().over(Window.partitionBy("log_id").orderBy("timestamp", "id")).alias("place"))


@register("SELECT event_id AS id, value AS duration FROM events WHERE value >= 90")
def slow_operations(spark, sf):
    return query.slow_operations(events(spark, sf), 90 / 1e6).select("id", "duration")


@register("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def has_children_semi(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(0).alias("log_id"), F.col("o_orderkey").alias("id"))
    li = table(spark, sf, "lineitem").select(F.lit(0).alias("log_id"), F.col("l_orderkey").alias("parent_id"))
    return query.has_children(o, li, True).select(F.col("id").alias("o_orderkey"))


@register("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def leaf_anti(spark, sf):
    c = table(spark, sf, "customer").select(F.lit(0).alias("log_id"), F.col("c_custkey").alias("id"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.lit(0).alias("log_id"), F.col("o_custkey").alias("parent_id"))
    return query.has_children(c, o, False).select(F.col("id").alias("c_custkey"))


@register(f"WITH {_E} SELECT c.id AS centre_id, e.id FROM e JOIN e c ON e.log_id = c.log_id AND abs(e.id - c.id) <= 400 WHERE c.type = 'error'")
def exception_context(spark, sf):
    e = events(spark, sf)
    return query.near_lines(e, e.where("type = 'error'"), 400, line="id").select("centre_id", "id")


# ---- trees and sequences -----------------------------------------------------------------------------------------


@register(f"WITH {_TREE} SELECT log_id, id, CAST(after AS BIGINT) AS depth_after FROM s2")
def clamped_depth(spark, sf):
    return tree.clamped_depth(events(spark, sf), tree.entry_exit_step(_ENTRY, _EXIT)).select("log_id", "id", "depth_after")


@register(f"WITH {_TREE} SELECT log_id, id, parent_id FROM t0")
def call_tree_parent(spark, sf):
    return user_tree(spark, sf).select("log_id", "id", "parent_id")


@register(f"WITH {_TREE} SELECT log_id, id, depth, span AS duration FROM tree WHERE type = 'signup'")
def call_tree_duration(spark, sf):
    return user_tree(spark, sf).where("type = 'signup'").select("log_id", "id", "depth", "duration")


@register(f"WITH {_TREE} SELECT log_id, CAST(max(depth) + 1 AS BIGINT) AS tree_depth FROM t0 GROUP BY 1")
def tree_depth(spark, sf):
    return tree.tree_depth(user_tree(spark, sf)).withColumn("tree_depth", F.col("tree_depth").cast("long"))


@register(f"WITH {_TREE} SELECT * FROM (SELECT log_id, id, span AS duration, row_number() OVER (PARTITION BY log_id ORDER BY span DESC, id) AS place FROM tree WHERE span IS NOT NULL) WHERE place <= 3")
def tree_top_n(spark, sf):
    return render.slowest(user_tree(spark, sf), 3).select("log_id", "id", "duration", "place")


@register(f"""WITH RECURSIVE {_TREE}, up AS (SELECT log_id, id, parent_id AS ancestor_id FROM t0 WHERE type = 'error' AND parent_id >= 0
UNION ALL SELECT u.log_id, u.id, p.parent_id FROM up u JOIN t0 p ON p.log_id = u.log_id AND p.id = u.ancestor_id WHERE p.parent_id >= 0)
SELECT log_id, id, ancestor_id FROM up""")
def ancestors(spark, sf):
    t = user_tree(spark, sf)
    return tree.with_ancestors(t, F.col("type") == "signup").join(t.where("type = 'error'").select("log_id", "id"), ["log_id", "id"], "left_semi").select("log_id", "id", "ancestor_id")


@register(f"""WITH RECURSIVE {_TREE}, down AS (SELECT log_id, id AS root_id, id FROM t0 WHERE depth = 0 AND type = 'signup'
UNION ALL SELECT d.log_id, d.root_id, c.id FROM down d JOIN t0 c ON c.log_id = d.log_id AND c.parent_id = d.id)
SELECT log_id, root_id, count(*) AS n_events FROM down GROUP BY 1, 2""")
def subtree(spark, sf):
    t = user_tree(spark, sf)
    inner = tree.with_ancestors(t, (F.col("type") == "signup") & (F.col("depth") == 0), "root")
    roots = t.where("type = 'signup' and depth = 0").select("log_id", F.col("id").alias("root_id"))
    return roots.join(inner.groupBy("log_id", "root_id").agg(F.count("*").alias("n")), ["log_id", "root_id"], "left").select("log_id", "root_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_events"))


@register(f"""WITH RECURSIVE {_TREE}, down AS (SELECT log_id, id AS root_id, id, span FROM tree WHERE type = 'signup'
UNION ALL SELECT d.log_id, d.root_id, c.id, c.span FROM down d JOIN tree c ON c.log_id = d.log_id AND c.parent_id = d.id)
SELECT log_id, root_id AS id, CAST(coalesce(sum(span), 0) AS BIGINT) AS total FROM down GROUP BY 1, 2""")
def subtree_duration(spark, sf):
    return tree.subtree_duration(user_tree(spark, sf), _ENTRY)


@register("""SELECT log_id, id, from_type, to_type FROM (SELECT user_id AS log_id, event_id AS id, event_type AS to_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_type FROM events)
WHERE from_type IS NOT NULL AND from_type <> to_type""")
def boundary_crossings(spark, sf):
    return tree.boundary_crossings(events(spark, sf), F.col("type")).select("log_id", "id", F.col("from_ns").alias("from_type"), F.col("to_ns").alias("to_type"))


@register("""SELECT l_orderkey, unnest(range(prev + 1, l_linenumber)) AS l_linenumber FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
CAST(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS prev FROM lineitem WHERE l_quantity < 25) WHERE l_linenumber - prev > 1""")
def skipped_lines(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity < 25").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return tree.skipped_lines(li, "l_orderkey", "l_linenumber")


@register("SELECT conv_id, role, count(*) AS n, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS history FROM conversations GROUP BY 1, 2")
def variable_history(spark, sf):
    c = table(spark, sf, "conversations").withColumn("v", F.length("text").cast("string"))
    return tree.variable_history(c, "conv_id", "role", "turn", "v").withColumn("history", F.array_join("history", ","))


@register("""SELECT user_id AS log_id, event_id AS id, CASE event_type WHEN 'click' THEN 'statement' WHEN 'view' THEN 'variable' ELSE 'debug' END AS kind,
CASE event_type WHEN 'click' THEN NULL ELSE props END AS detail FROM events WHERE event_type IN ('click', 'view', 'error')""")
def execution_trace(spark, sf):
    names = F.create_map(*[F.lit(x) for p in (("click", "STATEMENT_EXECUTE"), ("view", "VARIABLE_ASSIGNMENT"), ("error", "USER_DEBUG")) for x in p])
    e = events(spark, sf).select("log_id", "id", F.element_at(names, F.col("type")).alias("type"), "timestamp", F.lit(1).alias("source_line"), F.col("props").alias("variable_name"), F.col("props").alias("message"))
    return tree.execution_trace(e.where("type is not null")).select("log_id", "id", "kind", "detail")


# ---- detectors ---------------------------------------------------------------------------------------------------

_GAPS = """g AS (SELECT user_id AS log_id, event_type AS pattern, event_id AS id, epoch_us(ts) / 1000.0 AS ms FROM events),
g1 AS (SELECT *, ms - lag(ms) OVER (PARTITION BY log_id, pattern ORDER BY ms, id) AS gap FROM g),
g2 AS (SELECT log_id, pattern, count(*) AS n, avg(gap) AS a, min(gap) AS lo, max(gap) AS hi FROM g1 GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _repeats(spark, sf) -> DataFrame:
    return detect.repeated(events(spark, sf), F.col("type"), F.col("timestamp") / 1000.0, rapid_ms=60_000_000.0)


@register(f"WITH {_GAPS} SELECT log_id, pattern, n, round(a, 2) AS avg_gap, round(lo, 2) AS min_gap, round(hi, 2) AS max_gap, a < 60000000 AS rapid FROM g2")
def rapid_fire(spark, sf):
    return _repeats(spark, sf).select("log_id", "pattern", "n", *[rounded(F.col(c), 2).alias(c) for c in ("avg_gap", "min_gap", "max_gap")], "rapid")


@register(f"""WITH {_GAPS} SELECT log_id, pattern, n, round(0.5 + CASE WHEN n >= 10 THEN 0.2 WHEN n >= 5 THEN 0.1 ELSE 0 END + CASE WHEN a < 60000000 THEN 0.2 ELSE 0 END + CASE WHEN hi - lo < 1 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score,
CASE WHEN n >= 20 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g2""")
def repeated_queries(spark, sf):
    return _repeats(spark, sf).select("log_id", "pattern", "n", F.col("score").cast("double").alias("score"), "severity")


@register("SELECT doc_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(source || ' = ''' || lang || ''' and  n = ' || n_chars, '''[^'']*''', '''?''', 'g'), '\\b[0-9]+\\b', '?', 'g'), '\\s+', ' ', 'g'))) AS pattern FROM documents")
def normalize_query(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_query(F.concat("source", F.lit(" = '"), "lang", F.lit("' and  n = "), "n_chars")).alias("pattern"))


@register("SELECT p_partkey, regexp_extract('select x FROM ' || p_brand || ' where a', '(?i)FROM\\s+(\\w+)', 1) || ':W' AS signature FROM part")
def query_signature(spark, sf):
    return table(spark, sf, "part").select("p_partkey", memory.query_signature(F.concat(F.lit("select x FROM "), "p_brand", F.lit(" where a"))).alias("signature"))


@register("SELECT page_id, regexp_replace(regexp_replace(url, '\\b[a-zA-Z0-9]{15,18}\\b', 'ID', 'g'), '[0-9]+', 'N', 'g') AS text FROM pages")
def error_signature(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_error(F.col("url")).alias("text"))


_CALLS = "SELECT user_id AS log_id, event_type AS method, count(*) AS n_calls, sum(value) AS total, max(value) AS longest, avg(value) AS average FROM events GROUP BY 1, 2"


def _stats(spark, sf) -> DataFrame:
    e = events(spark, sf)
    return detect.method_stats(e.select("log_id", "id", F.col("type").alias("method"), F.col("duration").alias("inclusive"), F.col("duration").alias("exclusive")))


@register(f"SELECT log_id, method, n_calls, round(total, 2) AS inclusive, round(longest, 2) AS longest, round(average + 1e-9, 4) AS average FROM ({_CALLS})")
def method_stats(spark, sf):
    return _stats(spark, sf).select("log_id", "method", "n_calls", rounded(F.col("inclusive"), 2).alias("inclusive"), rounded(F.col("longest"), 2).alias("longest"), nudged(F.col("average")).alias("average"))


_HOT = f"""m AS ({_CALLS}), h AS (SELECT *, sum(total) OVER (PARTITION BY log_id) AS all_ms, (SELECT min(event_id) FROM events WHERE user_id = log_id AND event_type = method) AS first_id FROM m),
h1 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY total DESC, first_id) AS place FROM h),
hot AS (SELECT * FROM h1 WHERE place <= 2 AND all_ms >= 50 AND 100 * total / all_ms >= 5 AND total >= 50)"""


def _hot(spark, sf) -> DataFrame:
    return detect.cpu_hotspots(_stats(spark, sf), unit=1.0, top=2)


@register(f"WITH {_HOT} SELECT log_id, method, place, round(total, 2) AS own_ms, round(100 * total / all_ms, 2) AS pct FROM hot")
def cpu_hotspots(spark, sf):
    return _hot(spark, sf).select("log_id", "method", "place", rounded(F.col("own_ms"), 2).alias("own_ms"), rounded(F.col("pct"), 2).alias("pct"))


@register(f"WITH {_HOT} SELECT log_id, method FROM m WHERE (average > 100 * 0.5 OR longest > 500 * 0.5) AND NOT EXISTS (SELECT 1 FROM hot WHERE hot.log_id = m.log_id AND hot.method = m.method)")
def expensive_methods(spark, sf):
    return detect.expensive_methods(_stats(spark, sf), _hot(spark, sf), unit=0.5).select("log_id", "method")


@register("""SELECT log_id, round(ms, 2) AS ms, CASE WHEN ms / 50 >= 90 THEN 'CRITICAL' WHEN ms / 50 >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(least(0.95, 0.5 + ms / 50 / 200), 4) AS confidence
FROM (SELECT user_id AS log_id, sum(value) AS ms FROM events GROUP BY 1) WHERE ms > 1000""")
def cpu_timeout_risk(spark, sf):
    t = events(spark, sf).groupBy("log_id").agg(exact_sum(F.col("duration")).alias("ms")).where("ms > 1000")
    pct = F.col("ms") / 50
    return t.select("log_id", rounded(F.col("ms"), 2).alias("ms"), detect.ladder(pct, (90, "CRITICAL"), (70, "HIGH"), other="MEDIUM").alias("severity"), rounded(F.least(F.lit(0.95), 0.5 + pct / 200)).alias("confidence"))


def _readings(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = F.when(F.col("l_returnflag") == "R", "Number of SOQL queries").when(F.col("l_returnflag") == "A", "Number of DML statements").otherwise("Number of callouts")
    return li.select(F.col("l_suppkey").alias("log_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "O", "open").alias("namespace"), name.alias("limit_name"), (2 * F.col("l_quantity")).cast("long").alias("used"), F.lit(None).cast("long").alias("max"))


_READ = """r AS (SELECT l_suppkey AS log_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'O' THEN 'open' END AS namespace,
CASE l_returnflag WHEN 'R' THEN 'Number of SOQL queries' WHEN 'A' THEN 'Number of DML statements' ELSE 'Number of callouts' END AS limit_name, CAST(2 * l_quantity AS BIGINT) AS used FROM lineitem),
f AS (SELECT log_id, limit_name, count(*) AS n_readings, arg_max(id, (used, -id)) AS id, max(used) AS used FROM r GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN limit_name = 'Number of DML statements' THEN 150 ELSE 100 END AS top FROM f), k AS (SELECT *, 100.0 * used / top AS pct FROM j)"""


@register(f"WITH {_READ} SELECT log_id, limit_name, n_readings, id, used FROM f")
def limit_max_used(spark, sf):
    return detect.max_used(_readings(spark, sf), ["log_id", "limit_name"]).select("log_id", "limit_name", "n_readings", "id", "used")


@register(f"""WITH {_READ} SELECT log_id, limit_name, CASE WHEN pct >= 100 THEN 'CRITICAL' WHEN pct >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
round(CASE WHEN used >= top THEN 1.0 ELSE least(0.95, 0.6 + pct / 200) END, 4)::DOUBLE AS confidence FROM k WHERE pct >= 70""")
def governor_limit_issues(spark, sf):
    judged = detect.judged_limits(detect.max_used(_readings(spark, sf), ["log_id", "limit_name"])).where("severity is not null")
    return judged.select("log_id", "limit_name", "severity", rounded(F.col("confidence")).alias("confidence"))


@register(f"""WITH {_READ} SELECT log_id, namespace, max(CASE WHEN limit_name = 'Number of SOQL queries' THEN used END) AS queries, max(CASE WHEN limit_name = 'Number of DML statements' THEN used END) AS writes, count(*) AS n_readings
FROM r WHERE namespace IS NOT NULL GROUP BY 1, 2""")
def namespace_limit_issues(spark, sf):
    return detect.namespace_use(_readings(spark, sf), ["log_id"])


@register("SELECT l_orderkey, l_linenumber, CASE WHEN p >= 100 THEN 'CRITICAL' WHEN p >= 90 THEN 'HIGH' WHEN p >= 75 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT *, 2 * l_quantity AS p FROM lineitem)")
def limit_severity(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", detect.limit_severity(2 * F.col("l_quantity")).alias("severity"))


@register(f"""WITH {_READ}, s AS (SELECT log_id, CASE WHEN used >= top THEN 'EXCEEDED' WHEN pct >= 90 THEN 'CRITICAL' WHEN pct >= 70 THEN 'WARNING' ELSE 'OK' END AS status FROM k)
SELECT log_id, count(*) FILTER (status = 'EXCEEDED') AS exceeded, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'WARNING') AS warning, count(*) FILTER (status = 'OK') AS ok,
CASE WHEN bool_or(status = 'EXCEEDED') THEN 'EXCEEDED' WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'OK' END AS health FROM s GROUP BY 1""")
def limit_summary(spark, sf):
    return detect.limit_summary(_readings(spark, sf))


_NPLUS = """g AS (SELECT user_id AS log_id, event_type AS object, count(*) AS n, epoch_us(min(ts)) + 86400000000 * 7 AS first_ts, min(event_id) AS group_id FROM events GROUP BY 1, 2),
p AS (SELECT user_id AS log_id, event_id AS parent_id, epoch_us(ts) AS parent_ts, event_type AS parent_object, CAST(floor(value) AS BIGINT) AS parent_rows FROM events)"""


@register(f"""WITH {_NPLUS}, c AS (SELECT g.*, p.parent_id, p.parent_object, p.parent_rows, row_number() OVER (PARTITION BY g.log_id, g.group_id ORDER BY p.parent_ts DESC, p.parent_id DESC) AS rn
FROM g JOIN p ON p.log_id = g.log_id AND p.parent_ts < g.first_ts AND p.parent_object <> g.object AND p.parent_rows > 0 AND g.n::DOUBLE / p.parent_rows BETWEEN 0.8 AND 1.2)
SELECT log_id, group_id, n, parent_id, parent_object, parent_rows, n = parent_rows AS exact FROM c WHERE rn = 1""")
def n_plus_one(spark, sf):
    e = events(spark, sf)
    groups = e.groupBy("log_id", F.col("type").alias("object")).agg(F.count("*").alias("n"), (F.min("timestamp") + 86_400_000_000 * 7).alias("first_ts"), F.min("id").alias("group_id"))
    parents = e.select("log_id", "id", F.col("timestamp").alias("ts"), F.col("type").alias("object"), F.floor("duration").alias("rows"))
    return detect.n_plus_one(groups, parents).select("log_id", "group_id", "n", "parent_id", "parent_object", "parent_rows", "exact")


@register(f"""WITH {_TREE}, d AS (SELECT log_id, type AS unit_name, id, depth, depth > lag(depth) OVER (PARTITION BY log_id, type ORDER BY id) AS nested, parent_id >= 0 AS from_dml FROM t0 WHERE type IN ('click', 'view')),
a AS (SELECT log_id, unit_name, count(*) AS n, max(depth) AS max_depth, coalesce(bool_or(nested), false) AS nested, bool_or(from_dml) AS from_dml FROM d GROUP BY 1, 2)
SELECT log_id, unit_name, n, max_depth, round(least(1.0, 0.5 + CASE WHEN n >= 10 THEN 0.25 WHEN n >= 5 THEN 0.15 ELSE 0 END + CASE WHEN max_depth >= 3 THEN 0.2 ELSE 0 END + CASE WHEN from_dml THEN 0.15 ELSE 0 END), 4)::DOUBLE AS score,
CASE WHEN max_depth >= 5 THEN 'CRITICAL' WHEN max_depth >= 3 OR n >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a WHERE n >= 2 AND (nested OR (n > 3 AND from_dml))""")
def recursive_trigger_direct(spark, sf):
    t = user_tree(spark, sf).where("type in ('click', 'view')")
    starts = t.select("log_id", F.col("type").alias("unit_name"), "id", "depth", (F.col("parent_id") >= 0).alias("from_dml"))
    return detect.direct_recursion(starts).select("log_id", "unit_name", "n", "max_depth", F.col("score").cast("double").alias("score"), "severity")


@register(f"""WITH RECURSIVE {_E}, st AS (SELECT log_id, id, t, duration FROM e WHERE type = 'signup'),
nx AS (SELECT a.log_id, a.id, min(b.id) AS next_id FROM st a JOIN st b ON a.log_id = b.log_id AND b.id > a.id AND floor(b.duration / 20) = floor(a.duration / 20) GROUP BY 1, 2),
ch AS (SELECT log_id, id, id AS at, 1 AS n FROM st UNION ALL SELECT c.log_id, c.id, nx.next_id, c.n + 1 FROM ch c JOIN nx ON nx.log_id = c.log_id AND nx.id = c.at WHERE c.n < 11)
SELECT log_id, id, max(n)::INTEGER AS n FROM ch GROUP BY 1, 2""")
def recursive_trigger_indirect(spark, sf):
    st = events(spark, sf).where("type = 'signup'").select("log_id", "id", F.floor(F.col("duration") / 20).alias("object"))
    w = Window.partitionBy("log_id", "object").orderBy("id")
    steps = st.withColumn("next_id", F.lead("id").over(w)).where("next_id is not null").select("log_id", "id", "next_id")
    return detect.trigger_chains(st, steps).select("log_id", "id", F.size("chain").alias("n"))


_SQLTEXT = "'SELECT a, b FROM ' || source || CASE WHEN doc_id % 2 = 0 THEN ' WHERE lang = ''' || lang || '''' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' LIMIT 5' ELSE '' END"


def _sqltext() -> Column:
    return F.concat(F.lit("SELECT a, b FROM "), "source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" WHERE lang = '"), "lang", F.lit("'"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, " LIMIT 5").otherwise(""))


@register(f"""SELECT doc_id, round(least(0.85, CASE WHEN NOT contains(u, 'WHERE') THEN 0.3 ELSE 0 END + CASE WHEN contains(u, 'WHERE') THEN 0.2 ELSE 0 END + CASE WHEN NOT contains(u, 'WHERE') AND NOT contains(u, 'LIMIT') THEN 0.2 ELSE 0 END), 4)::DOUBLE AS score
FROM (SELECT doc_id, upper({_SQLTEXT}) AS u FROM documents)""")
def soql_heuristics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", detect.query_heuristics(_sqltext()).cast("double").alias("score"))


@register(f"SELECT doc_id, NOT contains(lower(q), 'where') OR regexp_matches(lower(q), 'not\\s+in|!=') AS flag FROM (SELECT doc_id, {_SQLTEXT} AS q FROM documents)")
def soql_non_selective_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", detect.likely_non_selective(_sqltext()).alias("flag"))


@register("""SELECT o_orderkey, CAST((c > 1)::INT + (r > 10000)::INT + (s)::INT AS INTEGER) AS n, CASE WHEN s THEN 'HIGH' WHEN r > 10000 THEN CASE WHEN r > 100000 THEN 'HIGH' ELSE 'MEDIUM' END WHEN c > 1 THEN CASE WHEN c > 2 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity
FROM (SELECT o_orderkey, o_totalprice / 100000 AS c, o_totalprice AS r, o_orderstatus = 'F' AS s FROM orders)""")
def plan_selectivity(spark, sf):
    o = table(spark, sf, "orders")
    n, severity = detect.plan_selectivity(F.col("o_totalprice") / 100000, F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "TableScan").otherwise("Index"))
    return o.select("o_orderkey", n.cast("int").alias("n"), severity.alias("severity"))


@register("SELECT o_orderkey, CASE WHEN n * 10 > 60 THEN 'HIGH' WHEN q >= 200 THEN 'HIGH' WHEN q >= 20 THEN 'MEDIUM' END AS severity FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def row_count_issue(spark, sf):
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return o.select("o_orderkey", detect.row_count_severity(F.col("q") * 50, F.col("n") * 10 * 1000 / 60).alias("severity"))


@register(f"""WITH {_TREE}, c AS (SELECT log_id, parent_id FROM tree WHERE type = 'signup' GROUP BY 1, 2 HAVING count(*) > 1), l AS (SELECT t.log_id, t.id, t.close_id FROM tree t JOIN c USING (log_id, parent_id) WHERE t.type = 'signup')
SELECT DISTINCT t.log_id, t.id FROM tree t JOIN l ON l.log_id = t.log_id AND t.id > l.id AND (l.close_id IS NULL OR t.id <= l.close_id) WHERE t.type = 'error'""")
def soql_in_loops_tree(spark, sf):
    return query.queries_under_looping_methods(_as_methods(spark, sf)).select("log_id", "id")


def _as_methods(spark, sf) -> DataFrame:
    t = user_tree(spark, sf)
    names = F.when(F.col("type") == "signup", "METHOD_ENTRY").when(F.col("type") == "purchase", "METHOD_EXIT").when(F.col("type") == "error", "SOQL_EXECUTE_BEGIN").otherwise(F.col("type"))
    return t.withColumns({"type": names, "class_name": F.lit("A"), "method_name": F.get_json_object("props", "$.k")})


@register(f"""WITH {_TREE}, m AS (SELECT t.log_id, t.id, t.close_id, 'A.' || json_extract_string(e.props, '$.k') AS method FROM tree t JOIN e ON e.log_id = t.log_id AND e.id = t.id WHERE t.type = 'signup'),
o AS (SELECT log_id, method, count(*) AS n_calls FROM m GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT o.log_id, o.method, o.n_calls, CAST(count(DISTINCT q.id) AS INTEGER) AS n_queries, round(least(0.95, 0.5 + n_calls / 20.0), 4)::DOUBLE AS confidence, CASE WHEN n_calls >= 20 THEN 'CRITICAL' WHEN n_calls >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM o JOIN m USING (log_id, method) JOIN tree q ON q.log_id = m.log_id AND q.type = 'error' AND q.id > m.id AND (m.close_id IS NULL OR q.id <= m.close_id) GROUP BY 1, 2, 3""")
def method_loop_soql(spark, sf):
    return detect.method_loop_queries(_as_methods(spark, sf)).select("log_id", "method", "n_calls", "n_queries", rounded(F.col("confidence")).alias("confidence"), "severity")


@register("SELECT l_suppkey, ids, min(o) AS det_seq FROM (SELECT l_suppkey, l_partkey AS o, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS ids FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2")
def dedupe_issues(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("det_seq")).agg(F.collect_list("l_linenumber").alias("event_ids"))
    kept = detect.dedupe_issues(li, key="l_suppkey")
    return kept.select("l_suppkey", F.array_join(F.array_sort(F.transform("event_ids", lambda x: x.cast("string"))), ",").alias("ids"), "det_seq")


# ---- scores and ranks --------------------------------------------------------------------------------------------


def _issues(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), 1 + F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int"))
    return o.select(F.col("o_custkey").alias("log_id"), F.col("o_orderkey").alias("det_seq"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("category"), severity.alias("severity"), ((F.col("o_orderkey") % 3) > 0).alias("can_modify"), F.round(0.5 + (F.col("o_orderkey") % 50) / 100, 2).alias("confidence"), F.lit(None).cast("double").alias("limit_pct"), F.round("o_totalprice").cast("long").alias("occurrences"))


_ISSUES = """i AS (SELECT o_custkey AS log_id, o_orderkey AS det_seq, o_orderstatus AS type, o_orderpriority AS category, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + o_orderkey % 5] AS severity, 1 + o_orderkey % 5 AS rank,
o_orderkey % 3 > 0 AS can_modify, round(0.5 + (o_orderkey % 50) / 100, 2) AS confidence, CAST(round(o_totalprice) AS BIGINT) AS occurrences FROM orders)"""
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in SEVERITIES)
_HEALTH = """k AS (SELECT log_id, round(CASE severity WHEN 'CRITICAL' THEN 25.0 WHEN 'HIGH' THEN 15.0 WHEN 'MEDIUM' THEN 8.0 WHEN 'LOW' THEN 3.0 ELSE 0.0 END * confidence * pow(0.7, row_number() OVER (PARTITION BY log_id, type ORDER BY det_seq) - 1), 9) AS c FROM i),
hs AS (SELECT log_id, CAST(round(greatest(0, least(100, 100 - sum(c)))) AS BIGINT) AS health FROM k GROUP BY 1)"""


@register(f"WITH {_ISSUES}, {_HEALTH} SELECT log_id, health FROM hs")
def health_score(spark, sf):
    return scoring.health_score(_issues(spark, sf))


@register(f"WITH {_ISSUES} SELECT log_id, det_seq, CAST(row_number() OVER (PARTITION BY log_id ORDER BY rank DESC, can_modify DESC, round(confidence, 1) DESC, occurrences DESC, det_seq) AS INTEGER) AS priority FROM i")
def prioritize_issues(spark, sf):
    return scoring.prioritize(_issues(spark, sf)).select("log_id", "det_seq", "priority")


@register(f"WITH {_ISSUES} SELECT log_id, {_COUNTS} FROM i GROUP BY 1")
def issue_counts_by_severity(spark, sf):
    return scoring.counts_by_severity(_issues(spark, sf), ["log_id"])


@register(f"WITH {_ISSUES} SELECT log_id, type, det_seq FROM (SELECT *, row_number() OVER (PARTITION BY log_id, type ORDER BY rank DESC, det_seq) AS rn FROM i) WHERE rn = 1")
def issues_dedupe_type(spark, sf):
    return scoring.dedupe_by_type(_issues(spark, sf)).select("log_id", "type", "det_seq")


@register(f"WITH {_ISSUES} SELECT log_id, round(sum(confidence * rank) / sum(rank) + 1e-9, 4)::DOUBLE AS weighted_confidence FROM i GROUP BY 1")
def weighted_confidence(spark, sf):
    return scoring.weighted_confidence(_issues(spark, sf), ["log_id"]).withColumn("weighted_confidence", nudged(F.col("weighted_confidence")))


@register(f"WITH {_ISSUES} SELECT log_id, det_seq FROM i WHERE rank >= 4 AND can_modify AND confidence >= 0.7 AND type = 'O'")
def issue_filter(spark, sf):
    f = query.IssueFilter(types=("O",), min_severity="HIGH", fixable_only=True, min_confidence=0.7)
    return query.query_issues(_issues(spark, sf), f).select("log_id", "det_seq")


@register(f"""WITH {_ISSUES}, {_HEALTH}, c AS (SELECT log_id, category, count(*) AS n, min(det_seq) AS f FROM i GROUP BY 1, 2), t AS (SELECT log_id, arg_max(category, (n, -f)) AS top FROM c GROUP BY 1),
u AS (SELECT log_id, count(*) FILTER (rank >= 4) AS urgent FROM i GROUP BY 1)
SELECT log_id, concat_ws(' - ', CASE WHEN health >= 80 THEN 'Mostly healthy' WHEN health >= 60 THEN 'Some concerns' WHEN health >= 40 THEN 'Needs attention' ELSE 'Critical issues' END,
CASE WHEN urgent > 0 THEN urgent || ' critical/high priority issue' || CASE WHEN urgent > 1 THEN 's' ELSE '' END END, 'primary: ' || top) AS one_liner FROM hs JOIN t USING (log_id) JOIN u USING (log_id)""")
def issue_one_liner(spark, sf):
    return scoring.summary(_issues(spark, sf)).select("log_id", "one_liner")


@register("""SELECT log_id, round(greatest(0.1, least(1.0, r * CASE WHEN r < 0.7 THEN 0.8 ELSE 1 END * CASE WHEN cut THEN 0.7 ELSE 1 END)) + 1e-9, 4)::DOUBLE AS confidence
FROM (SELECT user_id AS log_id, count(*) FILTER (event_type <> 'view') / count(*)::DOUBLE AS r, bool_or(value > 99) AS cut FROM events GROUP BY 1)""")
def parse_confidence(spark, sf):
    g = events(spark, sf).groupBy("log_id").agg(F.count_if(F.col("type") != "view").alias("p"), F.count("*").alias("t"), F.bool_or(F.col("duration") > 99).alias("cut"))
    return g.select("log_id", nudged(scoring.parse_confidence(F.col("p"), F.col("t"), F.col("cut"))).alias("confidence"))


@register("""SELECT log_id, round(s, 4)::DOUBLE AS confidence, CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.6 THEN 'MEDIUM' WHEN s >= 0.4 THEN 'LOW' ELSE 'VERY_LOW' END AS level
FROM (SELECT user_id AS log_id, round(0.25 * avg(value) / 100 + 0.30 * max(value) / 100 + 0.20 * min(value) / 100 + 0.25, 6) AS s FROM events GROUP BY 1)""")
def confidence_overall(spark, sf):
    g = events(spark, sf).groupBy("log_id").agg(*[(f("duration") / 100).alias(n) for n, f in (("a", F.avg), ("b", F.max), ("c", F.min))])
    score = F.round(scoring.overall_confidence(F.col("a"), F.col("b"), F.col("c"), F.lit(1.0)), 6)
    return g.select("log_id", rounded(score).alias("confidence"), scoring.confidence_level(score).alias("level"))


# ---- correlation -------------------------------------------------------------------------------------------------

_HOUR = 3_600_000


def _pairs(spark, sf, top=None) -> DataFrame:
    e = events(spark, sf).withColumn("ms", F.floor(F.col("timestamp") / 1000))
    left = e.where("type = 'signup'").select("log_id", F.col("id").alias("left_id"), F.col("ms").alias("left_ms"))
    right = e.where("type = 'error'").select("log_id", F.col("id").alias("right_id"), F.col("ms").alias("right_ms"))
    return correlation.interval_join(left, right, ["log_id"], "left_ms", "right_ms", 5 * _HOUR, 60 * _HOUR, top)


_PAIRS = f"""{_E}, pr AS (SELECT l.log_id, l.id AS left_id, r.id AS right_id, CAST(floor(r.t / 1000) - floor(l.t / 1000) AS BIGINT) AS gap_ms FROM e l JOIN e r ON l.log_id = r.log_id AND l.type = 'signup' AND r.type = 'error'
AND floor(r.t / 1000) - floor(l.t / 1000) BETWEEN -{5 * _HOUR} AND {60 * _HOUR})"""


@register(f"WITH {_PAIRS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY log_id, left_id ORDER BY abs(gap_ms), right_id) AS INTEGER) AS place FROM pr) WHERE place <= 2")
def interval_join_topk(spark, sf):
    return _pairs(spark, sf, 2).select("log_id", "left_id", "right_id", "gap_ms", "place")


_EVIDENCE = f"""{_PAIRS}, ev AS (SELECT left_id, right_id, 'TIMING' AS reason, greatest(0.3, 1 - abs(gap_ms) / {60 * _HOUR}.0) AS confidence, 0.60 AS w FROM pr
UNION ALL SELECT left_id, right_id, 'CLASS_NAME', 0.7, 0.70 FROM pr WHERE (left_id + right_id) % 3 = 0),
cc AS (SELECT left_id, right_id, count(*) AS n_reasons, least(1.0, greatest(0.0, sum(confidence * w) / sum(w) + least(0.1, 0.03 * (count(*) - 1)) - CASE WHEN count(*) = 1 THEN 0.15 ELSE 0 END)) AS confidence FROM ev GROUP BY 1, 2)"""


def _evidence(spark, sf) -> DataFrame:
    p = _pairs(spark, sf)
    timing = p.select("left_id", "right_id", F.lit("TIMING").alias("reason"), correlation.timing_confidence(F.col("gap_ms"), 60 * _HOUR).alias("confidence"))
    named = p.where((F.col("left_id") + F.col("right_id")) % 3 == 0).select("left_id", "right_id", F.lit("CLASS_NAME").alias("reason"), F.lit(0.7).alias("confidence"))
    return correlation.combined_confidence(timing.unionByName(named), ["left_id", "right_id"])


@register(f"WITH {_EVIDENCE} SELECT left_id, right_id, n_reasons, round(confidence, 4)::DOUBLE AS confidence FROM cc")
def correlation_confidence(spark, sf):
    return _evidence(spark, sf).select("left_id", "right_id", "n_reasons", rounded(F.col("confidence")).alias("confidence"))


@register(f"""WITH {_EVIDENCE}, kept AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(confidence, 6) DESC, right_id) AS place FROM cc WHERE round(confidence, 6) >= 0.5)
SELECT left_id, right_id, round(round(confidence, 6) + 1e-9, 4)::DOUBLE AS confidence FROM kept WHERE place <= 10
UNION ALL SELECT id, NULL, 0.3 FROM e WHERE type = 'signup' AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.left_id = e.id)""")
def log_correlation(spark, sf):
    c = _evidence(spark, sf).withColumn("confidence", F.round("confidence", 6)).where("confidence >= 0.5")
    kept = memory.top_per_key(c, ["left_id"], [F.desc("confidence"), F.col("right_id")], 10).select("left_id", "right_id", nudged(F.col("confidence")).alias("confidence"))
    lone = events(spark, sf).where("type = 'signup'").select(F.col("id").alias("left_id")).join(kept, "left_id", "left_anti")
    return kept.unionByName(lone.select("left_id", F.lit(None).cast("long").alias("right_id"), F.lit(0.3).alias("confidence")))


@register("""SELECT user_id AS log_id, event_id AS id, (SELECT min(p.event_id) FROM (SELECT event_id FROM ev2 q WHERE q.user_id = x.user_id AND q.rn BETWEEN x.rn - 10 AND x.rn + 9 AND q.event_type = 'error') p) AS nearby
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) x""".replace("ev2 q", "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) q"))
def context_window_first(spark, sf):
    e = events(spark, sf)
    return e.select("log_id", "id", correlation.context_first(e, F.when(F.col("type") == "error", F.col("id"))).alias("nearby"))


@register("""WITH RECURSIVE e AS (SELECT user_id AS u, event_type AS k, epoch_us(ts) AS t, event_id AS id FROM events), kept AS (
SELECT u, k, min((t, id)) AS x FROM e GROUP BY 1, 2
UNION ALL
SELECT e.u, e.k, min((e.t, e.id)) FROM kept JOIN e ON e.u = kept.u AND e.k = kept.k AND e.t - kept.x[1] >= 3600000000 GROUP BY 1, 2)
SELECT x[2] AS id FROM kept""")
def dedupe_within_1ms(spark, sf):
    return correlation.dedupe_near(events(spark, sf), ["log_id", "type"], "timestamp", 3_600_000_000.0).select("id")


@register("SELECT user_id AS log_id, event_id AS id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events")
def split_segments(spark, sf):
    return correlation.segments(events(spark, sf), F.col("type") == "error").select("log_id", "id", "segment")


@register("SELECT user_id AS log_id, 'parent' AS source, event_id AS id FROM events UNION ALL SELECT o_custkey, 'child', o_orderkey FROM orders")
def unified_timeline(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("log_id"), F.col("o_orderkey").alias("id"))
    return correlation.unified_timeline(events(spark, sf).select("log_id", "id"), o)


@register("""SELECT user_id AS log_id, event_id AS id, (SELECT min(event_id) FROM events n WHERE n.user_id = s.user_id AND n.event_id > s.event_id AND n.event_type = 'error' AND n.event_id < coalesce((SELECT min(m.event_id) FROM events m WHERE m.user_id = s.user_id AND m.event_id > s.event_id AND m.event_type = 'signup'), 9223372036854775807)) AS job_event
FROM events s WHERE event_type = 'signup'""")
def extract_async_jobs(spark, sf):
    e = events(spark, sf)
    w = Window.partitionBy("log_id").orderBy("id")
    job = F.sum(F.when(F.col("type") == "signup", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = e.withColumn("job", job).withColumn("job_event", F.first(F.when(F.col("type") == "error", F.col("id")), ignorenulls=True).over(Window.partitionBy("log_id", "job").orderBy("id").rowsBetween(0, Window.unboundedFollowing)))
    return told.where("type = 'signup'").select("log_id", "id", "job_event")


# ---- namespaces --------------------------------------------------------------------------------------------------


@register("SELECT p_partkey, CASE WHEN regexp_matches(n, '^([a-zA-Z0-9]+)__') THEN regexp_extract(n, '^([a-zA-Z0-9]+)__', 1) END AS namespace, regexp_replace(n, '^[a-zA-Z0-9]+__', '') AS bare FROM (SELECT p_partkey, replace(p_brand, '#', '__') AS n FROM part)")
def namespace_prefix(spark, sf):
    n = F.replace("p_brand", F.lit("#"), F.lit("__"))
    return table(spark, sf, "part").select("p_partkey", namespaces.namespace_prefix(n).alias("namespace"), namespaces.strip_namespace(n).alias("bare"))


@register("SELECT lang AS log_id, source AS namespace, min(doc_id) AS first_id, length(source) BETWEEN 2 AND 6 AS is_managed FROM documents GROUP BY 1, 2")
def detect_namespaces(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("log_id"), F.col("doc_id").alias("id"), F.lit("ENTERING_MANAGED_PKG").alias("type"), F.col("source").alias("namespace"), F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("unit_name"))
    return namespaces.detect_namespaces(d).select("log_id", "namespace", "first_id", "is_managed")


@register("SELECT log_id, namespace, n_events, round(time, 2) AS time, round(100 * time / sum(time) OVER (PARTITION BY log_id), 4) AS pct FROM (SELECT user_id AS log_id, event_type AS namespace, count(*) AS n_events, sum(value) AS time FROM events GROUP BY 1, 2)")
def namespace_stats(spark, sf):
    return namespaces.namespace_stats(events(spark, sf), namespace="type").select("log_id", F.col("type").alias("namespace"), "n_events", rounded(F.col("time"), 2).alias("time"), rounded(F.col("pct")).alias("pct"))


@register("""SELECT log_id, CASE WHEN b > 0.5 AND u > 0 AND m > 0 THEN 'BOUNDARY' WHEN m > u AND m > 0.3 THEN 'MANAGED_PACKAGE' WHEN u > m THEN 'USER_CODE' ELSE 'UNKNOWN' END AS attribution
FROM (SELECT user_id AS log_id, sum(CASE WHEN event_type = 'error' THEN 0.9 ELSE 0 END) AS m, sum(CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END) AS u, sum(CASE WHEN event_type = 'signup' THEN 0.85 ELSE 0 END) AS b FROM events GROUP BY 1)""")
def issue_attribution(spark, sf):
    part = lambda t, w: F.sum(F.when(F.col("type") == t, F.lit(w).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)")))
    g = events(spark, sf).groupBy("log_id").agg(part("error", 0.9).alias("m"), part("click", 0.5).alias("u"), part("signup", 0.85).alias("b"))
    return g.select("log_id", namespaces.attribution(F.col("m"), F.col("u"), F.col("b")).alias("attribution"))


@register("SELECT p_partkey, length(p_brand) <= 2 OR regexp_matches(p_brand, '^[a-zA-Z][0-9a-zA-Z]{0,4}$') AS obfuscated FROM part")
def obfuscated_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", namespaces.obfuscated_name(F.col("p_brand")).alias("obfuscated"))


@register(r"""WITH n AS (SELECT DISTINCT p_brand AS ns, split_part(p_type, ' ', 1) AS m FROM part),
c AS (SELECT ns, count(*) AS n, count(*) FILTER (odd) AS obfuscated, count(*) FILTER (NOT odd AND clear) AS readable FROM (SELECT ns, lower(m) NOT IN ('execute', 'run', 'invoke', 'handle', 'process') AND (regexp_matches(m, '^([A-Za-z]|[A-Za-z][0-9A-Za-z]+|__[A-Za-z]+|[A-Za-z]+_\d+)$')
  OR (length(m) <= 2 AND lower(m) NOT IN ('do', 'go', 'is', 'on'))) AS odd, regexp_matches(m, '^[a-z][a-zA-Z0-9]*$') AS clear FROM n) GROUP BY 1),
p AS (SELECT *, CASE WHEN obfuscated * 2 > n THEN 0.8 ELSE 0 END + CASE WHEN length(ns) <= 4 THEN 0.4 ELSE 0 END AS pr, CASE WHEN readable * 2 > n AND obfuscated * 2 <= n THEN 0.7 ELSE 0 END + CASE WHEN length(ns) > 8 THEN 0.15 WHEN length(ns) > 4 THEN 0.1 ELSE 0 END AS pu FROM c)
SELECT ns AS namespace, n, obfuscated, readable, CASE WHEN pr > pu AND pr > 0.5 THEN 'PRIVATE' WHEN pu > pr AND pu > 0.5 THEN 'PUBLIC' ELSE 'UNKNOWN' END AS visibility FROM p""")
def visibility(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("namespace"), F.split("p_type", " ")[0].alias("method_name"))
    return namespaces.visibility(p, order="p_partkey").select("namespace", "n", "obfuscated", "readable", "visibility")


# ---- privacy -----------------------------------------------------------------------------------------------------

_EMAIL, _IP = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
_SSN, _CARD = r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"


@register(f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS n_email, len(regexp_extract_all(text, '{_IP}')) AS n_ip, len(regexp_extract_all(text, '{_SSN}')) AS n_ssn, len(regexp_extract_all(text, '{_CARD}')) AS n_card FROM documents")
def pii_counts(spark, sf):
    kinds = (("n_email", "email"), ("n_ip", "ip_address"), ("n_ssn", "ssn"), ("n_card", "credit_card"))
    return table(spark, sf, "documents").select("doc_id", *[privacy.pii_count(F.col("text"), k).alias(n) for n, k in kinds])


@register(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS digest FROM documents")
def redact_email(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(privacy.redact(F.col("text"), privacy.Policy(names=("email",)))).alias("digest"))


@register(f"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_SSN}', '[SSN]', 'g'), '{_CARD}', '[CREDIT_CARD]', 'g'), '{_IP}', '[IP]', 'g') AS text FROM conversations")
def redact_all(spark, sf):
    policy = privacy.Policy(names=("email", "ssn", "credit_card", "ip_address"))
    return table(spark, sf, "conversations").select("conv_id", "turn", privacy.redact(F.col("text"), policy).alias("text"))


@register(r"SELECT doc_id, (contains(text, '@') AND regexp_matches(text, '\.\w{2,}')) OR regexp_matches(text, '\d{3}[-.\s]?\d{3}[-.\s]?\d{4}') OR regexp_matches(text, '\d{4}[-\s]?\d{4}') OR regexp_matches(text, '(?i)password|secret|token|api.?key') AS likely FROM documents")
def likely_pii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.likely_pii(F.col("text")).alias("likely"))


@register("""SELECT name, CASE WHEN regexp_matches(name, '(?i)password|passwd|pwd|secret|ssn|social.?security|credit.?card|card.?number|ccn|api.?key|access.?token|bearer|session.?id|session.?token') THEN 'CRITICAL'
WHEN regexp_matches(name, '(?i)email|e-mail|phone|mobile|cell|fax|address|street|city|zip|postal|birth.?date|dob|date.?of.?birth') THEN 'HIGH'
WHEN regexp_matches(name, '(?i)name|ip.?address|client.?ip') THEN 'MEDIUM' WHEN regexp_matches(name, '(?i)id$') THEN 'LOW' ELSE 'NONE' END AS sensitivity FROM (SELECT c_name || '_' || lower(c_mktsegment) AS name FROM customer UNION ALL SELECT p_type || '_id' FROM part)""")
def field_sensitivity(spark, sf):
    names = table(spark, sf, "customer").select(F.concat_ws("_", "c_name", F.lower("c_mktsegment")).alias("name")).unionByName(table(spark, sf, "part").select(F.concat(F.col("p_type"), F.lit("_id")).alias("name")))
    return names.select("name", privacy.field_sensitivity(F.col("name")).alias("sensitivity"))


@register("""SELECT p_partkey, CAST(list_reduce(list_prepend(0::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(p_name, '')]), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS BIGINT) AS hash FROM part""")
def hash31(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.hash31(F.col("p_name")).alias("hash"))


# ---- memory ------------------------------------------------------------------------------------------------------


@register("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\W+'), lambda w: length(w) > 2))), ' ') AS words FROM part")
def extract_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(T.keywords(F.col("p_name"))), " ").alias("words"))


@register("SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\W+')), ['the', 'license', 'apache', 'token'])) AS INTEGER) AS hits FROM documents WHERE len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\W+')), ['the', 'license', 'apache', 'token'])) > 0")
def keyword_search(spark, sf):
    return memory.keyword_search(table(spark, sf, "documents"), ["the", "license", "apache", "token"], "doc_id", F.col("text"))


@register("""WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS types, list_distinct(list(json_extract_string(props, '$.k'))) AS ks FROM events GROUP BY 1)
SELECT a.user_id AS a, b.user_id AS b, round(len(list_intersect(a.ks, b.ks)) / len(list_distinct(list_concat(a.ks, b.ks)))::DOUBLE, 4) AS score FROM s a JOIN s b ON b.user_id = a.user_id + 1""")
def jaccard(spark, sf):
    s = events(spark, sf).groupBy("log_id").agg(F.collect_set(F.get_json_object("props", "$.k")).alias("ks"))
    b = s.select((F.col("log_id") - 1).alias("log_id"), F.col("ks").alias("other"))
    return s.join(b, "log_id").select(F.col("log_id").alias("a"), (F.col("log_id") + 1).alias("b"), rounded(T.jaccard(F.col("ks"), F.col("other"))).alias("score"))


_SIG = "sg AS (SELECT p_partkey AS id, p_brand AS kind, p_type AS ptype, p_size AS size FROM part)"


@register(f"""WITH {_SIG}, c AS (SELECT q.id AS query_id, s.id AS entry_id, round((0.25 * (q.kind = s.kind)::INT + 0.15 * (q.ptype = s.ptype)::INT + 0.10 * (q.size = s.size)::INT + 0.35) / 0.85, 6)::DOUBLE AS score
FROM sg q JOIN sg s ON (q.kind = s.kind OR q.ptype = s.ptype) AND q.id % 20 = 0)
SELECT query_id, entry_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS place FROM c WHERE score >= 0.3) WHERE place <= 10""")
def semantic_topk(spark, sf):
    none = F.array().cast("array<string>")
    sig = F.struct(F.col("p_brand").alias("issue_type"), F.lit(None).cast("int").alias("error_signature"), F.array("p_type").alias("objects"), F.array(F.col("p_size").cast("string")).alias("namespaces"), none.alias("methods"), none.alias("queries"), none.alias("limits"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), sig.alias("signature"))
    return memory.find_similar(p.where("entry_id % 20 = 0").withColumnRenamed("entry_id", "query_id"), p)


@register("SELECT a.p_partkey, levenshtein(a.p_type, b.p_type) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1".replace("levenshtein(a.p_type, b.p_type)", "CAST(levenshtein(a.p_type, b.p_type) AS INTEGER)"))
def levenshtein(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", F.levenshtein("p_type", "other").alias("distance"))


@register("SELECT s AS id, uses, round(success_count / uses::DOUBLE, 4) AS success_rate FROM (SELECT l_suppkey AS s, count(*) FILTER (l_returnflag <> 'R') AS success_count, count(*) AS uses FROM lineitem GROUP BY 1) WHERE uses >= 3")
def top_solutions(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") != "R").alias("success_count"), F.count_if(F.col("l_returnflag") == "R").alias("failure_count"))
    return memory.solution_ranking(s).select("id", "uses", rounded(F.col("success_rate")).alias("success_rate"))


@register("SELECT o_orderkey, min(o_orderkey) OVER g AS first_id, count(*) OVER g AS n FROM orders WINDOW g AS (PARTITION BY o_custkey, o_orderpriority)")
def similar_episodes(spark, sf):
    return memory.similar_episodes(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@register("""WITH r AS (SELECT user_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, any_value(n) AS n, round(0.5 * pow(0.7, any_value(n)) + sum(ok::INT * 0.3 * pow(0.7, back)), 4)::DOUBLE AS success_rate FROM r GROUP BY 1""")
def ema_success(spark, sf):
    return memory.ema(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50).withColumn("success_rate", rounded(F.col("success_rate")))


@register("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY ORDER BY ts DESC, event_id LIMIT 100")
def retention_filter(spark, sf):
    return memory.retain(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.lit("2024-01-20").cast("timestamp"), 10, 100, "event_id").select("event_id")


@register("SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10")
def last_n_per_key(spark, sf):
    return memory.top_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "place")


@register("SELECT k AS key, max_by(event_id, (ts, event_id)) AS event_id FROM (SELECT *, user_id || ':' || event_type AS k FROM events) GROUP BY 1")
def kv_latest(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return memory.latest(e, "key", [F.desc("ts"), F.desc("event_id")]).select("key", "event_id")


@register("SELECT event_id FROM events WHERE value IS NULL OR value > 60")
def kv_expired(spark, sf):
    return memory.live(table(spark, sf, "events").withColumn("expires_at", F.col("value")), F.lit(60.0)).select("event_id")


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '_-HI%'")
def kv_keys(spark, sf):
    return memory.keys_like(table(spark, sf, "orders"), "?-HI*", "o_orderpriority").select("o_orderkey")


@register("SELECT o_orderstatus AS outcome, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def outcome_distribution(spark, sf):
    return memory.outcomes(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice").withColumn("mean", rounded(F.col("mean"), 2))


# ---- truncation and levels ---------------------------------------------------------------------------------------

_CUT = r"regexp_matches(t, '\|[^|]+$') OR regexp_matches(t, '\[[^\]]*$') OR regexp_matches(t, '[a-zA-Z]$')"


@register(f"SELECT conv_id, contains(string_agg(text, chr(10) ORDER BY turn), '*** Skipped') AS marker, count(*) > 5 AS long, length(arg_max(text, turn)) > 0 AND ({_CUT.replace('(t,', '(arg_max(text, turn),')}) AS cut FROM conversations GROUP BY 1")
def truncation_indicators(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"), F.count("*").alias("n"), F.max_by("text", "turn").alias("last"))
    return c.select("conv_id", F.contains("content", F.lit("*** Skipped")).alias("marker"), (F.col("n") > 5).alias("long"), truncation.mid_line_cut(F.col("last")).alias("cut"))


_FOUND = "SELECT user_id AS log_id, 100000 AS size, bool_or(event_type = 'error') AS a, bool_or(value > 99.5) AS b, count(*) > 70 AS c FROM events GROUP BY 1"


@register(f"""SELECT log_id, CAST(a::INT + b::INT + c::INT AS INTEGER) AS n_found, CASE WHEN NOT (a OR b OR c) THEN 'NONE' WHEN b THEN 'CRITICAL' WHEN c AND a::INT + b::INT + c::INT >= 3 THEN 'SEVERE' WHEN a::INT + b::INT + c::INT >= 2 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
CASE WHEN NOT (a OR b OR c) THEN 0.95 WHEN a::INT + b::INT + c::INT >= 3 THEN 0.9 WHEN a::INT + b::INT + c::INT = 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM ({_FOUND})""")
def truncation_severity(spark, sf):
    g = events(spark, sf).groupBy("log_id").agg(F.bool_or(F.col("type") == "error").alias("ABRUPT_ENDING"), F.bool_or(F.col("duration") > 99.5).alias("MID_LINE_CUT"), (F.count("*") > 70).alias("UNCLOSED_EVENTS"))
    g = g.select("log_id", F.lit(100000).alias("size"), *[F.col(n) if n in ("ABRUPT_ENDING", "MID_LINE_CUT", "UNCLOSED_EVENTS") else F.lit(False).alias(n) for n in truncation.INDICATORS])
    return truncation.judge(g).select("log_id", "n_found", F.col("truncation_severity").alias("severity"), F.col("truncation_confidence").cast("double").alias("confidence"))


@register(f"WITH {_TREE} SELECT log_id, max(id) FILTER (span IS NOT NULL) AS last_complete, bool_or(type = 'purchase') AS ended FROM tree GROUP BY 1")
def truncation_light(spark, sf):
    return truncation.light(user_tree(spark, sf), _EXIT)


_MAP = "(VALUES ('click', 'Code', 'FINE', 5), ('view', 'Code', 'DEBUG', 4), ('error', 'System', 'ERROR', 1), ('signup', 'Database', 'INFO', 3), ('purchase', 'Database', 'FINEST', 7)) AS m(type, category, level, level_rank)"


def _mapping(spark) -> DataFrame:
    return spark.createDataFrame([("click", "Code", "FINE", 5), ("view", "Code", "DEBUG", 4), ("error", "System", "ERROR", 1), ("signup", "Database", "INFO", 3), ("purchase", "Database", "FINEST", 7)], "type string, category string, level string, level_rank int")


@register(f"SELECT user_id AS log_id, category, arg_max(level, level_rank) AS level, max(level_rank) AS level_rank, count(*) AS evidence FROM events JOIN {_MAP} ON m.type = event_type GROUP BY 1, 2")
def infer_levels(spark, sf):
    return truncation.infer_levels(events(spark, sf), _mapping(spark))


@register("SELECT u.log_id, n.detector, n.type FROM (SELECT DISTINCT user_id AS log_id FROM events WHERE value > 80) u, (VALUES ('d1', 'error'), ('d1', 'signup'), ('d2', 'purchase')) AS n(detector, type) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.log_id AND e.event_type = n.type AND e.value > 80)")
def missing_event_types(spark, sf):
    needs = [("d1", "error"), ("d1", "signup"), ("d2", "purchase")]
    return truncation.missing_types(events(spark, sf).where("duration > 80"), needs)


_HAVE = f"lv AS (SELECT user_id AS log_id, coalesce(max(level_rank) FILTER (category = 'Code'), -8) AS code, coalesce(max(level_rank) FILTER (category = 'System'), -8) AS sys, coalesce(max(level_rank) FILTER (category = 'Database'), -8) AS db FROM events JOIN {_MAP} ON m.type = event_type GROUP BY 1)"
_SHORTS = [("1 - code", "3 - sys"), ("3 - db",), ("3 - db",), ("5 - db",), ("5 - code", "13"), ("4 - code",), ("6 - code",), ("7 - code",), ("6 - sys",), ("11",), ("11",), ("11",)]


@register(f"WITH {_HAVE} SELECT log_id, round(({' + '.join(f'CASE WHEN greatest({", ".join(s)}) <= 0 THEN 100 WHEN least({", ".join(s)}) <= 1 THEN 50 ELSE 0 END' for s in _SHORTS)}) / 12.0, 4)::DOUBLE AS capability_score FROM lv")
def capability_score(spark, sf):
    m = _mapping(spark).withColumn("category", F.when(F.col("category") == "Code", "Apex_code").otherwise(F.col("category")))
    caps = truncation.capabilities(truncation.infer_levels(events(spark, sf), m))
    return truncation.capability_score(caps).withColumn("capability_score", rounded(F.col("capability_score")))


@register(f"WITH {_ISSUES} SELECT log_id, CAST(greatest(0, least(100, 90 - 20 * count(*) FILTER (rank = 5) - 10 * count(*) FILTER (rank = 4) - 2 * count(*) FILTER (rank = 1))) AS DOUBLE) AS reliability FROM i GROUP BY 1")
def reliability_score(spark, sf):
    c = scoring.counts_by_severity(_issues(spark, sf), ["log_id"])
    return c.select("log_id", truncation.reliability(F.lit(90.0), F.col("critical"), F.col("high"), F.col("info")).alias("reliability"))


_PRESET_ROWS = "(VALUES " + ", ".join(f"('{p}', '{c}', '{v}', {['NONE', 'ERROR', 'WARN', 'INFO', 'DEBUG', 'FINE', 'FINER', 'FINEST'].index(v)})" for p, levels in truncation.PRESETS.items() for c, v in zip(truncation.PRESET_CATEGORIES, levels)) + ") AS pr(preset, category, level, r)"


#: Two events next to each other are a log; each asks for the preset that its id picks, in the order of names.
_ASKED = f"p AS (SELECT *, dense_rank() OVER (ORDER BY preset) - 1 AS nr FROM {_PRESET_ROWS}), w AS (SELECT event_id // 2 AS log_id, category, arg_max(level, r) AS level, max(r) AS level_rank FROM events JOIN p ON nr = (event_id * 7 + user_id) % 11 GROUP BY 1, 2)"


def _asked(spark, sf):
    names = F.array(*map(F.lit, sorted(truncation.PRESETS)))
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("log_id"), F.element_at(names, ((F.col("event_id") * 7 + F.col("user_id")) % 11 + 1).cast("int")).alias("preset"))
    return truncation.merge_presets(e.join(F.broadcast(truncation.presets(spark)), "preset"), ("log_id",))


@register(f"WITH {_ASKED} SELECT log_id, category, level, level_rank FROM w")
def preset_merge(spark, sf):
    return _asked(spark, sf)


@register(f"""WITH {_ASKED} SELECT log_id, round(p, 4)::DOUBLE AS points, CASE WHEN p < 30 THEN 'small' WHEN p < 60 THEN 'medium' ELSE 'large' END AS size FROM (SELECT log_id, sum(level_rank * CASE WHEN category = 'Apex_code' THEN 3 WHEN category IN ('Database', 'Apex_profiling') THEN 2 ELSE 1 END) / 98.0 * 100 AS p FROM w GROUP BY 1)""")
def preset_size(spark, sf):
    return truncation.preset_size(_asked(spark, sf), "log_id").withColumn("points", rounded(F.col("points")))


# ---- scans, projections, rendering -------------------------------------------------------------------------------


@register("SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_number, length(unnest(l)) AS n_chars FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)".replace("length(unnest(l)) AS n_chars", "CAST(length(unnest(l)) AS INTEGER) AS n_chars"))
def tokenize_lines(spark, sf):
    from .sources.logs import log_lines

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("content"))
    return log_lines(d).select(F.col("log_id").alias("doc_id"), "line_number", F.length("value").alias("n_chars"))


@register("SELECT event_id AS id, 'USER_DEBUG' AS event_type, event_id * 1000 AS timestamp, CAST(3 AS INTEGER) AS n_segments, event_type AS last_segment FROM events")
def tokenize_events(spark, sf):
    line = F.format_string("09:00:00.000 (%d)|USER_DEBUG|[1]||DEBUG|%s", F.col("id") * 1000, F.col("type"))
    t = events(spark, sf).select("id", T.tokenize_line(line).alias("t"))
    return t.select("id", "t.event_type", "t.timestamp", F.size("t.segments").alias("n_segments"), F.element_at("t.segments", -1).alias("last_segment"))


@register("SELECT 'user:' || user_id AS log_id, 'event' AS record, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'order:' || o_custkey, 'issue', count(*) FROM orders GROUP BY 1")
def jsonl_union(spark, sf):
    from .sources.sinks import json_lines

    e = events(spark, sf).select(F.concat(F.lit("user:"), "log_id").alias("log_id"), "id", "type")
    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), "o_custkey").alias("log_id"), F.col("o_orderkey").alias("det_seq"))
    lines = json_lines({"event": e, "issue": o})
    return lines.groupBy("log_id", F.get_json_object("line", "$.recordType").alias("record")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@register("SELECT event_id AS id, CASE WHEN ns < 1e6 THEN printf('%.0fµs', ns / 1000.0) WHEN ns < 1e9 THEN printf('%.2fms', ns / 1e6) ELSE printf('%.2fs', ns / 1e9) END AS text FROM (SELECT event_id, CAST(floor(value) AS BIGINT) * 20000000 + event_id * 10000 + 1 AS ns FROM events)")
def format_duration(spark, sf):
    ns = F.floor("duration") * 20_000_000 + F.col("id") * 10_000 + 1
    return events(spark, sf).select("id", T.format_duration(ns).alias("text"))


@register(f"WITH {_TREE} SELECT log_id, id, repeat('  ', CAST(depth AS INTEGER)) || type AS line FROM t0")
def tree_lines(spark, sf):
    t = user_tree(spark, sf).withColumn("duration", F.lit(None).cast("double"))
    return render.tree_lines(t, F.col("type"))


@register("""WITH u AS (SELECT o_custkey AS log_id, l_orderkey AS det_seq, l_linenumber AS id, min(l_returnflag) AS type, min(l_suppkey) AS line_number FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
SELECT log_id, det_seq, string_agg(type || ' @' || line_number, ' -> ' ORDER BY id) AS timeline FROM (SELECT *, row_number() OVER (PARTITION BY log_id, det_seq ORDER BY id) AS rn FROM u) WHERE rn <= 5 GROUP BY 1, 2""")
def problem_context(spark, sf):
    lines = table(spark, sf, "lineitem")
    parts = 1 + lines.count() // ROWS_A_TASK
    li = lines.repartition(parts, "l_orderkey").join(table(spark, sf, "orders").repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = li.groupBy(F.col("o_custkey").alias("log_id"), F.col("o_orderkey").alias("det_seq"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("type"), F.min("l_suppkey").alias("line_number"))
    ids = e.withColumn("id", F.col("det_seq") * 10 + F.col("n"))
    issues = ids.groupBy("log_id", "det_seq").agg(F.sort_array(F.collect_list("id")).alias("event_ids"))
    return render.problem_context(issues, ids, parts=parts)


_UNITS = "CASE doc_id % 5 WHEN 0 THEN 'T' || doc_id || ' on ' || source WHEN 1 THEN 'Validation:' || source WHEN 2 THEN 'Workflow:' || source WHEN 3 THEN 'Flow:' || source ELSE source END"


@register(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Trigger' WHEN 1 THEN 'Validation' WHEN 2 THEN 'Workflow' WHEN 3 THEN 'Flow' END AS unit_type, CASE doc_id % 5 WHEN 0 THEN 'T' || doc_id ELSE {_UNITS} END AS unit_name, CASE doc_id % 5 WHEN 0 THEN source END AS trigger_object FROM documents""")
def code_unit_classify(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id") % 5
    text = F.when(n == 0, F.concat(F.lit("T"), "doc_id", F.lit(" on "), "source")).when(n == 1, F.concat(F.lit("Validation:"), "source")).when(n == 2, F.concat(F.lit("Workflow:"), "source")).when(n == 3, F.concat(F.lit("Flow:"), "source")).otherwise(F.col("source"))
    parts = code_unit(F.col("u"))
    return d.select("doc_id", text.alias("u")).select("doc_id", *[parts[c].alias(c) for c in ("unit_type", "unit_name", "trigger_object")])


@register("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Object' WHEN 'view' THEN 'Decimal' WHEN 'error' THEN 'null' WHEN 'signup' THEN 'Boolean' ELSE 'Integer' END AS value_type FROM events")
def infer_value_type(spark, sf):
    raw = F.when(F.col("type") == "click", F.col("props")).when(F.col("type") == "view", F.format_string("%.2f", "duration")).when(F.col("type") == "error", "null").when(F.col("type") == "signup", "true").otherwise(F.col("id").cast("string"))
    return events(spark, sf).select("id", value_type(raw).alias("value_type"))


@register("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)th[ae]n|der')")
def debug_grep(spark, sf):
    c = table(spark, sf, "conversations").withColumn("type", F.lit("USER_DEBUG"))
    return query.debug_messages(c, "th[ae]n|der", message="text").select("conv_id", "turn")


_FACTS = {"click": "INPUT", "error": "FAULT", "view": "READ"}


@register("SELECT event_id AS id, coalesce(d.category, 'UNKNOWN') AS category FROM events LEFT JOIN (VALUES ('click', 'INPUT'), ('error', 'FAULT'), ('view', 'READ')) AS d(type, category) ON d.type = event_type")
def exception_dict(spark, sf):
    facts = spark.createDataFrame(list(_FACTS.items()), "type string, category string")
    return events(spark, sf).join(F.broadcast(facts), "type", "left").select("id", F.coalesce("category", F.lit("UNKNOWN")).alias("category"))


@register("SELECT page_id, name FROM pages, (VALUES ('german', '/de/'), ('anchor', '#top$'), ('second', 'page=2')) AS p(name, pattern) WHERE regexp_matches(url, pattern)")
def error_pattern_match(spark, sf):
    return memory.matching_patterns(table(spark, sf, "pages"), {"german": "/de/", "anchor": "#top$", "second": "page=2"}, F.col("url"), "page_id")


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000.01 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def log_catalog_filter(spark, sf):
    return query.catalogue(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 25, o_orderstatus="F", o_totalprice__min=50000.01).select("o_orderkey")


# ---- streams -----------------------------------------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf}/")


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_summary(spark, sf):
    from .streaming.logs import run_to_memory, running_counts

    return run_to_memory(running_counts(_event_stream(spark, sf), ["event_type"]), "stream_summary", "complete")


@register("SELECT event_id FROM events")
def stream_watch(spark, sf):
    from .streaming.logs import run_to_files, watch

    s = _event_stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_files(watch(s, "ts", "event_id", "60 days"), "stream_watch").select("event_id")


def entry(spark: SparkSession, sf: str = "/root/testdata/sf0.001") -> DataFrame:
    """Health of every user's log: scan, score, summarize."""
    return health_score(spark, sf)


from . import level_queries, log_queries, rule_queries  # noqa: E402, F401  (add their queries to QUERIES and SQL)
