"""Rules and projections over the given tables, dealt so that each of their branches is reached, with the same result in SQL.

An event takes one of a rule's cases by its id (`Inline.dealt`, `Inline.logged`); a log is a user's events. Rules over several tables get them from groups of consecutive
events, each with its own times and names (`Inline.grouped`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import correlation, detect, exceptions, memory, namespaces, privacy, query, scoring, tree, truncation
from .plans.analyze import parse_logs
from .queries import register, rounded, table
from .schema import DEBUG_LEVELS


class Inline:
    """A small table: as a DataFrame, and as a common table expression."""

    def __init__(self, name: str, ddl: str, rows: list[tuple]):
        self.name, self.ddl, self.rows = name, ddl, rows

    def df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl).coalesce(1)

    def dealt(self, spark, sf) -> DataFrame:
        """Each event with one of the rows, by its id; `{i}` in a text is the id."""
        case = F.broadcast(spark.createDataFrame([(n, *r) for n, r in enumerate(self.rows)], f"_case int, {self.ddl}"))
        e = table(spark, sf, "events").select("event_id", (F.col("event_id") % len(self.rows)).cast("int").alias("_case")).join(case, "_case").drop("_case")
        texts = {n: F.replace(F.col(n), F.lit("{i}"), F.col("event_id").cast("string")) for n, k in (c.split() for c in self.ddl.split(", ")) if k == "string"}
        return e.withColumns(texts) if texts else e

    @property
    def dealt_sql(self) -> str:
        columns = [c.split() for c in self.ddl.split(", ")]
        picked = ", ".join(f"replace(c.{n}, '{{i}}', CAST(event_id AS VARCHAR)) AS {n}" if k == "string" else f"c.{n}" for n, k in columns)
        cases = Inline("_r", f"_case int, {self.ddl}", [(n, *r) for n, r in enumerate(self.rows)]).sql
        return f"{cases}, {self.name} AS (SELECT event_id, {picked} FROM events JOIN _r c ON c._case = event_id % {len(self.rows)})"

    def _places(self, log: str) -> dict[str, str]:
        """The columns that say where a row is: its log, and its place there by the event's id."""
        return {n: log if n == "log_id" else "event_id" for n in (c.split()[0] for c in self.ddl.split(", ")) if n in ("log_id", "id", "det_seq", "timestamp", "line_number")}

    def logged(self, spark, sf, log: str = "user_id") -> DataFrame:
        """`dealt`, as rows of logs: a log for each user, or for each event."""
        names = [c.split()[0] for c in self.ddl.split(", ")]
        kinds = dict(c.split() for c in self.ddl.split(", "))
        e = self.dealt(spark, sf)
        if log != "event_id":
            e = e.join(table(spark, sf, "events").select("event_id", log), "event_id")
        places = self._places(log)
        return e.select(*[F.col(places.get(n, n)).cast(kinds[n]).alias(n) for n in names])

    def logged_sql(self, log: str = "user_id") -> str:
        places, kinds = self._places(log), dict(c.split() for c in self.ddl.split(", "))
        picked = ", ".join(f"CAST({places[n]} AS {'VARCHAR' if k == 'string' else 'BIGINT'}) AS {n}" if n in places else f"replace(c.{n}, '{{i}}', CAST(event_id AS VARCHAR)) AS {n}" if k == "string" else f"c.{n}" for n, k in kinds.items())
        cases = Inline("_r", f"_case int, {', '.join(f'{n} {k}' for n, k in kinds.items())}", [(n, *r) for n, r in enumerate(self.rows)]).sql
        return f"{cases}, {self.name} AS (SELECT {picked} FROM events JOIN _r c ON c._case = event_id % {len(self.rows)})"

    def grouped(self, spark, sf, size: int, first: int = 0) -> DataFrame:
        """`size` consecutive events are a group (column grp): those at the places from `first` on are its rows, in order; `{i}` in a text is the group.
        event_id and the event's value in whole numbers (v) come along."""
        case = F.broadcast(spark.createDataFrame([(n + first, *r) for n, r in enumerate(self.rows)], f"_case int, {self.ddl}"))
        e = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / size).alias("grp"), (F.col("event_id") % size).cast("int").alias("_case"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("v"))
        texts = {n: F.replace(F.col(n), F.lit("{i}"), F.col("grp").cast("string")) for n, k in (c.split() for c in self.ddl.split(", ")) if k == "string"}
        out = e.join(case, "_case").drop("_case")
        return out.withColumns(texts) if texts else out

    def grouped_sql(self, size: int, first: int = 0) -> str:
        """`grouped`, as common table expressions."""
        columns = [c.split() for c in self.ddl.split(", ")]
        picked = ", ".join(f"replace(c.{n}, '{{i}}', CAST(event_id // {size} AS VARCHAR)) AS {n}" if k == "string" else f"c.{n}" for n, k in columns)
        cases = Inline(f"_{self.name}", f"_case int, {self.ddl}", [(n + first, *r) for n, r in enumerate(self.rows)]).sql
        return f"{cases}, {self.name} AS (SELECT event_id, event_id // {size} AS grp, CAST(floor(coalesce(value, 0)) AS BIGINT) AS v, {picked} FROM events JOIN _{self.name} c ON c._case = event_id % {size})"

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
        columns = [c.split() for c in self.ddl.split(", ")]

        def cell(v, kind: str) -> str:
            body = "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)
            return f"CAST({body} AS {kinds[kind]})"

        rows = ", ".join("(" + ", ".join(cell(v, k) for v, (_, k) in zip(r, columns)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(n for n, _ in columns)}) AS (VALUES {rows})"


# ---- names, texts, queries ----------------------------------------------------------------------------------------

_NAMES = Inline("f", "name string", [(n,) for n in (
    "Password{i}__c", "clientSecret", "SSN", "social security", "creditCard", "Card_Number", "CCN", "apiKey", "access_token", "bearer", "session_id", "SessionToken", "token", "user{i}_email", "E-Mail", "mobile",
    "CellPhone", "fax", "Mailing{i}Street", "zip", "client_ip", "ip_address", "birthDate", "DOB", "date_of_birth", "FirstName", "username", "Account{i}Id", "record_id", "Amount{i}", "card", "",
)])


@register(rf"""WITH {_NAMES.dealt_sql}, r AS (SELECT * FROM (VALUES (1, 'password|passwd|pwd|secret', 'CRITICAL', 'Password field'), (2, 'ssn|social.?security', 'CRITICAL', 'SSN field'), (3, 'credit.?card|card.?number|ccn', 'CRITICAL', 'Credit card field'),
(4, 'api.?key|access.?token|bearer', 'CRITICAL', 'API key/token field'), (5, 'session.?id|session.?token', 'CRITICAL', 'Session field'), (6, 'email|e-mail', 'HIGH', 'Email field'), (7, 'phone|mobile|cell|fax', 'HIGH', 'Phone field'),
(8, 'address|street|city|zip|postal', 'HIGH', 'Address field'), (9, 'birth.?date|dob|date.?of.?birth', 'HIGH', 'Date of birth field'), (10, 'name|first.?name|last.?name|full.?name', 'MEDIUM', 'Name field'), (11, 'user.?name|username', 'MEDIUM', 'Username field'),
(12, 'ip.?address|client.?ip', 'MEDIUM', 'IP address field'), (13, 'id$|_id$|Id$', 'LOW', 'ID field')) AS v(n, p, level, reason))
SELECT event_id, any_value(name) AS name, coalesce(arg_min(level, n), 'NONE') AS sensitivity, coalesce(arg_min(reason, n), 'No sensitive pattern detected in name') AS reason FROM f LEFT JOIN r ON regexp_matches(name, '(?i)' || p) GROUP BY 1""")
def field_rules(spark, sf):
    c = F.col("name")
    return _NAMES.dealt(spark, sf).select("event_id", "name", privacy.field_sensitivity(c).alias("sensitivity"), privacy.field_reason(c).alias("reason"))


_FIELDS = Inline("f", "name string, value string", [("email", "none"), ("note{i}", "mail a{i}@b.co"), ("Amount{i}", "12"), ("password", "mail a@b.co"), ("ownerId", "123-45-6789"), ("city", "10.0.0.1"), ("x", "10.0.0.1")])


@register(rf"""WITH {_FIELDS.dealt_sql}, a AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)password') THEN 4 WHEN regexp_matches(name, '(?i)email|city') THEN 3 WHEN regexp_matches(name, '(?i)id$') THEN 1 ELSE 0 END AS i,
CASE WHEN regexp_matches(value, '\b\d{{3}}[-\s]\d{{2}}[-\s]\d{{4}}\b') THEN 4 WHEN regexp_matches(value, '\w@\w+\.\w\w') THEN 3 WHEN regexp_matches(value, '\b(\d{{1,3}}\.){{3}}\d{{1,3}}\b') THEN 2 ELSE 0 END AS v FROM f), l AS (SELECT ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'] AS n)
SELECT event_id, name, value, n[i + 1] AS inferred, n[v + 1] AS actual, n[greatest(i, v) + 1] AS combined FROM a, l""")
def classify_fields(spark, sf):
    return _FIELDS.dealt(spark, sf).select("event_id", "name", "value", privacy.classify_field(F.col("name"), F.col("value")).alias("c")).select("event_id", "name", "value", "c.*")


_TEXTS = Inline("t", "text string", [(x,) for x in ("a@b.com", "a@b", "see x.co", "555-123-4567", "5551234567", "123 456", "1234 5678", "12345678", "api key", "apikey", "a token", "my Secret", "nothing", "", "12-34", "PASSWORD")])


@register(rf"WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id, (contains(text, '@') AND regexp_matches(text, '\.\w{{2,}}')) OR regexp_matches(text, '\d{{3}}[-.\s]?\d{{3}}[-.\s]?\d{{4}}') OR regexp_matches(text, '\d{{4}}[-\s]?\d{{4}}') OR regexp_matches(text, '(?i)password|secret|token|api.?key') AS likely FROM t")
def likely_pii_branches(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.likely_pii(F.col("text")).alias("likely"))


_STATEMENTS = Inline("s", "q string", [(x,) for x in (
    "SELECT Id FROM Account", "SELECT Id FROM Account LIMIT 5", "SELECT Id FROM Account WHERE Name = 'x'", "SELECT Id FROM A WHERE City LIKE '%{i}'", "SELECT Id FROM A WHERE City LIKE 'x%y'", "SELECT Id FROM A WHERE City != 'x'",
    "SELECT Id FROM A WHERE Id NOT IN :ids", "SELECT Id FROM A WHERE City = 'x' OR Zip = '1'", "SELECT Id FROM A WHERE CreatedDate > TODAY", "SELECT Id FROM A WHERE OwnerId = :me", "SELECT Id FROM A WHERE Id IN :ids", "SELECT Id FROM A WHERE X{i}__c = :y",
    "SELECT Id FROM A WHERE City = 'x' ORDER BY Name", "SELECT a, b, c, d, e FROM A WHERE Id = :x", "SELECT * FROM A", "SELECT a, b, c, d, e FROM A", "SELECT Id FROM A WHERE City LIKE '%x' AND Zip != '1'", "SELECT Id, (SELECT Id FROM B WHERE X != 1) FROM A",
    "SELECT Id FROM A WHERE CreatedById = :x", "SELECT Id FROM A WHERE City <> 'x' OR Zip LIKE '%1'", "", "WHERE",
)])


@register(rf"""WITH {_STATEMENTS.dealt_sql}, u AS (SELECT event_id, upper(q) AS u, trim(regexp_extract(upper(q), 'WHERE\s+(.+?)(ORDER BY|GROUP BY|LIMIT|$)', 1)) AS w FROM s WHERE q <> ''),
x AS (SELECT event_id, CASE WHEN NOT contains(u, 'WHERE') THEN 0.3 ELSE 0 END
 + CASE WHEN w <> '' THEN CASE WHEN regexp_matches(w, '%\w|LIKE\s+''%') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(w, 'NOT\s+IN|!=|<>') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(w, '\sOR\s') THEN 0.1 ELSE 0 END
 + CASE WHEN regexp_matches(w, '\b(ID|NAME|OWNERID|CREATEDBYID|LASTMODIFIEDBYID|RECORDTYPEID)\s*=|\b(CREATEDDATE|LASTMODIFIEDDATE|SYSTEMMODSTAMP)\s*[<>=]|\bIN\s*:|\b\w+__C\s*=\s*:') THEN 0 ELSE 0.2 END ELSE 0 END
 + CASE WHEN regexp_matches(u, 'SELECT\s+\*|SELECT.*,.*,.*,.*,') THEN 0.1 ELSE 0 END + CASE WHEN NOT contains(u, 'LIMIT') AND NOT contains(u, 'WHERE') THEN 0.2 ELSE 0 END AS total FROM u)
SELECT event_id, q, coalesce(round(total, 4), 0)::DOUBLE AS total, least(0.85, coalesce(round(total, 4), 0))::DOUBLE AS score, CASE WHEN total >= 0.4 THEN 'HIGH' WHEN total >= 0.25 THEN 'MEDIUM' WHEN total > 0 THEN 'LOW' END AS severity FROM s LEFT JOIN x USING (event_id)""")
def heuristic_branches(spark, sf):
    q = F.col("q")
    total = detect.heuristic_total(q)
    return _STATEMENTS.dealt(spark, sf).select("event_id", "q", F.coalesce(total, F.lit(0.0)).alias("total"), detect.query_heuristics(q).alias("score"), detect.heuristic_severity(total).alias("severity"))


_TRIGGERS = Inline("n", "name string", [(x,) for x in ("Account{i}Trigger", "Account{i}_Trigger", "SBQQ__QuoteTrigger", "Case{i}BeforeInsert", "Case_AfterUpdate", "LeadHandler", "OpportunityTriggerHandler", "contact_trigger", "Trigger", "a b Trigger")])


@register(rf"""WITH {_TRIGGERS.dealt_sql} SELECT event_id, name, coalesce(nullif(regexp_extract(name, '(?i)^(\w+?)_?Trigger$', 1), ''), nullif(regexp_extract(name, '(?i)^(\w+?)_?Before', 1), ''), nullif(regexp_extract(name, '(?i)^(\w+?)_?After', 1), ''), name) AS object FROM n""")
def trigger_objects(spark, sf):
    return _TRIGGERS.dealt(spark, sf).select("event_id", "name", detect.trigger_object(F.col("name")).alias("object"))


# ---- exceptions ---------------------------------------------------------------------------------------------------

_TYPES = Inline("t", "kind string", [(x,) for x in (*exceptions.EXCEPTIONS, "DmlException", "ns{i}.QueryException", "My{i}CalloutException", "Unknown", "", "System.Other", "System.LimitException2")])
_FACTS = "(VALUES " + ", ".join(f"({i}, '{k}', '{v[0]}', '{v[2]}')" for i, (k, v) in enumerate(exceptions.EXCEPTIONS.items())) + ") AS x(n, k, category, cause)"


@register(rf"""WITH {_TYPES.dealt_sql}, f AS (SELECT * FROM {_FACTS}) SELECT event_id, kind, coalesce((SELECT category FROM f WHERE k = kind), (SELECT arg_min(category, n) FROM f WHERE ends_with(kind, split_part(k, '.', 2))), 'UNKNOWN') AS category, true AS can_fix,
coalesce((SELECT cause FROM f WHERE k = kind), (SELECT arg_min(cause, n) FROM f WHERE ends_with(kind, split_part(k, '.', 2))), 'Unknown exception type') AS cause FROM t""")
def exception_facts(spark, sf):
    return _TYPES.dealt(spark, sf).select("event_id", "kind", exceptions.exception_info(F.col("kind")).alias("i")).select("event_id", "kind", "i.*")


_TRACES = Inline("t", "id long, lines string", [(1, "  Class.A{i}.b: line {i}, column 1\nAnonymousBlock: line 1\nTrigger.T: line 2"), (2, "at x.y.z\nattic\nline 12\nLINE x\nLine 4 "), (3, ""), (4, "Class.\nTrigger.")])


@register(r"WITH " + _TRACES.dealt_sql + r""" SELECT event_id, id, array_to_string(list_filter(list_transform(string_split(lines, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^(Class|Trigger)\.\w+|^at\s+|(?i:^line\s+\d+)')), '|') AS frames FROM t""")
def stack_frames(spark, sf):
    return _TRACES.dealt(spark, sf).select("event_id", "id", F.array_join(exceptions.stack_frames(F.split("lines", "\n")), "|").alias("frames"))


# ---- jobs and logs ------------------------------------------------------------------------------------------------

_STAMPS = Inline("t", "log_id string, id long, k string, ts long", [("a", 1, "x", 0), ("a", 2, "x", 800), ("a", 3, "x", 1600), ("a", 4, "y", 900), ("a", 5, "x", 2500), ("a", 6, "x", 2600), ("b", 1, "x", 5), ("b", 2, "x", 1004), ("b", 3, "x", 1005), ("b", 4, "x", 1005)])


@register(f"WITH RECURSIVE {_STAMPS.logged_sql()}, kept AS (SELECT log_id, k, min((ts, id)) AS x FROM t GROUP BY 1, 2 UNION ALL SELECT t.log_id, t.k, min((t.ts, t.id)) FROM kept JOIN t ON t.log_id = kept.log_id AND t.k = kept.k AND t.ts - kept.x[1] >= 1000 GROUP BY 1, 2) SELECT log_id, x[2] AS id FROM kept")
def jobs_dedupe(spark, sf):
    return correlation.dedupe_near(_STAMPS.logged(spark, sf), ["log_id", "k"], "ts", 1000).select("log_id", "id")


_JOBS = Inline("j", "job_key long, class_name string, method_name string, job_type string, job_id string, enqueued_ms long", [
    (1, "ns.MyJob", "", "QUEUEABLE", "707A{i}", 100000), (2, "Unknown", "", "BATCH", None, 100000), (3, "Nightly", "run", "FUTURE", None, 200000), (4, "Lost", "", "QUEUEABLE", "707Z{i}", 5000000), (5, "ByRecord{i}", "", "BATCH", None, 300000),
])
_LOGS = Inline("l", "child_id string, operation string, start_ms long", [
    ("c1", "MyJob.execute", 103000), ("c2", "ns/MyJob", 130000), ("c3", "other", 104000), ("c4", "batch start()", 110000), ("c5", "/apex/Nightly.run", 195000), ("c6", "NIGHTLY", 259999), ("c7", "Nightly", 260001), ("c8", "x", 301000), ("c9", "ns.myjob", 95000), ("c10", "ns.myjob", 94999), ("c11", None, 302000),
])
_RECORDS = Inline("r", "record_id string, record_class string, created_ms long, completed_ms long, kind string", [("707A{i}", "ns.MyJob", 100500, 140000, "Queueable"), ("707R{i}", "byrecord{i}", 299000, None, "BatchApex"), ("707S{i}", "byrecord{i}", 250000, 251000, "BatchApex")])

#: Sixteen events are five jobs and eleven logs, three of them records too; times move with the group and the event's value.
_JOB_TABLES = f"""{_JOBS.grouped_sql(16).replace(' j AS (', ' j0 AS (')}, {_LOGS.grouped_sql(16, 5).replace(' l AS (', ' l0 AS (')}, {_RECORDS.grouped_sql(16).replace(' r AS (', ' r0 AS (')},
j AS (SELECT grp, event_id AS job_key, class_name, method_name, job_type, job_id, enqueued_ms + 7000 * grp + v AS enqueued_ms FROM j0), l AS (SELECT grp, CAST(event_id AS VARCHAR) AS child_id, operation, start_ms + 7000 * grp + v AS start_ms FROM l0),
r AS (SELECT record_id, record_class, created_ms + 7000 * grp + v AS created_ms, completed_ms + 7000 * grp + v AS completed_ms, kind FROM r0)"""


def _job_tables(spark, sf):
    moved = lambda c: (F.col(c) + 7000 * F.col("grp") + F.col("v")).alias(c)
    jobs = _JOBS.grouped(spark, sf, 16).select("grp", F.col("event_id").alias("job_key"), "class_name", "method_name", "job_type", "job_id", moved("enqueued_ms"))
    logs = _LOGS.grouped(spark, sf, 16, 5).select("grp", F.col("event_id").cast("string").alias("child_id"), "operation", moved("start_ms"))
    return jobs, logs, _RECORDS.grouped(spark, sf, 16).select("record_id", "record_class", moved("created_ms"), moved("completed_ms"), "kind")


@register(rf"""WITH {_JOB_TABLES}, jr AS (SELECT j.*, coalesce(i.record_id, c.x.record_id) AS rid, coalesce(i.created_ms, c.x.created_ms) AS created, CASE WHEN i.record_id IS NOT NULL THEN coalesce(i.completed_ms, i.created_ms + 3600000) ELSE coalesce(c.x.completed_ms, c.x.created_ms + 3600000) END AS done
  FROM j LEFT JOIN r i ON i.record_id = j.job_id LEFT JOIN (SELECT lower(record_class) AS k, arg_max(r, created_ms) AS x FROM r GROUP BY 1) c ON c.k = lower(j.class_name)),
m AS (SELECT job_key, child_id, start_ms - enqueued_ms AS gap, class_name <> 'Unknown' AND (contains(lower(coalesce(operation, '')), lower(class_name)) OR contains(lower(coalesce(operation, '')), replace(lower(class_name), '.', '/'))) AS named,
  coalesce(start_ms BETWEEN created - 5000 AND done + 5000, false) AS running, coalesce(job_id = rid, false) AS same FROM jr JOIN l ON l.grp = jr.grp AND start_ms BETWEEN enqueued_ms - 5000 AND enqueued_ms + 60000),
s AS (SELECT *, greatest(0.3, 1 - abs(gap) / 60000.0)::DOUBLE AS t, named::INT + 1 + same::INT AS n FROM m WHERE named OR running),
c AS (SELECT job_key, child_id, n, same, greatest(0, least(1, (CASE WHEN named THEN 0.7 * 0.7 ELSE 0 END + t * 0.6 + CASE WHEN same THEN 0.95 * 0.95 ELSE 0 END) / (CASE WHEN named THEN 0.7 ELSE 0 END + 0.6 + CASE WHEN same THEN 0.95 ELSE 0 END) + least(0.1, 0.03 * (n - 1)) - CASE WHEN n = 1 THEN 0.15 ELSE 0 END)) AS confidence FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY confidence DESC, n DESC, same DESC, child_id) AS place FROM c WHERE confidence >= 0.5)
SELECT job_key, child_id, round(confidence, 6)::DOUBLE AS confidence, place::INTEGER AS place FROM k WHERE place <= 10 UNION ALL SELECT job_key, NULL, 0.3, 1 FROM j WHERE job_key NOT IN (SELECT job_key FROM k)""")
def correlate_logs(spark, sf):
    jobs, logs, records = _job_tables(spark, sf)
    out = correlation.correlate(jobs, logs, records=records, keys=("grp",))
    return out.select("job_key", "child_id", rounded(F.col("confidence"), 6).alias("confidence"), "place")


@register(rf"""WITH {_JOB_TABLES}, p AS (SELECT *, start_ms - enqueued_ms AS gap FROM j JOIN l USING (grp)) SELECT job_key, child_id FROM p WHERE gap BETWEEN -5000 AND 3600000 AND ((class_name <> 'Unknown' AND contains(lower(coalesce(operation, '')), lower(class_name))) OR (gap >= 0 AND gap < 60000))""")
def likely_children(spark, sf):
    jobs, logs, _ = _job_tables(spark, sf)
    pairs = correlation.interval_join(jobs, logs.withColumn("operation", F.coalesce("operation", F.lit(""))), ["grp"], "enqueued_ms", "start_ms", 5000, 3_600_000)
    return pairs.where(correlation.likely_child(F.col("enqueued_ms"), F.col("start_ms"), F.col("class_name"), F.col("operation"))).select("job_key", "child_id")


@register(rf"""WITH {_JOB_TABLES}, p AS (SELECT j.* EXCLUDE (grp), l.* EXCLUDE (grp), r.*, lower(coalesce(operation, '')) AS op, start_ms - enqueued_ms AS gap, start_ms - created_ms AS since FROM j JOIN l ON l.grp = j.grp AND abs(start_ms - enqueued_ms) < 200000 LEFT JOIN r ON r.record_id = coalesce(j.job_id, CASE WHEN j.class_name LIKE 'ByRecord%' THEN '707R' || j.grp END)),
q AS (SELECT job_key, child_id, CASE WHEN job_id = record_id THEN 'JOB_ID:0.95' END AS a,
 CASE WHEN class_name = 'Unknown' THEN NULL WHEN contains(op, lower(class_name)) THEN 'CLASS_NAME:0.8' WHEN contains(op, regexp_extract(lower(class_name), '[^.]*$')) THEN 'CLASS_NAME:0.65' WHEN lower(record_class) = lower(class_name) THEN 'CLASS_NAME:0.85' END AS b,
 CASE WHEN gap < -5000 THEN NULL WHEN gap < 10000 THEN 'TIMING:0.8' WHEN gap < 30000 THEN 'TIMING:0.6' WHEN gap <= 60000 THEN 'TIMING:0.4' WHEN since BETWEEN -5000 AND 120000 THEN CASE WHEN since < 30000 THEN 'TIMING:0.7' ELSE 'TIMING:0.5' END END AS c,
 CASE WHEN job_type = 'FUTURE' AND method_name <> '' AND contains(op, lower(method_name)) THEN 'METHOD_NAME:0.85' END AS d,
 CASE WHEN job_type = 'BATCH' AND kind IN ('BatchApex', 'BatchApexWorker') AND regexp_matches(op, 'batch|start\(\)|execute\(\)|finish\(\)') THEN 'BATCH:0.75' END AS e FROM p)
SELECT job_key, child_id, concat_ws(',', a, b, c, d, e) AS evidence FROM q""")
def candidate_scores(spark, sf):
    jobs, logs, records = _job_tables(spark, sf)
    pairs = correlation.interval_join(jobs, logs, ["grp"], "enqueued_ms", "start_ms", 199_999, 199_999)
    of = F.coalesce("job_id", F.when(F.col("class_name").startswith("ByRecord"), F.concat(F.lit("707R"), F.col("grp").cast("string"))))
    pairs = correlation.left_join_dealt(pairs.withColumn("_r", of), records.withColumn("_r", F.col("record_id")), "_r", ["job_key", "child_id"])
    job = {c: F.col(c) for c in ("class_name", "method_name", "job_type", "job_id", "enqueued_ms")}
    record = {"id": F.col("record_id"), "class_name": F.col("record_class"), "created_ms": F.col("created_ms"), "kind": F.col("kind")}
    found = correlation.score_candidate(job, {"operation": F.col("operation"), "start_ms": F.col("start_ms")}, record)
    return pairs.select("job_key", "child_id", F.array_join(F.transform(found, lambda e: F.concat(e["reason"], F.lit(":"), e["confidence"].cast("string"))), ",").alias("evidence"))


_EXTRACTED = Inline("t", "log_id long, jobs long, unknown long, without_id long, events long", [(1, 0, 0, 0, 10), (2, 2, 1, 2, 100), (3, 4, 4, 4, 49), (4, 1, 0, 0, 50), (5, 3, 0, 1, 5)])


@register(f"WITH {_EXTRACTED.logged_sql('event_id')} SELECT log_id, round(greatest(0, least(1, 1 - 0.3 * unknown / greatest(jobs, 1) - 0.2 * without_id / greatest(jobs, 1) - CASE WHEN events < 50 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS confidence FROM t")
def extraction_confidence(spark, sf):
    return _EXTRACTED.logged(spark, sf, "event_id").select("log_id", rounded(correlation.extraction_confidence(*map(F.col, ("jobs", "unknown", "without_id", "events"))), 6).alias("confidence"))


# ---- packages -----------------------------------------------------------------------------------------------------

_PLACED = Inline("e", "log_id string, id long, type string, namespace string, class_name string, method_name string, unit_name string", [
    ("a", 1, "METHOD_ENTRY", None, "Plain", "doWork", None), ("a", 2, "ENTERING_MANAGED_PKG", "abc", None, None, None), ("a", 3, "METHOD_ENTRY", "abc", "abc__Thing", "x1", None), ("a", 4, "METHOD_EXIT", None, "OrderTrigger", "run", None), ("a", 20, "METHOD_ENTRY", None, "OrderHandler", "go", None),
    ("a", 40, "METHOD_ENTRY", None, "Plain", "calculateAll", None), ("b", 1, "METHOD_ENTRY", None, "Plain", "calculateAll", None), ("b", 2, "METHOD_ENTRY", "zz", "Plain", "calculateAll", None), ("b", 3, "USER_DEBUG", None, None, None, None),
])
_FOUND = Inline("i", "log_id string, det_seq long, id long, code_snippet string", [("a", 1, 1, None), ("a", 2, 3, None), ("a", 3, 4, None), ("a", 4, 20, None), ("a", 5, 40, "Abc__Thing.run failed"), ("a", 6, 40, "Apex script unhandled x in abcd. y"), ("b", 1, 1, None), ("b", 2, 2, None), ("b", 3, 3, None), ("b", 3, 2, None)])
#: Ten events are the nine events of two logs and the ten events of their issues.
_BRANCHES = f"{_PLACED.grouped_sql(10).replace(' e AS (', ' e0 AS (')}, {_FOUND.grouped_sql(10).replace(' i AS (', ' i0 AS (')}, e AS (SELECT log_id || grp AS log_id, * EXCLUDE (event_id, grp, v, log_id) FROM e0), i AS (SELECT log_id || grp AS log_id, * EXCLUDE (event_id, grp, v, log_id) FROM i0)"


@register(rf"""WITH {_BRANCHES}, shown AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY id) AS n,
  -- the package that each event runs in: entered by a marker, left by an exit that shows none of its own
  CASE WHEN log_id LIKE 'a%' AND id IN (2, 3) THEN 'abc' END AS ctx FROM e),
crossed AS (SELECT log_id, id FROM (SELECT *, lag(ctx) OVER (PARTITION BY log_id ORDER BY id) AS before FROM shown) WHERE n > 1 AND ctx IS DISTINCT FROM before),
x AS (SELECT i.log_id, i.det_seq, i.code_snippet, e.* EXCLUDE (log_id) FROM i JOIN e USING (log_id, id)),
ns AS (SELECT log_id, det_seq, namespace, count(*) FILTER (type = 'ENTERING_MANAGED_PKG') * 0.9 + CASE WHEN coalesce(min(id) FILTER (type <> 'ENTERING_MANAGED_PKG'), 999) < coalesce(min(id) FILTER (type = 'ENTERING_MANAGED_PKG'), 999) THEN 0.8 ELSE 0 END AS w FROM x WHERE namespace <> '' GROUP BY 1, 2, 3),
mk AS (SELECT log_id, det_seq, sum(w) AS w FROM ns GROUP BY 1, 2),
cd AS (SELECT log_id, det_seq, sum(CASE WHEN type LIKE 'METHOD%' THEN CASE WHEN regexp_matches(class_name, '^[a-zA-Z_][a-zA-Z0-9_]*__') THEN 0.75 ELSE 0 END + CASE WHEN length(method_name) <= 2 OR regexp_matches(method_name, '^[a-zA-Z][0-9a-zA-Z]{{1,4}}$') THEN 0.7 ELSE 0 END ELSE 0 END) AS m,
  sum(CASE WHEN type LIKE 'METHOD%' AND regexp_matches(class_name, 'Trigger|Handler') THEN 0.25 ELSE 0 END) AS h FROM x GROUP BY 1, 2),
bd AS (SELECT i.log_id, i.det_seq, count(DISTINCT c.id) * 0.85 AS b FROM i JOIN crossed c ON c.log_id = i.log_id AND abs(c.id - i.id) <= 5 GROUP BY 1, 2),
tx AS (SELECT log_id, det_seq, max(CASE WHEN regexp_matches(code_snippet, '[A-Z]\w{{1,14}}__\w+') THEN 0.65 WHEN regexp_matches(code_snippet, 'Apex script unhandled.*\w{{2,15}}\.') THEN 0.6 ELSE 0 END) AS t FROM i GROUP BY 1, 2),
s AS (SELECT log_id, det_seq, coalesce(mk.w, 0) + m + h + t AS managed, CASE WHEN mk.w IS NULL THEN 0.7 ELSE 0 END + h AS usr, coalesce(b, 0) AS boundary FROM tx JOIN cd USING (log_id, det_seq) LEFT JOIN mk USING (log_id, det_seq) LEFT JOIN bd USING (log_id, det_seq))
SELECT log_id, det_seq, round(managed, 4)::DOUBLE AS managed, round(usr, 4)::DOUBLE AS usr, round(boundary, 4)::DOUBLE AS boundary, CASE WHEN boundary > 0.5 AND usr > 0 AND managed > 0 THEN 'BOUNDARY' WHEN managed > usr AND managed > 0.3 THEN 'MANAGED_PACKAGE' WHEN usr > managed THEN 'USER_CODE' ELSE 'UNKNOWN' END AS attribution,
round(CASE WHEN boundary > 0.5 AND usr > 0 AND managed > 0 THEN least(0.9, boundary) WHEN managed > usr AND managed > 0.3 THEN least(0.9, 0.5 + managed) WHEN usr > managed THEN least(0.9, 0.5 + usr) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM s""")
def attribute_branches(spark, sf):
    placed, named = (t.grouped(spark, sf, 10).withColumn("log_id", F.concat("log_id", F.col("grp").cast("string"))).drop("event_id", "grp", "v") for t in (_PLACED, _FOUND))
    issues = named.groupBy("log_id", "det_seq").agg(F.collect_list("id").alias("event_ids"), F.max("code_snippet").alias("code_snippet"))
    out = namespaces.attribute_issues(issues, placed)
    return out.select("log_id", "det_seq", *[rounded(F.col(a)).alias(b) for a, b in (("managed", "managed"), ("user", "usr"), ("boundary", "boundary"))], "attribution", rounded(F.col("attribution_confidence")).alias("confidence"))


_CALLS = Inline("c", "id long, namespace string, method_name string, frame string", [
    (1, "SBQQ", "calculateAll", None), (2, "sflabs", "a", None), (3, "ab", "a", None), (4, "ab", "b1", None), (5, "longpackage", "getName", None), (6, "longpackage", "validate_All", None), (7, "medium", "getName", None), (8, "medium", "x1", None), (9, "medium", "Q", None),
    (10, "mixed", "getName", None), (11, "mixed", "Abc Def", None), (12, "traced", "Abc Def", "Class.ABC.12"), (13, "traced", None, "A.b.cdefgh"), (14, "open", "execute", "A.b.cdefgh"), (15, "x", "aaa", None), (16, "none", None, None),
])


@register(r"WITH " + _CALLS.logged_sql() + r""", n AS (SELECT DISTINCT namespace, method_name AS m FROM c WHERE method_name <> ''),
o AS (SELECT *, lower(m) NOT IN ('execute', 'run', 'invoke', 'handle', 'process') AND (regexp_matches(m, '(?i)^([a-z]|[a-z][0-9a-z]+|__[a-z]+|[a-z]+_\d+)$') OR regexp_matches(m, '^(a{3,}|b{3,})$') OR (length(m) <= 2 AND lower(m) NOT IN ('do', 'go', 'is', 'on'))) AS odd,
 regexp_matches(m, '^[a-z][a-zA-Z0-9]*$|^(get|set|handle|process|create|update|delete|validate|calculate)[A-Z]|^(on|handle|before|after)[A-Z]|^test[A-Z]') OR (length(m) BETWEEN 5 AND 50 AND regexp_matches(m, '^[a-z][a-zA-Z0-9_]*$')) AS clear FROM n),
k AS (SELECT namespace, count(m) AS n, count(*) FILTER (odd) AS obfuscated, count(*) FILTER (NOT odd AND clear) AS readable FROM (SELECT DISTINCT namespace FROM c) LEFT JOIN o USING (namespace) GROUP BY 1),
f AS (SELECT namespace, arg_min(CASE WHEN regexp_matches(frame, '\(\d+\)$|Class\.[A-Z]+\.\d+') THEN 'hidden' ELSE 'clear' END, id) AS kind FROM c WHERE regexp_matches(frame, '\(\d+\)$|Class\.[A-Z]+\.\d+|\w+\.\w+\.(\w{5,})') GROUP BY 1),
p AS (SELECT k.*, CASE WHEN obfuscated * 2 > n THEN 0.8 ELSE 0 END + CASE WHEN kind = 'hidden' THEN 0.6 ELSE 0 END + CASE WHEN length(namespace) BETWEEN 2 AND 4 THEN 0.4 WHEN length(namespace) = 1 THEN 0.3 ELSE 0 END AS pr,
 CASE WHEN readable * 2 > n AND obfuscated * 2 <= n THEN 0.7 ELSE 0 END + CASE WHEN kind = 'clear' THEN 0.5 ELSE 0 END + CASE WHEN length(namespace) > 8 THEN 0.15 WHEN length(namespace) > 4 THEN 0.1 ELSE 0 END AS pu FROM k LEFT JOIN f USING (namespace))
SELECT namespace, obfuscated, readable, CASE WHEN namespace = 'SBQQ' THEN 'PRIVATE' WHEN namespace = 'sflabs' THEN 'PUBLIC' WHEN pr > pu AND pr > 0.5 THEN 'PRIVATE' WHEN pu > pr AND pu > 0.5 THEN 'PUBLIC' ELSE 'UNKNOWN' END AS visibility,
round(CASE WHEN namespace IN ('SBQQ', 'sflabs') THEN 0.95 WHEN pr > pu AND pr > 0.5 THEN least(0.9, 0.5 + pr) WHEN pu > pr AND pu > 0.5 THEN least(0.9, 0.5 + pu) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM p""")
def visibility_branches(spark, sf):
    calls = _CALLS.logged(spark, sf).withColumn("stack", F.when(F.col("frame").isNotNull(), F.array("frame")))
    return namespaces.visibility(calls, stack="stack").select("namespace", "obfuscated", "readable", "visibility", "confidence")


# ---- presets, levels, confidence ----------------------------------------------------------------------------------

_WANTED = Inline("i", "log_id long, det_seq long, type string", [(1, 1, "SOQL_IN_LOOP"), (1, 2, "n_plus_one"), (1, 3, "callout_error"), (2, 1, "nonsense"), (3, 1, "recursive_trigger"), (3, 2, "cpu_hotspot"), (4, 1, "general"), (4, 2, "visualforce"), (5, 1, "dml_exception"), (5, 2, "bulkification")])
_VOTES = "(VALUES " + ", ".join(f"('{t}', {n}, '{p}')" for t, ps in truncation.ISSUE_PRESETS.items() for n, p in enumerate(ps)) + ") AS v(t, n, preset)"


@register(f"""WITH {_WANTED.logged_sql()}, v AS (SELECT * FROM {_VOTES}), a AS (SELECT log_id, det_seq, coalesce(v.n, 0) AS n, coalesce(v.preset, 'ai_optimized') AS preset FROM i LEFT JOIN v ON v.t = lower(i.type)),
c AS (SELECT log_id, preset, count(*) AS votes, min((det_seq, n)) AS f FROM a GROUP BY 1, 2) SELECT log_id, preset, votes FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY votes DESC, f) AS r FROM c) WHERE r = 1""")
def preset_votes(spark, sf):
    return truncation.best_preset(_WANTED.logged(spark, sf))


_SEEN = Inline("e", "log_id long, type string", [(1, "METHOD_ENTRY"), (1, "SOQL_EXECUTE_BEGIN"), (2, "LIMIT_USAGE"), (3, "METHOD_ENTRY"), (3, "SOQL_EXECUTE_BEGIN"), (3, "SOQL_EXECUTE_EXPLAIN"), (3, "CODE_UNIT_STARTED"), (3, "LIMIT_USAGE"), (4, "METHOD_EXIT")])
_HAVE = Inline("h", "log_id long, category string, level_rank int", [(1, "Apex_code", 5), (1, "Database", 3), (3, "Apex_code", 7), (3, "Apex_profiling", 7), (3, "Database", 7), (3, "System", 7), (3, "Workflow", 7), (4, "Apex_code", 1), (4, "System", 2)])
#: Nine events are the events and the levels of four logs.
_LEVELS = f"{_SEEN.grouped_sql(9).replace(' e AS (', ' e0 AS (')}, {_HAVE.grouped_sql(9).replace(' h AS (', ' h0 AS (')}, e AS (SELECT grp * 10 + log_id AS log_id, type FROM e0), h AS (SELECT grp * 10 + log_id AS log_id, category, level_rank FROM h0)"
_NEEDS = "(VALUES " + ", ".join(f"('{d}', '{c}', {DEBUG_LEVELS.index(v)})" for d, (req, _) in truncation.DETECTOR_NEEDS.items() for c, v in req.items()) + ") AS q(detector, category, r)"
_NEEDED = "(VALUES " + ", ".join(f"('{d}', '{t}')" for d, t in truncation.detector_needs()) + ") AS t(detector, type)"


@register(f"""WITH {_LEVELS}, q AS (SELECT * FROM {_NEEDS}), t AS (SELECT * FROM {_NEEDED}), l AS (SELECT DISTINCT log_id FROM e),
d AS (SELECT l.log_id, q.detector, q.category, q.r, h.level_rank, EXISTS (SELECT 1 FROM e JOIN t USING (type) WHERE e.log_id = l.log_id AND t.detector = q.detector) AS any_there FROM l, q LEFT JOIN h ON h.log_id = l.log_id AND h.category = q.category),
w AS (SELECT log_id, detector, count(*) FILTER (CASE WHEN level_rank IS NULL THEN NOT any_there ELSE level_rank < r END)::INTEGER AS n_warnings, (NOT bool_or(any_there))::INTEGER AS n_errors FROM d GROUP BY 1, 2)
SELECT *, round(0.1 * n_warnings + 0.2 * n_errors, 4)::DOUBLE AS penalty FROM w WHERE n_warnings + n_errors > 0""")
def level_validation(spark, sf):
    have, seen = (t.grouped(spark, sf, 9).withColumn("log_id", F.col("grp") * 10 + F.col("log_id")) for t in (_HAVE, _SEEN))
    return truncation.validate_levels(have, seen).select("log_id", "detector", "n_warnings", "n_errors", rounded(F.col("penalty")).alias("penalty"))


_JUDGED = Inline("x", "log_id long, score double, parsed long, failed long, total long, n_types long, issue_mean double, events long, issues long, unknown long, attr_mean double, cut boolean, kind string, lost long, started boolean, finished boolean", [
    (1, 1.0, 100, 0, 100, 9, 0.9, 500, 3, 0, 0.9, False, None, None, True, True), (2, 0.9, 96, 4, 100, 2, 0.7, 50, 4, 2, 0.7, True, "SIZE_LIMIT", 100, True, False), (3, 0.8, 91, 9, 100, 5, 0.2, 5, 4, 4, 0.1, True, "TIMEOUT", None, False, False),
    (4, 0.5, 20, 80, 100, 1, None, 0, 0, 0, None, True, "LINE_LIMIT", 9900, True, True), (5, 1.0, 99, 0, 100, 3, 0.8, 100, 1, 1, 0.8, True, "UNKNOWN", 1, False, True),
])


@register(f"""WITH {_JUDGED.dealt_sql}, p AS (SELECT event_id, log_id, greatest(0, least(1, score * CASE WHEN parsed / total >= 0.95 THEN 1 WHEN parsed / total >= 0.9 THEN 0.9 ELSE 0.7 END * CASE WHEN failed > 0 THEN greatest(0.5, 1 - 2 * failed / total) ELSE 1 END * CASE WHEN n_types < 3 THEN 0.8 ELSE 1 END)) AS a,
CASE WHEN issue_mean IS NULL OR issue_mean >= 0.8 THEN 1 WHEN issue_mean >= 0.6 THEN 0.9 ELSE 0.7 END * CASE WHEN events < 10 THEN 0.6 WHEN events < 100 THEN 0.9 ELSE 1 END AS b,
CASE WHEN issues = 0 THEN 1 ELSE CASE WHEN unknown > 0 THEN greatest(0.5, 1 - unknown / issues * 0.5) ELSE 1 END * CASE WHEN attr_mean >= 0.8 THEN 1 WHEN attr_mean >= 0.6 THEN 0.9 ELSE 0.7 END END AS c,
CASE WHEN cut THEN CASE kind WHEN 'SIZE_LIMIT' THEN 0.5 WHEN 'TIMEOUT' THEN 0.6 ELSE 0.7 END * CASE WHEN lost > 0 THEN greatest(0.3, 1 - round(lost / (total + lost) * 100) / 100 * 0.7) ELSE 1 END ELSE 1 END * CASE WHEN started AND NOT finished THEN 0.7 ELSE 1 END AS d FROM x)
SELECT event_id, log_id, round(a, 6)::DOUBLE AS parsing, round(b, 6)::DOUBLE AS detection, round(c, 6)::DOUBLE AS attribution, round(d, 6)::DOUBLE AS completeness, round(0.25 * a + 0.3 * b + 0.2 * c + 0.25 * d, 6)::DOUBLE AS overall FROM p""")
def confidence_parts(spark, sf):
    c = F.col
    parts = {
        "parsing": scoring.parsing_confidence(c("score"), c("parsed"), c("failed"), c("total"), c("n_types")), "detection": scoring.detection_confidence(c("issue_mean"), c("events")),
        "attribution": scoring.attributed_confidence(c("issues"), c("unknown"), c("attr_mean")), "completeness": scoring.completeness_confidence(c("cut"), c("kind"), c("lost"), c("total"), c("started"), c("finished")),
    }
    out = _JUDGED.dealt(spark, sf).select("event_id", "log_id", *[v.alias(k) for k, v in parts.items()]).withColumn("overall", scoring.overall_confidence(*map(c, parts)))
    return out.select("event_id", "log_id", *[rounded(c(k), 6).alias(k) for k in (*parts, "overall")])


# ---- parsed logs --------------------------------------------------------------------------------------------------

#: Lines of a log; an event of the events table is one of them, by its id, with its id, its value in whole numbers and its user put in.
_LINES = (
    "EXECUTION_STARTED", "CODE_UNIT_STARTED|[EXTERNAL]|01q000000000001|Order{u}Trigger on Order{v} trigger event BeforeInsert", "METHOD_ENTRY|[{v}]|01p000000000001|Service{u}.run{i}(List<Id>)",
    "SOQL_EXECUTE_BEGIN|[{v}]|Aggregations:{v}|SELECT Id, (SELECT Id FROM Lines) FROM Order{u} WHERE N > {i}", "SOQL_EXECUTE_END|[{v}]|Rows:{i}", "SOQL_EXECUTE_EXPLAIN|[14]|Index on Order : [Id], cardinality: 5, sobjectCardinality: 9, relativeCost 0.5",
    "DML_BEGIN|[{v}]|Op:Update|Type:Order{u}|Rows:{v}", "DML_END|[{v}]", "VARIABLE_ASSIGNMENT|[{v}]|total{u}|{i}|0x{v}", "VARIABLE_ASSIGNMENT|[EXTERNAL]|name|\"x{i}\"", "STATEMENT_EXECUTE|[{v}]", "USER_DEBUG|[{v}]|DEBUG|total is|{i}", "HEAP_ALLOCATE|[{v}]|Bytes:{i}",
    "SYSTEM_METHOD_ENTRY|[{v}]|List{u}.size()", "SYSTEM_MODE_ENTER|true", "VALIDATION_RULE|03d000000000001|Needs_{i}", "VALIDATION_FORMULA|ISBLANK(F{u})|Name=x{i}", "EXCEPTION_THROWN|[{v}]|System.DmlException: Insert {i} failed", "FATAL_ERROR|System.NullPointerException: Attempt {i}",
    "METHOD_EXIT|[{v}]|01p000000000001|Service{u}.run{i}(List<Id>)", "CODE_UNIT_FINISHED|Order{u}Trigger on Order{v} trigger event BeforeInsert", "EXECUTION_FINISHED", "ENTERING_MANAGED_PKG|abc{u}", "LIMIT_USAGE_FOR_NS|abc{u}|Number of SOQL queries: {v} out of 100",
    "FLOW_VALUE_ASSIGNMENT|i{u}|myVar|{v}", "FLOW_RULE_DETAIL|i{u}|true|Rule_{v}", "WF_EMAIL_SENT|a{i}|b", "QUEUEABLE_JOB|Job{i}", "NOT_A_TYPE|x", "DML_BEGIN|[{v}]|Op:Merge|Type:Lead{u}|Rows:{i}", "CODE_UNIT_STARTED|[EXTERNAL]|Validation:Lead{v}:new", "USER_INFO|x",
)
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _LINES) + "]"
_TOKENS = rf"""ln AS (SELECT CAST(user_id AS VARCHAR) AS log_id, event_id AS n, '09:00:00.0 (' || event_id * 1000 || ')|' || replace(replace(replace(({_LIST})[1 + event_id % {len(_LINES)}], '{{i}}', CAST(event_id AS VARCHAR)), '{{v}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), '{{u}}', CAST(user_id AS VARCHAR)) AS line FROM events),
tk AS (SELECT log_id, n, n * 1000 AS t, string_split(line, '|') AS s FROM ln WHERE NOT contains(line, 'NOT_A_TYPE')),
ev AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY n) AS id, s[2] AS type, t, s[3:] AS g FROM tk)"""


def _raw(spark, sf) -> DataFrame:
    """A log for each user of the events table: a header, a line of no event, and a line for each event."""
    i, u, v = (c.cast("string") for c in (F.col("event_id"), F.col("user_id"), F.floor("value").cast("long")))
    line = F.get(F.array(*map(F.lit, _LINES)), (F.col("event_id") % len(_LINES)).cast("int"))
    for name, value in (("{i}", i), ("{v}", v), ("{u}", u)):
        line = F.replace(line, F.lit(name), value)
    line = F.concat(F.lit("09:00:00.0 ("), (F.col("event_id") * 1000).cast("string"), F.lit(")|"), line)
    lines = table(spark, sf, "events").groupBy(u.alias("log_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("log_id", F.concat(F.lit("64.0 APEX_CODE,FINE;DB,INFO\nno event\n"), body).alias("content"))


def _parsed(spark, sf) -> DataFrame:
    return parse_logs(_raw(spark, sf), written=False).events


def _handler(name: str, types: str, columns: dict[str, str]) -> None:
    """A query of some columns of the parsed events of some types, and SQL that reads them from the lines."""
    kinds = {"source_line": "INTEGER", "row_count": "BIGINT", "aggregations": "BIGINT", "bytes": "BIGINT", "used": "BIGINT", "max": "BIGINT", "is_external": "BOOLEAN"}
    picked = ", ".join(f"CAST({sql} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c, sql in columns.items())

    def run(spark, sf):
        return _parsed(spark, sf).where(f"type in ({types})").select("log_id", "id", "type", "timestamp", *columns)

    run.__name__ = name
    register(f"WITH {_TOKENS} SELECT log_id, id, type, t AS timestamp, {picked} FROM ev WHERE type IN ({types})")(run)


_LAST = "g[len(g)]"
_LINE = r"nullif(regexp_extract(g[1], '\[(\d+)\]', 1), '')"
_handler("parsed_methods", "'METHOD_ENTRY', 'METHOD_EXIT'", {"class_name": "regexp_extract(array_to_string(g[2:], '|'), '^(.*)\\.[^.]*$', 1)", "method_name": "regexp_extract(array_to_string(g[2:], '|'), '\\.([^.]*)$', 1)", "source_location": "g[1]"})
_handler("parsed_queries", "'SOQL_EXECUTE_BEGIN', 'SOQL_EXECUTE_END'", {"query": "CASE WHEN type = 'SOQL_EXECUTE_BEGIN' THEN array_to_string(g[3:], '|') END", "aggregations": f"CASE WHEN type = 'SOQL_EXECUTE_BEGIN' THEN replace(g[2], 'Aggregations:', '') END", "row_count": "CASE WHEN type = 'SOQL_EXECUTE_END' THEN replace(g[2], 'Rows:', '') END"})
_handler("parsed_writes", "'DML_BEGIN'", {"operation": "upper(replace(g[2], 'Op:', ''))", "sobject_type": "replace(g[3], 'Type:', '')", "row_count": "replace(g[4], 'Rows:', '')"})
_handler("parsed_variables", "'VARIABLE_ASSIGNMENT'", {"variable_name": "g[2]", "raw_value": "g[3]", "value_type": "CASE WHEN regexp_matches(g[3], '^-?\\d+$') THEN 'Integer' ELSE 'String' END", "address": "g[4]", "source_line": _LINE, "is_external": "g[1] = '[EXTERNAL]'"})
_handler("parsed_statements", "'STATEMENT_EXECUTE'", {"source_location": "g[1]", "source_line": _LINE})
_handler("parsed_debug", "'USER_DEBUG'", {"level": "g[2]", "message": "array_to_string(g[3:], '|')", "source_line": _LINE})
_handler("parsed_heap", "'HEAP_ALLOCATE'", {"bytes": "replace(g[2], 'Bytes:', '')", "source_line": _LINE})
_handler("parsed_system", "'SYSTEM_METHOD_ENTRY', 'SYSTEM_MODE_ENTER'", {"method_signature": "CASE WHEN type = 'SYSTEM_METHOD_ENTRY' THEN g[2] END", "mode": "CASE WHEN type = 'SYSTEM_MODE_ENTER' THEN g[1] END"})
_handler("parsed_validation", "'VALIDATION_RULE', 'VALIDATION_FORMULA'", {"rule_id": "CASE WHEN type = 'VALIDATION_RULE' THEN g[1] END", "rule_name": "CASE WHEN type = 'VALIDATION_RULE' THEN g[2] END", "formula": "CASE WHEN type = 'VALIDATION_FORMULA' THEN g[1] END", "field_values": "CASE WHEN type = 'VALIDATION_FORMULA' THEN g[2] END"})
_handler("parsed_exceptions", "'EXCEPTION_THROWN', 'FATAL_ERROR'", {"exception_type": f"split_part({_LAST}, ': ', 1)", "message": f"split_part({_LAST}, ': ', 2)"})
_handler("parsed_packages", "'ENTERING_MANAGED_PKG', 'LIMIT_USAGE_FOR_NS'", {"namespace": "g[1]", "limit_name": "nullif(regexp_extract(g[2], '^([^:]+):', 1), '')", "used": "nullif(regexp_extract(g[2], ': (\\d+) out', 1), '')", "max": "nullif(regexp_extract(g[2], 'of (\\d+)', 1), '')"})
_handler("parsed_flows", "'FLOW_VALUE_ASSIGNMENT', 'FLOW_RULE_DETAIL', 'WF_EMAIL_SENT'", {"interview_id": "CASE WHEN type LIKE 'FLOW%' THEN g[1] END", "variable_name": "CASE WHEN type = 'FLOW_VALUE_ASSIGNMENT' THEN g[2] END", "raw_value": "CASE WHEN type = 'FLOW_VALUE_ASSIGNMENT' THEN g[3] END", "detail": "CASE type WHEN 'FLOW_RULE_DETAIL' THEN array_to_string(g[2:], '|') WHEN 'WF_EMAIL_SENT' THEN array_to_string(g, '|') END"})
_handler("parsed_units", "'CODE_UNIT_STARTED', 'CODE_UNIT_FINISHED'", {"unit_type": f"CASE WHEN contains({_LAST}, 'Trigger on') THEN 'Trigger' WHEN contains({_LAST}, 'Validation:') THEN 'Validation' END", "unit_name": f"CASE WHEN contains({_LAST}, ' on ') THEN split_part({_LAST}, ' on ', 1) ELSE {_LAST} END", "trigger_object": f"nullif(regexp_extract({_LAST}, ' on (\\w+)', 1), '')"})
_handler("parsed_jobs", "'QUEUEABLE_JOB'", {"class_name": "g[1]"})


@register(f"WITH {_TOKENS} SELECT log_id, type, count(*) AS n, min(id) AS first_id FROM ev GROUP BY 1, 2")
def parsed_types(spark, sf):
    return _parsed(spark, sf).groupBy("log_id", "type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@register(f"WITH {_TOKENS} SELECT log_id, count(*) FILTER (type = 'QUEUEABLE_JOB') AS n_jobs, count(*) FILTER (type = 'QUEUEABLE_JOB') > 0 AS has_jobs FROM ev GROUP BY 1")
def async_job_counts(spark, sf):
    return correlation.count_jobs(_parsed(spark, sf))


_MARKED = Inline("m", "log_id string, id long, type string, class_name string, method_name string, message string, timestamp long, line_number long", [
    ("a", 1, "CONSTRUCTOR_ENTRY", "OrderJob", "<init>", None, 10, 1), ("a", 2, "METHOD_ENTRY", "System", "enqueueJob(o)", None, 20, 2), ("a", 3, "USER_DEBUG", None, None, "id 707AB0000012345 queued", 30, 3), ("a", 4, "METHOD_ENTRY", "Database", "executeBatch(b)", None, 40, 4),
    ("b", 1, "METHOD_ENTRY", "System", "schedule(x)", None, 5, 1), ("b", 2, "FUTURE_CALL", "Later", None, None, 6, 2), ("b", 3, "USER_DEBUG", None, None, "nothing", 7, 3), ("c", 1, "METHOD_ENTRY", "A", "b", None, 1, 1),
])


@register(rf"""WITH {_MARKED.logged_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY id) AS r, CASE WHEN type = 'FUTURE_CALL' THEN 'FUTURE' WHEN type = 'METHOD_ENTRY' THEN CASE WHEN class_name || '.' || method_name ILIKE '%System.enqueueJob%' THEN 'QUEUEABLE' WHEN class_name || '.' || method_name ILIKE '%Database.executeBatch%' THEN 'BATCH' WHEN class_name || '.' || method_name ILIKE '%System.schedule%' THEN 'SCHEDULABLE' END END AS job_type FROM m),
n AS (SELECT *, count(job_type) OVER (PARTITION BY log_id ORDER BY id) AS job FROM k)
SELECT log_id, id, job_type, CASE WHEN type = 'FUTURE_CALL' THEN class_name ELSE coalesce((SELECT arg_min(c.class_name, c.id) FROM k c WHERE c.log_id = n.log_id AND c.r BETWEEN n.r - 10 AND n.r + 9 AND c.type IN ('CONSTRUCTOR_ENTRY', 'METHOD_ENTRY') AND regexp_matches(c.class_name, '(?i)job|queueable|batch|schedul|async|future')), 'Unknown') END AS class_name,
timestamp AS enqueued_at, line_number, (SELECT arg_min(regexp_extract(s.message, '\b(707[a-zA-Z0-9]{{12,15}})\b', 1), s.id) FROM n s WHERE s.log_id = n.log_id AND s.job = n.job AND s.type = 'USER_DEBUG' AND contains(s.message, '707')) AS job_id FROM n WHERE job_type IS NOT NULL""")
def extracted_jobs(spark, sf):
    return correlation.extract_jobs(_MARKED.logged(spark, sf))


_SHOWN = Inline("t", "id long, text string", [(1, "mail a.b@c.org now"), (2, "call 555-123-4567 or 5551234567"), (3, "id 001000000000001AAA and 001000000000001"), (4, "card 1234 5678 9012 3456"), (5, "ssn 123-45-6789"), (6, "host 10.0.0.1"), (7, "sessionId=abc-1 SESSIONID: 'x'"), (8, "api_key: \"k\" Bearer=zz access_token=1"), (9, "plain"), (10, None)])
_SHOWN_SQL = "text"
for _p, _f in (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "g"), (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "g"), (r"\b[a-zA-Z0-9]{15}([a-zA-Z0-9]{3})?\b", "g"), (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "g"), (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "g"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "g"), (r"""\bsessionId[=:]\s*[''"]?[\w-]+[''"]?""", "gi"), (r"""\b(access_?token|bearer|api_?key)[=:]\s*[''"]?[\w-]+[''"]?""", "gi"),
):
    _SHOWN_SQL = f"regexp_replace({_SHOWN_SQL}, '{_p}', '[REDACTED]', '{_f}')"


@register(f"SELECT conv_id, turn, {_SHOWN_SQL} AS text FROM conversations")
def redact_written(spark, sf):
    return privacy.redact_output(table(spark, sf, "conversations").select("conv_id", "turn", "text"))


_SPACES = Inline("n", "namespace string", [("SBQQ",), ("pse",), ("other{i}",), ("",), (None,)])


@register(f"WITH {_SPACES.dealt_sql} SELECT event_id, namespace, coalesce(namespace <> '', false) AS is_managed, coalesce(namespace, '') = '' AS can_modify, CASE namespace WHEN 'SBQQ' THEN 'platform' WHEN 'pse' THEN 'Certinia' END AS vendor, CASE namespace WHEN 'SBQQ' THEN 'CPQ (Steelbrick)' WHEN 'pse' THEN 'Professional Services Automation' END AS product FROM n")
def code_owner(spark, sf):
    return _SPACES.dealt(spark, sf).select("event_id", "namespace", namespaces.code_attribution(F.col("namespace")).alias("a")).select("event_id", "namespace", "a.*")


_CLOSED = Inline("e", "log_id string, id long, type string, class_name string, method_name string", [
    ("a", 1, "EXECUTION_STARTED", None, None), ("a", 2, "METHOD_ENTRY", "A", "f"), ("a", 3, "METHOD_ENTRY", "A", "g"), ("a", 4, "METHOD_EXIT", "A", "g"), ("a", 5, "METHOD_ENTRY", "A", "f"), ("a", 6, "METHOD_EXIT", "A", "f"), ("a", 7, "METHOD_EXIT", "B", "f"),
    ("a", 8, "SOQL_EXECUTE_BEGIN", None, None), ("a", 9, "SOQL_EXECUTE_END", None, None), ("a", 10, "EXECUTION_FINISHED", None, None), ("b", 1, "DML_END", None, None), ("b", 2, "SYSTEM_MODE_ENTER", None, None), ("b", 3, "SYSTEM_MODE_EXIT", None, None), ("b", 4, "USER_DEBUG", None, None),
])


@register(f"""WITH {_CLOSED.logged_sql()}, k(x, n) AS (VALUES ('METHOD_EXIT', 'METHOD_ENTRY'), ('SOQL_EXECUTE_END', 'SOQL_EXECUTE_BEGIN'), ('DML_END', 'DML_BEGIN'), ('EXECUTION_FINISHED', 'EXECUTION_STARTED'), ('SYSTEM_MODE_EXIT', 'SYSTEM_MODE_ENTER'))
SELECT o.log_id, o.id, min(i.id) AS entry_id FROM e o JOIN k ON k.x = o.type JOIN e i ON i.log_id = o.log_id AND i.type = k.n AND (o.type <> 'METHOD_EXIT' OR (i.class_name = o.class_name AND i.method_name = o.method_name)) GROUP BY 1, 2""")
def entry_of_exit(spark, sf):
    return tree.matching_entries(_CLOSED.logged(spark, sf))


_CUTS = Inline("c", "log_id long, cut boolean, severity string, kind string, lost string", [(1, False, "NONE", "NONE", ""), (2, True, "CRITICAL", "SIZE_LIMIT", "EXCEPTION_DETAILS,FINAL_LIMITS"), (3, True, "MODERATE", "TIMEOUT", "PERFORMANCE_DATA"), (4, True, "SEVERE", "SIZE_LIMIT", "ASYNC_CORRELATIONS"), (5, True, "NONE", "UNKNOWN", "FINAL_LIMITS"), (6, True, "MINOR", "UNKNOWN", "")])


@register(f"""WITH {_CUTS.logged_sql('event_id')} SELECT log_id, w OR (severity <> 'CRITICAL' AND NOT contains(lost, 'EXCEPTION_DETAILS')) AS issues, w OR NOT contains(lost, 'PERFORMANCE_DATA') AS performance, w OR NOT contains(lost, 'FINAL_LIMITS') AS limits, w OR NOT contains(lost, 'ASYNC_CORRELATIONS') AS jobs,
CASE WHEN w THEN '' ELSE concat_ws(',', CASE WHEN kind = 'SIZE_LIMIT' THEN 'Reduce Debug Levels' END, 'Split Operation', 'Targeted Trace Flags', CASE WHEN severity IN ('CRITICAL', 'SEVERE') THEN 'Request Extended Logging' END) END AS strategies FROM (SELECT *, NOT cut OR severity = 'NONE' AS w FROM c)""")
def truncation_impact(spark, sf):
    c = _CUTS.logged(spark, sf, "event_id").withColumn("lost", F.split("lost", ","))
    return c.select("log_id", truncation.impact(F.col("cut"), F.col("severity"), F.col("lost")).alias("i"), F.array_join(truncation.recovery_strategies(F.col("cut"), F.col("severity"), F.col("kind")), ",").alias("strategies")).select("log_id", "i.*", "strategies")


_SUSPECTS = Inline("s", "log_id long, suspect string", [(i, x) for i, x in enumerate(("SOQL", "CPU", "TRIGGER", "CALLOUT", "FLOW", "GENERAL", "odd"))])
_BY_SUSPECT = "(VALUES " + ", ".join(f"('{s}', {n}, '{c}', '{v}')" for s, levels in truncation.SUSPECT_LEVELS.items() for n, (c, v) in enumerate((*truncation.BASE_LEVELS, *levels))) + ") AS v(s, n, category, level)"


@register(f"WITH {_SUSPECTS.logged_sql('event_id')} SELECT log_id, category, arg_max(level, n) AS level FROM s JOIN {_BY_SUSPECT} ON v.s = CASE WHEN suspect IN (SELECT DISTINCT s FROM {_BY_SUSPECT}) THEN suspect ELSE 'GENERAL' END GROUP BY 1, 2")
def levels_by_suspect(spark, sf):
    return truncation.optimized_levels(_SUSPECTS.logged(spark, sf, "event_id"))


@register(f"WITH {_TOKENS} SELECT id, type FROM ev WHERE log_id = '1' AND contains(type, 'METHOD') ORDER BY id LIMIT 2 OFFSET 1")
def command_page(spark, sf):
    return query.command_query(_parsed(spark, sf).where("log_id = '1'"), "method", offset=1, limit=2)[0].select("id", "type")


_HITS = Inline("h", "query_id long, fact_id long, by_code boolean", [(1, i, False) for i in range(12)] + [(1, 3, True), (1, 90, True), (2, 5, True)])
_NEAR = Inline("m", "query_id long, place int", [(1, 1), (1, 2), (3, 1)])
_EPISODES = Inline("ep", "query_id long, place int", [(2, 1), (2, 2)])
_FIXES = Inline("so", "query_id long, place int, success_count long, failure_count long", [(1, 1, 3, 1), (1, 2, 1, 0), (1, 3, 1, 4), (4, 1, 0, 0)])
#: Sixteen events are what four requests find.
_RECALLED = ", ".join(f"{t.grouped_sql(16).replace(f' {t.name} AS (', f' {t.name}0 AS (')}, {t.name} AS (SELECT grp * 10 + query_id AS query_id, * EXCLUDE (event_id, grp, v, query_id) FROM {t.name}0)" for t in (_HITS, _NEAR, _EPISODES, _FIXES))


@register(f"""WITH {_RECALLED}, f AS (SELECT query_id, fact_id FROM (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS r FROM (SELECT DISTINCT query_id, fact_id FROM h WHERE NOT by_code)) WHERE r <= 10 UNION SELECT query_id, fact_id FROM h WHERE by_code),
a AS (SELECT query_id, count(*) AS n_facts, 0 AS n_matches, 0 AS n_episodes, 0 AS n_solutions FROM f GROUP BY 1 UNION ALL SELECT query_id, 0, least(10, count(*)), 0, 0 FROM m GROUP BY 1 UNION ALL SELECT query_id, 0, 0, least(10, count(*)), 0 FROM ep GROUP BY 1
UNION ALL SELECT query_id, 0, 0, 0, least(10, count(*)) FROM so WHERE success_count + failure_count >= 2 AND success_count / (success_count + failure_count) >= 0.5 GROUP BY 1)
SELECT query_id, sum(n_facts)::BIGINT AS n_facts, sum(n_matches)::BIGINT AS n_matches, sum(n_episodes)::BIGINT AS n_episodes, sum(n_solutions)::BIGINT AS n_solutions, round(least(1, sum(n_facts + n_matches + n_episodes + n_solutions) / 10.0), 4)::DOUBLE AS confidence FROM a GROUP BY 1""")
def recall_confidence(spark, sf):
    found = (t.grouped(spark, sf, 16).withColumn("query_id", F.col("grp") * 10 + F.col("query_id")).drop("event_id", "grp", "v") for t in (_HITS, _NEAR, _EPISODES, _FIXES))
    return memory.recall(*found).withColumn("confidence", rounded(F.col("confidence")))
