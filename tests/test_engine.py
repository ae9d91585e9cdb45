import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import correlation, detect, memory, namespaces, privacy, query, render, scoring, tree, truncation
from logloom.plans.analyze import analyze, detect_issues, log_status, parse_logs
from logloom.sources import sinks

LOOP = """60.0 APEX_CODE,FINEST;DB,INFO
09:00:00.100 (100000000)|EXECUTION_STARTED
09:00:00.101 (101000000)|CODE_UNIT_STARTED|[EXTERNAL]|01q000000000001|OrderTrigger on Order
09:00:00.102 (102000000)|METHOD_ENTRY|[10]|OrderService.load
09:00:00.103 (103000000)|SOQL_EXECUTE_BEGIN|[12]|Aggregations:0|SELECT Id FROM Item__c WHERE Parent__c = :p
09:00:00.105 (105000000)|SOQL_EXECUTE_END|[12]|Rows:1
09:00:00.108 (108000000)|SOQL_EXECUTE_BEGIN|[12]|Aggregations:0|SELECT Id FROM Item__c WHERE Parent__c = :p
09:00:00.110 (110000000)|SOQL_EXECUTE_END|[12]|Rows:1
09:00:00.113 (113000000)|SOQL_EXECUTE_BEGIN|[12]|Aggregations:0|SELECT Id FROM Item__c WHERE Parent__c = :p
09:00:00.115 (115000000)|SOQL_EXECUTE_END|[12]|Rows:1
09:00:00.182 (182000000)|METHOD_EXIT|[10]|OrderService.load
09:00:00.183 (183000000)|CODE_UNIT_FINISHED|OrderTrigger on Order
09:00:00.184 (184000000)|EXECUTION_FINISHED"""
LIMITS = """60.0 SYSTEM,INFO
09:00:00.000 (1000)|EXECUTION_STARTED
09:00:00.001 (2000)|LIMIT_USAGE|Number of SOQL queries: 85 out of 100
09:00:00.002 (3000)|LIMIT_USAGE_FOR_NS|pkg|Number of SOQL queries: 31 out of 100
09:00:00.003 (4000)|EXECUTION_FINISHED"""
PACKAGE = """09:00:00.000 (1000)|EXECUTION_STARTED
09:00:00.000 (2000)|ENTERING_MANAGED_PKG|pkg
09:00:00.000 (3000)|METHOD_ENTRY|[1]|A.f
09:00:00.000 (4000)|METHOD_EXIT|[1]|A.f
09:00:00.000 (5000)|EXECUTION_FINISHED"""
FAILED = """09:00:00.000 (1000)|EXECUTION_STARTED
09:00:00.000 (2000)|EXCEPTION_THROWN|[5]|System.NullPointerException: Attempt to de-reference a null object
09:00:00.000 (3000)|FATAL_ERROR|System.NullPointerException: Attempt to de-reference a null object"""
CUMULATIVE = """09:00:00.000 (1000)|EXECUTION_STARTED
09:00:00.001 (2000)|CUMULATIVE_LIMIT_USAGE
  Number of SOQL queries: 95 out of 100
  Maximum CPU time: 10 out of 10000
09:00:00.003 (4000)|CUMULATIVE_LIMIT_USAGE_END
09:00:00.003 (5000)|EXECUTION_FINISHED"""
ONE_PER_ROW = "\n".join(
    ["09:00:00.000 (1000000)|EXECUTION_STARTED", "09:00:00.000 (2000000)|SOQL_EXECUTE_BEGIN|[1]|Aggregations:0|SELECT Id FROM Account WHERE Name = 'x'", "09:00:00.000 (3000000)|SOQL_EXECUTE_END|[1]|Rows:5"]
    + [x for i in range(5) for x in (f"09:00:00.000 ({4000000 + i * 2000000})|SOQL_EXECUTE_BEGIN|[2]|Aggregations:0|SELECT Id FROM Contact WHERE AccountId = '{i}'", f"09:00:00.000 ({5000000 + i * 2000000})|SOQL_EXECUTE_END|[2]|Rows:1")]
    + ["09:00:00.000 (90000000)|EXECUTION_FINISHED"]
)
RECURSIVE = "\n".join(
    [f"09:00:00.000 ({i + 1}000)|{x}" for i, x in enumerate(y for _ in range(5) for y in ("CODE_UNIT_STARTED|[EXTERNAL]|01q000000000001|AccTrigger on Account", "DML_BEGIN|[3]|Op:Update|Type:Account|Rows:2"))]
    + [f"09:00:01.000 ({i + 20}000)|{x}" for i, x in enumerate(y for _ in range(5) for y in ("DML_END|[3]", "CODE_UNIT_FINISHED|AccTrigger on Account"))]
)


@pytest.fixture(scope="module")
def parsed(spark):
    logs = [("loop", LOOP), ("limits", LIMITS), ("package", PACKAGE), ("failed", FAILED), ("cumulative", CUMULATIVE), ("nplus", ONE_PER_ROW), ("recursive", RECURSIVE), ("empty", ""), ("noise", "nothing\nhere")]
    return parse_logs(spark.createDataFrame(logs, "log_id string, content string"))


def rows(df, log, *cols):
    return [tuple(r[c] for c in cols) for r in df.where(F.col("log_id") == log).orderBy("id").collect()]


def test_loop_log_tree(parsed):
    got = rows(parsed.tree, "loop", "id", "parent_id", "duration")
    assert [g[1] for g in got] == [0, 1, 2, 3, 4, 3, 6, 3, 8, 3, 2, 1]
    assert {g[0]: g[2] for g in got if g[2]} == {1: 84_000_000, 2: 82_000_000, 3: 80_000_000, 4: 2_000_000, 6: 2_000_000, 8: 2_000_000}
    unit = parsed.events.where("log_id = 'loop' and id = 2").first()
    assert (unit.unit_type, unit.unit_name, unit.trigger_object) == ("Trigger", "OrderTrigger", "Order")
    head = parsed.headers.where("log_id = 'loop'").first()
    assert head.api_version == "60.0" and head.debug_levels == {"APEX_CODE": "FINEST", "DB": "INFO"}
    stats = parsed.stats.where("log_id = 'loop'").first()
    assert (stats.total_lines, stats.n_events, stats.failed_lines) == (13, 12, 1)


def test_loop_log_issues(parsed):
    issues = detect_issues(parsed)
    got = {(r.type, r.severity, round(r.confidence, 4), r.occurrences) for r in issues.where("log_id = 'loop'").collect()}
    assert got == {("CPU_HOTSPOT", "HIGH", 0.9, 1), ("SOQL_IN_LOOP", "MEDIUM", 0.8, 3)}
    _, summary = analyze(parsed)
    by_log = {r.log_id: r for r in summary.collect()}
    assert by_log["loop"].health == 80 and by_log["loop"].one_liner == "Mostly healthy - 1 critical/high priority issue - primary: performance"
    assert by_log["loop"].n_found == 1 and by_log["loop"].truncation_severity == "CRITICAL"  # its last line has no end
    assert by_log["limits"].health == 86 and by_log["empty"].health == 100


def test_limits(parsed):
    got = {(r.type, r.severity, r.namespace, round(r.confidence, 3)) for r in detect_issues(parsed, ("governor_limits",)).where("log_id = 'limits'").collect()}
    assert got == {("SOQL_LIMIT_NEAR", "MEDIUM", None, 0.95), ("MANAGED_PACKAGE_ERROR", "MEDIUM", "pkg", 0.85)}
    cumulative = detect_issues(parsed, ("governor_limits",)).where("log_id = 'cumulative'").collect()
    assert [(r.type, r.severity) for r in cumulative] == [("SOQL_LIMIT_NEAR", "HIGH")]


def test_package_shifts_nesting(parsed):
    got = rows(parsed.tree, "package", "parent_id", "duration")
    assert [g[0] for g in got] == [0, 1, 2, 3, 2] and got[1][1] == 3000 and got[0][1] is None


def test_failed_log(parsed):
    e = parsed.events.where("log_id = 'failed' and id = 2").first()
    assert e.exception_type == "System.NullPointerException"
    j = truncation.judge(truncation.indicators(parsed.logs, parsed.events)).where("log_id = 'failed'").first()
    assert (j.ABRUPT_ENDING, j.MISSING_LIMITS, j.INCOMPLETE_STACKTRACE, j.MID_LINE_CUT, j.truncation_severity) == (True, True, True, True, "CRITICAL")


def test_one_query_per_row_and_recursion(parsed):
    issues = detect_issues(parsed).collect()
    assert [(r.title, r.occurrences, round(r.confidence, 2)) for r in issues if r.type == "N_PLUS_ONE"] == [("Account -> Contact", 5, 1.0)]
    direct = [r for r in issues if r.type == "RECURSIVE_TRIGGER" and r.log_id == "recursive"]
    assert direct and direct[0].severity == "CRITICAL" and direct[0].occurrences == 5


def test_status(parsed):
    assert {r.log_id: r.status for r in log_status(parsed).collect() if r.status != "PARSED"} == {"empty": "EMPTY_LOG", "noise": "INVALID_FORMAT"}


def test_tree_equals_a_stack(spark):
    rng = random.Random(1)
    data = []
    for log in range(12):
        at = 0
        for i in range(1, 200):
            at += rng.randint(0, 2)
            data.append((f"l{log}", i, rng.choice(["METHOD_ENTRY", "METHOD_EXIT", "USER_DEBUG"]), at))
    got = {(r.log_id, r.id): (r.parent_id, r.duration) for r in tree.call_tree(spark.createDataFrame(data, "log_id string, id long, type string, timestamp long")).collect()}
    stacks, want, when = {}, {}, {(log, i): t for log, i, _, t in data}
    for log, i, kind, at in data:
        stack = stacks.setdefault(log, [0])
        want[log, i] = [stack[-1], None]
        if kind == "METHOD_ENTRY":
            stack.append(i)
        elif kind == "METHOD_EXIT" and len(stack) > 1:
            top = stack.pop()
            if at > when[log, top]:
                want[log, top][1] = at - when[log, top]
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("line,want", [
    ("09:00:00.100 (100)|METHOD_ENTRY|[5]|Rows:1||x", ("METHOD_ENTRY", 100, ["[5]", "Rows:1", "x"])),
    ("09:00:00.100 (7)|SOMETHING_ELSE", ("UNKNOWN", 7, [])),
    ("09:00:00.100 (7)|USER_DEBUG[1]|a\r", ("USER_DEBUG", 7, ["a"])),
    ("60.0 APEX_CODE,FINEST", None), ("", None), ("garbage", None), ("1 garbage (x)|A", None),
])
def test_tokenize(spark, line, want):
    t = spark.createDataFrame([(line,)], "v string").select(T.tokenize_line(F.col("v")).alias("t")).first().t
    assert (None if t is None else (t.event_type, t.timestamp, t.segments)) == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.normalize_query(F.lit("select id  from T where n = 12 and s='x'"))) == "SELECT ID FROM T WHERE N = ? AND S='?'"
    assert one(T.hash31(F.lit("the quick brown"))) == 1015422996
    assert one(F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(privacy.redact(F.lit("From a@x.com to b@y.org"))) == "From [EMAIL] to [EMAIL]"
    assert one(privacy.redact_numbered()(F.lit("From a@x.com to b@y.org"))) == "From [EMAIL_1] to [EMAIL]"
    assert one(privacy.text_sensitivity(F.lit("ssn 123-45-6789"))) == "CRITICAL" and one(privacy.field_sensitivity(F.lit("user_email"))) == "HIGH"
    assert one(T.format_duration(F.lit(1_500_000))) == "1.50ms"
    key = memory.derive_key("phrase", b"salt", 10)
    assert one(memory.decrypt(memory.encrypt(F.lit("secret"), key), key)) == "secret"


def test_correlation_confidence(spark):
    e = spark.createDataFrame([(1, "CLASS_NAME", 0.7), (1, "TIMING", 0.9), (2, "TIMING", 0.7)], "k int, reason string, confidence double")
    got = {r.k: round(r.confidence, 4) for r in correlation.combined_confidence(e, ["k"]).collect()}
    assert got == {1: 0.8223, 2: 0.55}


def test_semantic_score(spark):
    sig = lambda objects: ("SOQL", None, objects, [], [], [], [])
    kind = "struct<issue_type:string,error_signature:int,objects:array<string>,namespaces:array<string>,methods:array<string>,queries:array<string>,limits:array<string>>"
    q = spark.createDataFrame([(1, sig(["a", "b"]))], f"query_id int, signature {kind}")
    e = spark.createDataFrame([(2, sig(["a", "c"]))], f"entry_id int, signature {kind}")
    assert round(memory.find_similar(q, e).first().score, 4) == 0.8824


def test_query_engine(parsed):
    f = query.EventFilter(types=("SOQL_EXECUTE_BEGIN",), text="item__c", min_duration=1.0)
    assert query.query_events(parsed.tree, f).count() == 3
    leaves = query.query_events(parsed.tree.where("log_id = 'loop'"), query.EventFilter(has_children=False))
    assert {r.id for r in leaves.collect()} == {5, 7, 9, 10, 11, 12}
    page, total = query.paginate(parsed.tree.where("log_id = 'loop'"), 2, 5, ("duration", True))
    assert [r.id for r in page.collect()] == [8, 5, 7, 9, 10] and total.first().total_pages == 3
    assert {r.id for r in query.near_lines(parsed.tree, parsed.tree.where("log_id = 'loop' and id = 5"), 2).collect()} == {3, 4, 5, 6, 7}
    assert query.query_issues(detect_issues(parsed), query.IssueFilter(min_severity="HIGH", text="order")).count() == 1


def test_render_and_sinks(parsed, spark, tmp_path):
    text = render.render_tree(parsed.tree, "loop")
    assert text.splitlines()[3].startswith("      SOQL_EXECUTE_BEGIN (2.00ms)")
    issues, _ = analyze(parsed)
    assert "SOQL_IN_LOOP" in render.markdown_issues(issues.where("log_id = 'loop'"))
    sinks.write_json_lines({"header": parsed.headers, "event": parsed.events, "issue": issues}, str(tmp_path / "out"))
    back = sinks.read_json_lines(spark, str(tmp_path / "out"), "event", "id long, type string")
    assert back.count() == parsed.events.count()


def test_levels_and_namespaces(parsed, spark):
    levels = truncation.infer_levels(parsed.events, truncation.implied_levels(spark))
    assert {r.category: r.level for r in levels.where("log_id = 'loop'").collect()} == {"Apex_code": "FINE", "Database": "INFO"}
    score = truncation.capability_score(truncation.capabilities(levels)).where("log_id = 'loop'").first().capability_score
    assert 0 < score < 100
    assert [r.namespace for r in namespaces.detect_namespaces(parsed.events).where("log_id = 'package'").collect()] == ["pkg"]
    assert namespaces.crossings(parsed.events).where("log_id = 'package'").count() >= 1
    issues = detect_issues(parsed)
    placed = namespaces.attribute_issues(issues, parsed.events).where("log_id = 'loop'").join(issues.select("log_id", "det_seq", "type"), ["log_id", "det_seq"])
    # a method of at most five letters (load) counts as obfuscated, which outweighs that no package is seen
    assert {(r.type, r.attribution) for r in placed.collect()} == {("SOQL_IN_LOOP", "USER_CODE"), ("CPU_HOTSPOT", "UNKNOWN")}


def test_unfixed_profile(spark):
    p = parse_logs(spark.createDataFrame([("c", CUMULATIVE), ("n", ONE_PER_ROW)], "log_id string, content string"), fixed=False)
    assert detect_issues(p, ("governor_limits", "n_plus_one")).count() == 0


def test_detectors_take_empty_input(spark):
    p = parse_logs(spark.createDataFrame([], "log_id string, content string"))
    assert analyze(p)[0].count() == 0 and detect.DETECTORS and scoring.WEIGHTS


def test_word_bounds_are_ascii(spark):
    rows = [(1, "x ñabcdefghijklmno, ä555-123-4567ß"), (2, "xñabcdefghijklmnop"), (3, "é1.2.3.4 a.b@c.deü")]
    df = spark.createDataFrame(rows, "id int, text string").select("id", "text", F.struct("text").alias("s"))
    want = {1: "x ñ[REDACTED], ä[REDACTED]ß", 2: "xñabcdefghijklmnop", 3: "é[REDACTED] [REDACTED]ü"}
    assert {r.id: (r.text, r.s.text) for r in privacy.redact_output(df).collect()} == {k: (v, v) for k, v in want.items()}
    assert [r.t for r in df.orderBy("id").select(privacy.redact(F.col("text")).alias("t")).collect()] == ["x ñabcdefghijklmno, ä[PHONE]ß", rows[1][1], "é[IP] [EMAIL]ü"]
    assert [(r.id, r.kind) for r in privacy.pii_positions(df, "id", "text").orderBy("id", "kind").collect()] == [("1", "phone"), ("1", "record_id"), ("3", "email"), ("3", "ip_address")]
    assert [r.t for r in spark.createDataFrame([("é12é 3",), ("ñabcdefghijklmno",)], "q string").select(T.normalize_query(F.col("q")).alias("t")).collect()][0] == "É?É ?"
