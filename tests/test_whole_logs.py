import json
import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import calls, summary, unified
from logloom.streaming import sessions


def stack_calls(rows):
    """rows of one log: (id, opens, name, at); the search from the top, one event at a time."""
    stack, out = [], []
    for i, opens, name, at in rows:
        if opens:
            stack.append([i, name, at, 0.0])
            continue
        place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name), None)
        if place is None:
            continue
        entry = stack.pop(place)
        span = float(at - entry[2])
        out.append((entry[0], i, name, span, max(0.0, span - entry[3]), stack[-1][0] if stack else None))
        if stack:
            stack[-1][3] += span
    return out


@pytest.mark.parametrize("names,opens", [(1, 0.5), (3, 0.5), (40, 0.55), (5, 0.9)])
def test_calls_equal_a_searched_stack(spark, names, opens):
    rng, rows, want = random.Random(names), [], []
    for log in range(4):
        at, mine = 0, []
        for i in range(1, 900 if log else 3):
            at += rng.randint(0, 5)
            mine.append((i, rng.random() < opens, f"n{rng.randrange(names)}", at))
        rows += [(log, i, "E" if o else "X", n, t) for i, o, n, t in mine]
        want += [(log, *r) for r in stack_calls(mine)]
    df = spark.createDataFrame(rows, "log_id int, id long, type string, name string, timestamp long").repartition(3)
    got = calls.signature_calls(df, F.col("name"), ("E",), ("X",))
    assert sorted((r.log_id, r.id, r.close_id, r.method, r.inclusive, r.exclusive, r.parent_id) for r in got.collect()) == sorted(want)


def test_calls_with_own_durations_and_none(spark):
    rows = [("a", 1, "METHOD_ENTRY", "C", "f", 10, None), ("a", 2, "METHOD_ENTRY", "C", None, 12, None), ("a", 3, "METHOD_EXIT", "C", "f", 20, 3), ("a", 4, "METHOD_EXIT", "C", None, 30, None), ("a", 5, "METHOD_EXIT", "C", "g", 31, None)]
    df = spark.createDataFrame(rows, "log_id string, id long, type string, class_name string, method_name string, timestamp long, duration long")
    got = sorted(tuple(r) for r in calls.signature_calls(df).collect())
    assert got == [("a", 1, 3, "C.f", 3.0, 3.0, 2), ("a", 2, 4, "C.Unknown", 18.0, 15.0, None)]
    assert calls.signature_calls(df.where("id > 9")).count() == 0


def test_forest_cuts_circles_and_chooses_parents(spark):
    link = lambda a, b, c=0.5: (a, b, c)
    rows = [link(1, 2), link(2, 3), link(3, 4), link(9, 4, 0.4), link(7, 7), link(5, 6), link(6, 8), link(8, 5), link(8, 10), link(10, 11), link(12, None)]
    rows += [link(100 + i, 101 + i) for i in range(50)]
    links = spark.createDataFrame(rows, "log_id long, child_id long, confidence double")
    logs = spark.createDataFrame([(20,), (1,)], "log_id long")
    got = {r.log_id: (r.root_id, r.depth, r.role) for r in unified.forest(logs, links).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(1, 0, "PARENT"), (1, 1, "CHILD"), (1, 2, "GRANDCHILD"), (1, 3, "GRANDCHILD")]
    assert got[9] == (9, 0, "PARENT") and got[7][0] == 7 and got[20][0] == 20 and got[12][0] == 12
    # 5 -> 6 -> 8 -> 5 is cut before its smallest
    assert [got[i][:2] for i in (5, 6, 8, 10, 11)] == [(5, 0), (5, 1), (5, 2), (5, 3), (5, 4)]
    assert all(got[100 + i][:2] == (100, i) for i in range(51))


def test_roll_up(spark):
    logs = spark.createDataFrame([(1, 0, 5_000_000, 0.8), (2, 0, 1_000_000, 1.0), (3, None, None, None)], "log_id long, start_ns long, end_ns long, extraction double")
    links = [(1, "BATCH", "FAILED", 2, 10, 2, 0.6), (1, "QUEUEABLE", "COMPLETED", None, None, None, 0.2), (2, "FUTURE", "ABORTED", 3, 5, 0, 1.0)]
    df = spark.createDataFrame(links, "log_id long, job_type string, job_status string, child_id long, queue_delay_ms long, errors long, confidence double")
    (r,) = unified.unified_summaries(logs, df).collect()
    assert (r.root_id, r.n_logs, r.depth, r.total_ms, r.n_jobs, r.failed, r.aborted, r.completed, r.errors, r.status) == (1, 3, 2, 21.0, 3, 1, 1, 1, 2, "PARTIAL_FAILURE")
    assert math.isclose(r.confidence, (0.8 + 0.6) / 2 - 0.1)
    assert r.flow == "Parent execution enqueued 1 Queueable job(s), 1 Batch job(s), 1 @future method(s) → 2/3 correlated to child logs"
    alone = unified.unified_summaries(logs.where("log_id = 1"), df.where("log_id > 5")).first()
    assert (alone.status, alone.flow, alone.confidence) == ("SUCCESS", "Synchronous execution (no async jobs)", 0.8)


def js_tokens(x):
    def whole(v):
        return int(v) if isinstance(v, float) and v == int(v) else v

    def walk(v):
        return {k: walk(w) for k, w in v.items() if w is not None} if isinstance(v, dict) else [walk(w) for w in v] if isinstance(v, list) else whole(v)

    text = json.dumps(walk(x), ensure_ascii=False, separators=(",", ":"))
    return math.ceil(len(text.encode("utf-16-be")) / 2 / 3.5)


def trimmed(s, budget=500):
    """The loop: one element at a time, from the end of each list in turn."""
    s["tokenCount"] = 0
    s["tokenCount"] = js_tokens(s)
    if s["tokenCount"] > budget:
        for name, least in (("recommendations", 2), ("limitWarnings", 1), ("topIssues", 1)):
            while len(s[name]) > least and js_tokens(s) > budget:
                s[name].pop()
        if js_tokens(s) > budget:
            s["aiContext"]["limitations"] = s["aiContext"]["limitations"][:1]
        s["tokenCount"] = js_tokens(s)
    return s


def test_summaries_are_trimmed_like_in_a_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    text = lambda n: "".join(rng.choice('ab "\\é🔴\n') for _ in range(n))
    for i in range(120):
        top = 40 if i % 3 else 300
        issues = [{"type": text(12), "desc": text(60), "sev": "H", "fixable": rng.random() < 0.5} for _ in range(rng.randint(0, 3))]
        warnings, advice, limits = [text(rng.randint(0, 90)) for _ in range(rng.randint(0, 3))], [text(rng.randint(0, top)) for _ in range(rng.randint(0, 5))], [text(rng.randint(0, 400)) for _ in range(rng.randint(0, 3))]
        context = {"truncated": i % 2 == 0, "truncationWarning": text(20) if i % 2 == 0 else None, "namespaces": [text(3)], "confidence": rng.choice([1.0, 0.85, 0.0])}
        metrics = {"events": i * 100, "issues": len(issues), "cpuTimeMs": None if i % 2 else 77}
        rows.append((f"log{i}", i, "Good - 1 issue detected", tuple(metrics.values()), [tuple(x.values()) for x in issues], warnings, advice, tuple(context.values()), limits))
        want[f"log{i}"] = trimmed({"logId": f"log{i}", "health": i, "status": "Good - 1 issue detected", "metrics": metrics, "topIssues": issues, "limitWarnings": list(warnings), "recommendations": list(advice), "aiContext": {**context, "limitations": list(limits)}})
    schema = f"log_id string, health long, status string, metrics struct<events:long,issues:long,cpuTimeMs:long>, topIssues {summary.ISSUE}, limitWarnings array<string>, recommendations array<string>, context struct<truncated:boolean,truncationWarning:string,namespaces:array<string>,confidence:double>, limitations array<string>"
    over = 0
    for r in summary.fit_budget(spark.createDataFrame(rows, schema)).collect():
        w = want[r.log_id]
        over += r.token_count < js_tokens({**w, "recommendations": w["recommendations"] + ["x" * 2000]})
        assert (r.token_count, r.n_recommendations, r.n_warnings, r.n_issues, r.n_limitations) == (w["tokenCount"], len(w["recommendations"]), len(w["limitWarnings"]), len(w["topIssues"]), len(w["aiContext"]["limitations"]))
        assert json.loads(r.summary)["recommendations"] == w["recommendations"] and '"confidence":1.0' not in r.summary
    assert any(w["tokenCount"] < 500 and len(w["recommendations"]) == 2 for w in want.values())
    nulls = summary.fit_budget(spark.createDataFrame([("x", 100, "s", None, None, None, None, (False, None, [], 1.0), None)], schema)).first()
    assert nulls.n_issues == nulls.n_recommendations == 0 and nulls.token_count < 100


def test_streams_equal_batches_and_survive_restarts(spark):
    rng = random.Random(2)
    items = []
    for i in range(160):
        t = 1_700_000_000 + i * 997
        items.append((f"l{rng.randrange(4)}", t, i, rng.choice(["SOQL_EXECUTE_BEGIN", "DML_BEGIN", "FATAL_ERROR", "METHOD_ENTRY"]), rng.choice([None, "", "a", "b"]), rng.choice([None, "HIGH", "LOW"]), "t" * (i % 80)))
    df = spark.createDataFrame(items, "log_id string, t long, id long, type string, namespace string, severity string, title string").select("log_id", F.timestamp_seconds("t").alias("ts"), "id", "type", "namespace", "severity", "title")
    got = sessions.run_in_batches(df, F.floor(F.col("id") / 60).cast("int") + 1, 3, "ts", lambda s: sessions.stream_summaries(s, "2 hours"))
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    assert rows(got) == rows(sessions.session_summaries(df, "2 hours"))


def states_held(df, stream, path):
    """State rows after everything has arrived at once."""
    df.write.parquet(f"{path}/in")
    arriving = df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in").withWatermark("ts", "0 seconds")
    q = stream(arriving).writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress[0]["stateOperators"][0]["numRowsTotal"]


def test_summaries_of_many_logs_are_held_in_few_groups(spark, tmp_path):
    n = 3 * sessions.GROUPS
    log = F.when(F.col("id") % n > 0, F.concat(F.lit("l"), F.col("id") % n))  # one log has no name
    issue = F.when(F.col("id") % 2 == 0, "HIGH")
    df = spark.range(3 * n).select(log.alias("log_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), "id", F.lit("DML_BEGIN").alias("type"), F.lit("a").alias("namespace"), issue.alias("severity"), F.col("id").cast("string").alias("title"))
    got = sessions.run_in_batches(df, F.when(F.col("id") < n, 1).otherwise(2), 2, "ts", lambda s: sessions.stream_summaries(s, "20 minutes"))
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    assert rows(got) == rows(sessions.session_summaries(df, "20 minutes")) and got.count() == n
    assert states_held(df, lambda s: sessions.stream_summaries(s, "20 minutes"), tmp_path) <= sessions.GROUPS


def test_stream_parse_equals_batch(spark):
    rng, lines = random.Random(3), []
    for log in range(3):
        for n in range(1, 60 if log else 4):
            value = "61.0 APEX_CODE,FINE;" if n == 2 and log != 1 else rng.choice([f"09:00:00.000 ({n})|METHOD_ENTRY|[1]|A.f", f"09:00:00.000 ({n})|NO_SUCH|x", "words", f"09:00:00.000 ({n})|FATAL_ERROR|E: m"])
            lines.append((f"l{log}", 1_700_000_000 + n, n, value, min(2, 1 + n // 30)))
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "log_id string, t long, line_number long, value string, arrives int").select("log_id", F.timestamp_seconds("t").alias("ts"), "line_number", "value", "arrives")
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    bare = df.drop("arrives")
    number = (1 + F.floor(F.col("line_number") / 30)).cast("int")
    got = sessions.run_in_batches(bare, number, 2, "ts", lambda s: sessions.stream_records(s, "1 hour", 20))
    want = sessions.parse_records(bare, 20)
    assert rows(got) == rows(want)
    assert want.where("record = 'event'").groupBy("log_id").count().agg(F.max("count")).first()[0] == 20
    assert {json.loads(r.said).get("header") for r in want.where("record = 'metadata'").collect()} == {None, "61.0 APEX_CODE,FINE;"}


def test_parses_of_many_logs_are_held_in_few_groups(spark, tmp_path):
    n = 2 * sessions.GROUPS
    number = F.floor(F.col("id") / n) + 1
    # longs that no double holds, beside lines without a time
    value = F.when(number % 2 == 1, F.format_string("09:00:00.000 (%d)|METHOD_ENTRY|[1]|A.f", F.lit(2**53 + 1) + 2 * F.col("id"))).otherwise("words")
    df = spark.range(7 * n).select(F.concat(F.lit("l"), F.col("id") % n).alias("log_id"), F.timestamp_seconds(1_700_000_000 + number).alias("ts"), number.alias("line_number"), value.alias("value"))
    got = sessions.run_in_batches(df, F.when(F.col("line_number") < 4, 1).otherwise(2), 2, "ts", lambda s: sessions.stream_records(s, "1 hour", 3))
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    assert rows(got) == rows(sessions.parse_records(df, 3)) and got.count() == 5 * n
    assert states_held(df, lambda s: sessions.stream_records(s, "1 hour", 3), tmp_path) <= sessions.GROUPS


def test_lanes_by_a_walk(spark):
    """Branches forked and merged in one pass over the rows, as a reader would draw them."""
    from logloom.operators import lanes
    from logloom.operators.tree import call_tree

    rng, rows, want = random.Random(8), [], {}
    for log in range(4):
        stack, active, columns = [], {}, {}
        for i in range(1, 120 if log else 2):
            kind, name = rng.choice(["S", "S", "F", "M", "D"]), f"T{rng.randrange(4)}"
            rows.append((log, i, i, kind, name))
            around = next((columns[n] for k, n in reversed(stack) if k == "S"), 0)
            if kind == "S":
                columns.setdefault(name, len(columns) + 1)
                active[name] = True
                want[log, i] = (columns[name], True, False, 1 + sum(active.values()))
            elif kind == "F" and name in columns:
                want[log, i] = (columns[name], False, True, 1 + sum(active.values()))
                active[name] = False
            elif kind in "MD":
                want[log, i] = (around, False, False, 1 + sum(active.values()))
            if kind in "SM":
                stack.append((kind, name))
            elif kind == "F" and stack:
                stack.pop()
    df = spark.createDataFrame(rows, "log_id int, id long, timestamp long, type string, name string")
    tree = call_tree(df, ("S", "M"), ("F",))
    got = lanes.lanes(tree, F.when(F.col("type").isin("S", "F"), F.col("name")), F.col("type") == "S", F.col("type") == "F", F.col("type") == "F")
    assert {(r.log_id, r.id): (r.lane, r.is_start, r.is_end, r.n_open) for r in got.collect()} == want
    lines = {(r.log_id, r.id): r.line for r in lanes.lane_lines(got, F.lit("#"), F.lit("m")).collect()}
    assert len(lines) == len(want) and all(v.index("#") == 2 * want[k][0] and v.endswith("-- m") for k, v in lines.items())


def test_writes_to_a_store_one_by_one(spark):
    from logloom.operators import memory

    rng, rows, store, halves = random.Random(9), [], {}, []
    for o in range(400):
        op, key = rng.choices(["SET", "DELETE", "CLEAR"], [12, 4, 0.2])[0], f"k{rng.randrange(25)}"
        value, expires = f"v{o}", rng.choice([None, float(rng.randrange(100))])
        rows.append((op, key, value, expires, o))
        if op == "CLEAR":
            store.clear()
        elif op == "DELETE":
            store.pop(key, None)
        else:
            store[key] = (value, expires, store[key][2] if key in store else o, o)
        if o == 200:
            halves.append(dict(store))
    df = spark.createDataFrame(rows, "op string, key string, value string, expires_at double, at long")
    w = memory.kv_writes(df, *[F.col(c) for c in ("op", "key", "value", "expires_at", "at", "at")])
    state = lambda d: {r.key: (r.value, r.expires_at, r.created_at, r.updated_at) for r in memory.kv_state(d).collect()}
    assert state(w) == store and state(w.where("order <= 200")) == halves[0]
    # what is written behind a compacted log is read like behind the whole one
    assert state(memory.kv_compact(w.where("order <= 200")).unionByName(w.where("order > 200"))) == store
    live = {k: v for k, v in store.items() if v[1] is None or v[1] >= 50}
    assert state(memory.kv_compact(w, F.lit(50.0))) == live
    stats = memory.kv_stats(memory.kv_state(w), F.lit(50.0)).first()
    assert (stats.total_keys, stats.expired_keys) == (len(store), len(store) - len(live))
    assert memory.kv_state(w.where("order < 0")).count() == 0 and memory.kv_stats(memory.kv_state(w.where("order < 0")), F.lit(1.0)).first().bytes == 0


def test_redaction_at_any_depth(spark):
    from logloom.operators import privacy

    schema = "id long, n int, s string, deep struct<a:string,b:array<struct<c:string,d:map<string,array<string>>,e:double>>,f:date>, none array<int>"
    mail = "x a.b@c.org y"
    df = spark.createDataFrame([(1, 5, mail, (mail, [(mail, {mail: [mail, None]}, 1.5), None], None), [1]), (2, None, None, None, None)], schema)
    out = privacy.redact_output(df)
    assert out.schema == df.schema
    first, second = out.orderBy("id").collect()
    clean = "x [REDACTED] y"
    assert first.deep.a == first.s == first.deep.b[0].c == clean and first.deep.b[0].d == {mail: [clean, None]} and first.deep.b[1] is None and first.none == [1]
    assert second.deep is None and second.s is None
    assert privacy.redact_deep(df, ["deep"]).orderBy("id").first().deep.b[0].c == "x [EMAIL] y" and privacy.redact_deep(df, ["deep"]).orderBy("id").first().s == mail
