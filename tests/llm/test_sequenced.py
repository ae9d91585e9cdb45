import datetime as dt
import zlib

from pyspark.sql import functions as F

from logloom.llm.sequenced import _Held, PAGE, applied_changes, dense_ranks

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, status string"
COLUMNS = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
EPOCH = dt.datetime(1970, 1, 1)


def brute(rows, batches=8, wait=5, first_day=19723, span=160):
    """The rules one change at a time, batch by batch."""
    rows = sorted(set(rows), key=repr)
    rank = {}
    for c in {r[1] for r in rows}:
        seqs = sorted({r[2] for r in rows if r[1] == c}, key=lambda s: (s is None, s or 0))
        rank |= {(c, s): i + 1 for i, s in enumerate(seqs)}
    fed = [[] for _ in range(batches + 2)]
    for cid, client, seq, op, at, _, _, city, balance in rows:
        if cid is None or at is None or (h := zlib.crc32(str(cid).encode())) % 11 == 0:
            continue
        day = (at - EPOCH).days + 2 * (h % 4)
        b = max(1, min(batches, 1 + (day - first_day) * batches // span))
        fed[b].append((day, cid, op or "", city or "", balance is None, balance or 0.0, client, rank[client, seq], op, city, balance))
    state, out, top = {}, [], None
    for b in range(1, batches + 2):
        def apply(c, missed=0):
            s = state[c]
            while s["next"] in s["held"]:
                day, cid, op, city, balance = s["held"].pop(s["next"])
                if op == "I":
                    s["v"] = (city, balance)
                elif op == "U":
                    s["v"] = (s["v"][0] if city is None else city, s["v"][1] if balance is None else balance)
                elif op == "D":
                    s["v"] = (None, None)
                s["last"] = len(out), op
                out.append([cid, c, "applied", b, missed, s["v"][0], None if s["v"][1] is None else int((100 * s["v"][1] + 0.5) // 1), False])
                s["next"], missed = s["next"] + 1, 0

        for c, s in state.items():
            while s["held"] and (b > batches or min(x[0] for x in s["held"].values()) + wait <= top):
                to = min(s["held"])
                missed, s["next"] = to - s["next"], to
                apply(c, missed)
        for day, cid, *_, c, n, op, city, balance in sorted(fed[b], key=lambda r: r[:6]) if b <= batches else []:
            s = state.setdefault(c, {"next": 1, "held": {}, "v": (None, None), "last": None})
            if n < s["next"] or n in s["held"]:
                out.append([cid, c, "rejected", b, 0, None, None, False])
                continue
            s["held"][n] = (day, cid, op, city, balance)
            apply(c)
        days = [r[0] for r in fed[b]] if b <= batches else []
        top = max([*days, *([top] if top is not None else [])], default=None)
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][7] = True
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_query_against_brute_force(spark):
    from logloom.llm import queries as q

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/client_changes.parquet").select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").collect()]
    want = brute(rows)
    assert {r[3] for r in want} == set(range(1, 8)) | {r[3] for r in want if r[3] > 7} and any(r[4] for r in want)
    assert rows_of(q.queries()["op11_sequenced"](spark, sf)) == want


def test_odd_rows_and_an_empty_batch(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows, cid = [], 0
    for c in (None, 1, 2):
        for n in range(40):
            for again in range(1 + (n % 7 == 0)):
                cid += 1
                at = 3 * n + (25 if n % 9 == 4 else 0)
                # nothing between day 50 and day 90: a batch stays empty
                rows.append((cid, c, 10 * n if n < 39 else None, "IUDXU"[n % 5] if n else None, day(at if at < 50 else at + 40), "s", None, None if n % 4 == 1 else f"c{cid}", None if n % 3 == 1 else n - 0.125))
    rows += [(None, 1, 5, "I", day(1), "s", None, "x", 1.0), (9001, 1, 5, "I", None, "s", None, "x", 1.0), (9002, 5, 1, "I", day(-400), "s", None, "early", float("nan"))]
    rows += [(7000, 2, 0, "I", day(2), "s", None, "first of one id", 1.0), (7000, 2, 0, "I", day(2), "s", None, "same id", 2.0)]
    rows += [(8000 + i, 77, i, "U", day(i % 60), "s", None, f"t{i}", float(i)) for i in range(300)]  # more than a page
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:9]], SCHEMA)
    want = brute([r for r in rows if r[0] != 9002])
    got = rows_of(applied_changes(df))
    assert [r for r in got if r[0] != 9002] == want
    assert [r[2:6] for r in got if r[0] == 9002] in ([], [("applied", 1, 0, "early")])
    none = applied_changes(df.where(F.lit(False)))
    assert none.columns[:8] == COLUMNS and none.count() == 0


def test_dense_ranks_over_partitions(spark):
    rows = spark.createDataFrame([(k, s) for k in (None, 1, 2) for s in [None, *range(0, 500, 3)] for _ in range(2)], "k long, s long")
    got = {(r.k, r.s): r.n for r in dense_ranks(rows, "k", "s").collect()}
    assert got == {(k, s): i + 1 for k in (None, 1, 2) for i, s in enumerate([*range(0, 500, 3), None])}


def test_pages_beyond_the_cache():
    class State(dict):
        getValue, removeKey = dict.get, dict.pop

        def updateValue(self, k, v):
            self[k] = v

    state, held = State(), None
    held = _Held(state, [], [])
    numbers = list(range(0, 100 * PAGE, 97))
    for n in reversed(numbers):
        held.put(n, (n, n, "U", None, 0.5, 1))
    held.flush()
    again = _Held(state, list(held.day), list(held.day.values()))
    assert again.smallest() == 0 and all(again.get(n)[:2] == (n, n) for n in numbers) and again.get(1) is None
    for n in numbers:
        assert again.take(n)[1] == n and again.take(n) is None
    again.flush()
    assert not state and not again.day
