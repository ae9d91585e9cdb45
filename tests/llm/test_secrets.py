import hashlib
import random
import re
import string

from logloom.llm import secrets

SCHEMA = "doc_id long, text string, base string, spans int"
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def make():
    rng = random.Random(6)
    key = lambda n, a=string.ascii_letters + string.digits: "".join(rng.choice(a) for _ in range(n))
    bits = ["plain words here", "é\U0001f600 ", "\n", "", "$1 \\ $", "password", "Token: ", "API_KEY = '", "apikey=", "secret\"  :\"", "passwd =short", "token=secret=abcdefgh", "AKIA", "AKIA1234", "deadbeef", "="]
    rows = [(i, "".join(rng.choice(bits) if rng.random() < 0.8 else rng.choice([key(9), "AKIA" + key(16, string.ascii_uppercase + string.digits), key(40, "0123456789abcdef"), key(31, "0123456789abcdef")]) for _ in range(rng.randint(0, 30))), "x", 1) for i in range(150)]
    prose = " ".join(["ordinary identifiers like customerAccountNumber or total_amount_of_orders appear everywhere"] * 3)
    rows += [(1000 + i, f"{prose} invoice number {i}", "x", 1) for i in range(50)]
    rows += [(2000, None, "x", 1), (2001, "", "x", 1), (2002, "word " * 20000 + "token = abcdefghij", "x", 1), (None, "password: hunter2hunter2", "x", 1), (2003, f"{prose} {key(30)} end", "x", 1), (2004, "AKIA" + "A1" * 400, "x", 1)]
    return rows


def test_base_spans_match_brute_force(spark):
    rows = make()
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = brute(text)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in spans if k != "random"] == want
        for k, a, b in spans:
            if k == "random":
                assert re.fullmatch(secrets.CANDIDATE, text[int(a) : int(b)]) and not any(x < int(b) and int(a) < y for x, _, y in want)


def test_random_strings_are_added_and_identifiers_are_not(spark):
    prose = spark.createDataFrame([r for r in make() if r[0] and 1000 <= r[0] < 1050], SCHEMA)
    samples = secrets.random_strings(spark).unionByName(secrets.code_identifiers(spark)).unionByName(secrets.identifier_samples(prose))
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(make(), SCHEMA), samples).collect()}
    assert got[2003].n_random == 1
    assert all(got[1000 + i].n_random == 0 for i in range(50))
    rng = random.Random(1)
    fresh = [(i, " ".join(["it is", "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)), "x"]), "", 0) for i in range(100)]
    hits = secrets.secret_spans(spark.createDataFrame(fresh, SCHEMA), samples).collect()
    assert sum(r.n_random for r in hits) >= 98


def test_empty(spark):
    assert secrets.secret_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_free_spans_against_every_pair(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(12), []
    for i in range(60):
        at, more = 0, []
        for _ in range(rng.randint(0, 200) if i else 0):
            a = at + rng.randint(0, 4)
            at = a + rng.randint(1, 6)
            more.append((a, 3, at))
        base = [(a, rng.randrange(3), a + rng.randint(1, 9)) for a in (rng.randrange(500) for _ in range(rng.randint(0, 40)))]
        rows.append((i, more, base))
    kind = "array<struct<s:int,k:int,e:int>>"
    df = spark.createDataFrame(rows, f"i int, more {kind}, base {kind}").repartition(2).select("i", secrets._free(F.col("more"), F.col("base")).alias("free"))
    want = {i: [m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base)] for i, more, base in rows}
    assert {r.i: [tuple(x) for x in r.free] for r in df.collect()} == want


def test_a_text_full_of_matches(spark):
    text = " ".join(f"é token=abcdefgh{i % 10} AKIAABCDEFGHIJKLMN" for i in range(20_000))
    r = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute(text))
    assert (r.n_assign, r.n_access) == (20_000, 20_000) and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
