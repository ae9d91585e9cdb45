import random

import pytest
from logloom.llm import revisits
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, bucket int, past string, full string"


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.com:80/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
    ("https://user@example.com:8443", "example.com:8443"),
    ("https://example.com/?utm_source=q&ref=x", "example.com"),
    ("http://www2.example.com/A//", "example.com/A"),
    ("nonsense", None), ("", None), (None, None),
])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u"))).first()[0] == want


def brute(rows):
    canon = {"http://a.com/x": "a.com/x", "https://www.a.com/x#f": "a.com/x", "http://b.com/": "b.com"}
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        past = [p for p in rows if p[3] == "response" and p[4] == 200 and canon.get(p[1]) and canon.get(p[1]) == canon.get(r[1]) and p[2] is not None and r[2] is not None and p[2] < r[2]]
        if not past:
            out[r[0]] = ("unmatched", None, None)
            continue
        p = max(past, key=lambda p: (p[2], p[0]))
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        a, b = low(r[5]), low(p[5])
        if r[6] and p[6]:
            same = r[6] == p[6]
        elif a.get("etag") and b.get("etag"):
            same = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/")
        elif a.get("last-modified") and b.get("last-modified"):
            same = a["last-modified"] == b["last-modified"]
        else:
            out[r[0]] = ("unverified", None, None)
            continue
        merged = b | {k: v for k, v in a.items() if k not in revisits.STORED_ONLY}
        out[r[0]] = ("resolved", p[0], merged) if same else ("mismatch", None, None)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        h = {}
        if rng.random() < 0.7:
            h["ETag"] = rng.choice(["1", "W/1", "2"])
        if rng.random() < 0.5:
            h["last-Modified"] = rng.choice(["a", "b"])
        h["Content-Length"], h["Date"] = str(i), f"d{i}"
        rows.append((i, rng.choice(["http://a.com/x", "https://www.a.com/x#f", "http://b.com/", "bad", None]), rng.choice([None, *range(40)]), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([h, h, h, None]), rng.choice([None, None, "s", "t"]), 1, "x", "y"))
    for buckets in (1, 4, 64):
        got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets).collect()}
        assert got == brute(rows)


def test_empty_and_repeats(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "http://a.com/x", 1, "response", 200, {"ETag": "1"}, None, 0, "", ""), *[(2, "http://a.com/x", 2, "revisit", 304, {"etag": "1"}, None, 0, "", "")] * 2]
    assert [r.response_id for r in revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()] == [1, 1]


def test_addresses_in_brackets_are_hosts(spark):
    urls = {"http://[2001:db8::1]/a": "[2001:db8::1]/a", "http://[2001:DB8::2]:80/a/": "[2001:db8::2]/a", "https://u@[::1]:8080/x?b=1&a=2#f": "[::1]:8080/x?a=2&b=1", "http://www.a.org:443/": "a.org"}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", revisits.canonical_url(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == urls


def test_a_hot_url_in_many_buckets(spark):
    rows = [(i, "http://a.org/x", i, "response" if i % 3 == 0 else "revisit", 200 if i % 3 == 0 else 304, {"etag": "t"}, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string")
    got = {r.record_id: r.response_id for r in revisits.resolve_revisits(df, 40).collect()}
    assert got == {i: i - i % 3 for i in range(3000) if i % 3}
