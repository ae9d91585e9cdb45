import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import similar

LISTS = similar.LISTS
SIG = "struct<issue_type:string,error_signature:string,objects:array<string>,namespaces:array<string>,methods:array<string>,queries:array<string>,limits:array<string>>"


def score(q, e):
    """The weighted mean, one pair at a time."""
    top, bottom = 0.25 * (q["issue_type"] is not None and q["issue_type"] == e["issue_type"]), 0.25
    if q["error_signature"] and e["error_signature"]:
        top, bottom = top + 0.15 * (q["error_signature"] == e["error_signature"]), bottom + 0.15
    for name in LISTS:
        a, b = ({x.lower() for x in s[name] or () if x is not None} for s in (q, e))
        top, bottom = top + similar.WEIGHTS[name] * (len(a & b) / len(a | b) if a | b else 1.0), bottom + similar.WEIGHTS[name]
    return round(top / bottom, 6)


def brute(queries, entries, least, top):
    low = lambda s: {x.lower() for x in s["objects"] or () if x is not None}
    out = []
    for i, q in queries:
        fits = [(j, e) for j, e in entries if (q["issue_type"] is not None and q["issue_type"] == e["issue_type"]) or low(q) & low(e)] or entries
        best = sorted((-s, j) for j, e in fits if (s := score(q, e)) >= least)[:top]
        out += [(i, j, -s, n) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def made(rng, types, words, hot):
    """A third of the signatures have one type and nothing else."""
    if rng.random() < hot:
        return dict(issue_type="HOT", error_signature=None, **{n: [] for n in LISTS})
    some = lambda: None if rng.random() < 0.05 else [rng.choice("aAbB") + str(rng.randrange(words)) for _ in range(rng.choice((0, 0, 1, 2, 4)))]
    return dict(issue_type=rng.choice([None, "HOT", *map(str, range(types))]), error_signature=rng.choice((None, "", "e1", "e2", "e3")), **{n: some() for n in LISTS})


def frame(spark, rows, name):
    return spark.createDataFrame([(i, tuple(s[k] for k in ("issue_type", "error_signature", *LISTS))) for i, s in rows], f"{name} long, signature {SIG}").repartition(3)


def close(got, want):
    got = sorted(tuple(r) for r in got.select("query_id", "entry_id", "score", "place").collect())
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))


@pytest.mark.parametrize("types,words,hot,least,top", [(4, 3, 0.33, 0.3, 10), (30, 40, 0.0, 0.3, 3), (2, 200, 0.33, 0.6, 1)])
def test_same_rows_as_all_pairs(spark, monkeypatch, types, words, hot, least, top):
    monkeypatch.setattr(similar, "TILE", 16)
    monkeypatch.setattr(similar, "FREQUENT", 3)
    rng = random.Random(types)
    entries = [(i, made(rng, types, words, hot)) for i in range(350)]
    queries = [(1000 + i, made(rng, types + 2, words, hot)) for i in range(90)]
    queries += [(5000, dict(issue_type="none such", error_signature="e1", **{n: [] for n in LISTS})), (5001, dict(issue_type=None, error_signature=None, **{n: ["zz"] for n in LISTS}))]
    close(similar.find_similar(frame(spark, queries, "query_id"), frame(spark, entries, "entry_id"), least, top), brute(queries, entries, least, top))


def test_empty_sides(spark):
    some = [(1, made(random.Random(1), 2, 2, 0.0))]
    none = lambda name: frame(spark, some, name).where("1 = 0")
    assert similar.find_similar(none("query_id"), frame(spark, some, "entry_id")).count() == 0
    assert similar.find_similar(frame(spark, some, "query_id"), none("entry_id")).count() == 0


def test_few_pairs_are_scored_under_a_hot_type(spark):
    """One type has every entry; a rarer token decides, so hardly any of the 400 x 4000 candidates are looked at."""
    empty = F.array().cast("array<string>")
    sig = F.struct(F.lit("HOT").alias("issue_type"), F.lit(None).cast("string").alias("error_signature"), F.array(F.concat(F.lit("o"), (F.col("id") % 397).cast("string"))).alias("objects"), F.array(F.concat(F.lit("n"), (F.col("id") % 89).cast("string"))).alias("namespaces"), empty.alias("methods"), empty.alias("queries"), empty.alias("limits"))
    e = spark.range(4000).select(F.col("id").alias("entry_id"), sig.alias("signature"))
    q = e.where("entry_id % 10 = 0").withColumnRenamed("entry_id", "query_id")
    counted = []
    plain = similar.scored_pairs

    def counting(*args):
        out = plain(*args)
        counted.append(out.count())
        return out

    similar.scored_pairs = counting
    try:
        got = similar.find_similar(q, e, top=3)
        assert got.where("place = 1 and score < 1").count() == 0 and got.count() == 1200
    finally:
        similar.scored_pairs = plain
    assert counted[0] < 400 * 4000 / 20
