import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import similar
from logloom.streaming import episodes, sessions

FACT = "owner string, ts timestamp, id long, kind string, value string, outcome string, helpful boolean, rating long"


def brute(rows, idle):
    """One fact at a time; idle in seconds."""
    open_, out = {}, []
    for owner, ts, i, kind, value, outcome, helpful, rating in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2])):
        e = open_.get(owner)
        if e and (ts - e["last"]).total_seconds() >= idle:
            out.append(e)
            e = None
        if e is None:
            e = open_[owner] = dict(owner=owner, episode_id=i, first=ts, issues=[], solutions=[], outcome="UNKNOWN", ended=None, helpful=None, rating=None)
        e["last"] = ts
        to = {"issue": e["issues"], "solution": e["solutions"]}.get(kind)
        if to is not None and value is not None and value not in to:
            to.append(value)
        if kind == "complete":
            e.update(ended=ts, outcome=outcome if outcome in episodes.OUTCOMES else "UNKNOWN", helpful=helpful, rating=rating)
            out.append(open_.pop(owner))
    return sorted([*out, *open_.values()], key=lambda e: (e["owner"], e["episode_id"]))


def facts(spark, n, seed):
    import datetime

    rng, at, rows = random.Random(seed), datetime.datetime(2024, 1, 1), []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice((0, 1, 600, 1800, 3600)))
        kind = rng.choice(("issue", "issue", "solution", "note", None, "complete"))
        owner = rng.choice(("hot", "hot", "a", "b", "c", "", None))
        value = rng.choice(("x", "y", "z", None))
        rows.append((owner, at if i % 50 else None, i, kind, value, rng.choice((None, "RESOLVED", "ABANDONED", "odd")), rng.choice((None, True, False)), rng.choice((None, 1, 5))))
    return rows, spark.createDataFrame(rows, FACT).repartition(3)


def shown(df):
    return sorted(tuple(r) for r in df.select("owner", "episode_id", "issues", "solutions", "outcome", "helpful", "rating", (F.col("last_ms") - F.col("started_ms")).alias("span"), F.col("ended_ms").isNotNull().alias("ended")).collect())


@pytest.mark.parametrize("stretch", ["1 minute", "6 hours", "9999 days"])
def test_batch_equals_facts_one_by_one(spark, stretch):
    rows, df = facts(spark, 500, 1)
    want = [(e["owner"], e["episode_id"], e["issues"], e["solutions"], e["outcome"], e["helpful"], e["rating"], int((e["last"] - e["first"]).total_seconds() * 1000), e["ended"] is not None) for e in brute(rows, 3600)]
    assert shown(episodes.episodes(df, "1 hour", stretch)) == sorted(want)
    assert episodes.episodes(df.where("1 = 0"), "1 hour").count() == 0


def test_stream_equals_batch(spark):
    _, df = facts(spark, 240, 2)
    got = sessions.run_in_batches(df, F.floor(F.col("id") / 80).cast("int") + 1, 3, "ts", lambda s: episodes.stream_episodes(s, "1 hour"))
    assert shown(got) == shown(episodes.episodes(df, "1 hour"))


def test_episodes_of_many_owners_are_held_in_few_groups(spark, tmp_path):
    n = 3 * sessions.GROUPS
    kind = F.when(F.col("id") % 7 == 0, "complete").when(F.col("id") % 2 == 0, "issue").otherwise("solution")
    df = spark.range(3 * n).select((F.col("id") % n).cast("string").alias("owner"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), "id", kind.alias("kind"), F.col("id").cast("string").alias("value"), F.lit("RESOLVED").alias("outcome"), F.lit(True).alias("helpful"), F.when(F.col("id") % 5 > 0, F.lit(2**53 + 1)).alias("rating"))
    got = sessions.run_in_batches(df, F.when(F.col("id") < n, 1).otherwise(2), 2, "ts", lambda s: episodes.stream_episodes(s, "20 minutes"))
    assert shown(got) == shown(episodes.episodes(df, "20 minutes"))
    df.write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    q = episodes.stream_episodes(arriving, "20 minutes").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= sessions.GROUPS


def test_stored_solutions_are_tried_found_and_judged(spark):
    sig = f"struct<issue_type:string,error_signature:string,{','.join(f'{n}:array<string>' for n in similar.LISTS)}>"
    asked = [("o", "2024-01-01 10:00:00", 7, "SOQL_IN_LOOP", "Lift the query", ["one"], (None, "e", ["Case"], [], [], [], []))]
    requests = spark.createDataFrame(asked, f"owner string, ts string, id long, issue_type string, title string, steps array<string>, signature {sig}").withColumn("ts", F.col("ts").cast("timestamp"))
    solutions, entries, tried = episodes.store(requests)
    end = spark.createDataFrame([("o", "2024-01-01 10:05:00", 8, "complete", None, "PARTIALLY_RESOLVED", True, 4)], FACT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    done = episodes.episodes(tried.unionByName(end), "1 hour")
    assert [(r.solutions, r.outcome) for r in done.collect()] == [(["sol_7"], "PARTIALLY_RESOLVED")]
    said = episodes.solution_outcomes(done).first()
    assert (said.solution_id, said.success_count, said.failure_count) == ("sol_7", 0, 1)
    found = similar.find_similar(entries.select(F.lit(1).alias("query_id"), "signature"), entries)
    assert [(r.entry_id, r.score) for r in found.collect()] == [(7, 1.0)] and solutions.first().source == "LEARNED"
