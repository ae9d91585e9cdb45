"""Episodes of debugging: opened, extended and completed by facts, as a batch and as a stream with state.

A fact is (owner, ts, id, kind, value, outcome, helpful, rating): kind `issue` (value: its code), `solution` (value: the id of the one tried), `complete`
(with an outcome and feedback) or any other, which only keeps the episode open. An owner's first fact opens an episode; so does the first after a `complete`, or after a silence of
`idle`. An episode that only went silent has no end and the outcome UNKNOWN. Facts without owner, time or id are none.

An owner may have any share of the facts: the batch looks at (owner, stretch of time) and carries one row over each edge; the stream's state is an
episode's first and last time and its distinct issues and solutions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import with_state

OUTCOMES = ("RESOLVED", "PARTIALLY_RESOLVED", "WORKAROUND_APPLIED", "ESCALATED", "ABANDONED", "UNKNOWN")
_EPISODE = "owner string, episode_id long, started_ms long, last_ms long, ended_ms long, issues array<string>, solutions array<string>, outcome string, helpful boolean, rating long"
_NAMES = [c.split()[0] for c in _EPISODE.split(", ")]


def _micros(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


def facts(rows: DataFrame) -> DataFrame:
    """The columns of a fact, ts as it is (a timestamp; a stream's carries its watermark); an outcome that is unknown is UNKNOWN."""
    outcome = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("UNKNOWN")
    cols = [F.col("owner").cast("string").alias("owner"), "ts", F.col("id").cast("long").alias("id"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("value").cast("string").alias("value")]
    return rows.select(*cols, F.when(F.col("kind") == "complete", outcome).alias("outcome"), F.col("helpful").cast("boolean").alias("helpful"), F.col("rating").cast("long").alias("rating"))


def _starts(rows: DataFrame, idle: int, stretch: int) -> DataFrame:
    """rows with `episode_id`, the id of the fact that opened their episode."""
    at = F.unix_micros("ts")
    rows = rows.where("owner is not null and ts is not null and id is not null").withColumn("_b", F.floor(at / stretch))
    mine, before = Window.partitionBy("owner", "_b").orderBy("ts", "id"), Window.partitionBy("owner").orderBy("_b")
    this = F.struct("ts", "id", "kind")
    edge = rows.groupBy("owner", "_b").agg(F.max(this).alias("_l")).select("owner", "_b", F.lag("_l").over(before).alias("_edge"))
    rows = rows.join(edge, ["owner", "_b"]).withColumn("_p", F.coalesce(F.lag(this).over(mine), F.col("_edge")))
    opens = F.col("_p").isNull() | (at - F.unix_micros("_p.ts") >= idle) | (F.col("_p.kind") == "complete")
    rows = rows.withColumn("_o", F.when(opens, F.struct("ts", "id"))).drop("_p", "_edge")
    opened = rows.groupBy("owner", "_b").agg(F.max("_o").alias("_l")).select("owner", "_b", F.last("_l", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_edge"))
    rows = rows.join(opened, ["owner", "_b"])
    return rows.withColumn("episode_id", F.coalesce(F.last("_o", ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, 0)), F.col("_edge"))["id"]).drop("_o", "_edge", "_b")


def episodes(rows: DataFrame, idle: str, stretch: str = "1 day") -> DataFrame:
    """One row for each episode; issues and solutions in the order in which they came first."""
    f = _starts(facts(rows), _micros(idle), _micros(stretch))
    by = ["owner", "episode_id"]
    ms = lambda c: F.unix_millis(c)
    done = F.max_by(F.struct(ms(F.col("ts")).alias("ended_ms"), "outcome", "helpful", "rating"), F.when(F.col("kind") == "complete", F.struct("ts", "id")))
    spans = f.groupBy(*by).agg(ms(F.min("ts")).alias("started_ms"), ms(F.max("ts")).alias("last_ms"), done.alias("_d"))
    first = f.where("kind in ('issue', 'solution') and value is not null").groupBy(*by, "kind", "value").agg(F.min(F.struct("ts", "id")).alias("_f"))
    order = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("_f", "value")))), lambda x: x["value"])
    lists = first.groupBy(*by).agg(order("issue").alias("issues"), order("solution").alias("solutions"))
    none = F.array().cast("array<string>")
    out = spans.join(lists, by, "left")
    return out.select(*by, "started_ms", "last_ms", "_d.ended_ms", F.coalesce("issues", none).alias("issues"), F.coalesce("solutions", none).alias("solutions"), F.coalesce("_d.outcome", F.lit("UNKNOWN")).alias("outcome"), "_d.helpful", "_d.rating").select(*_NAMES)


def stream_episodes(rows: DataFrame, idle: str) -> DataFrame:
    """episodes of a stream with a watermark on ts: a row when an episode is completed or has been silent for `idle`."""
    gap = _micros(idle)

    def end(owner: str, s: dict, out: list, done: tuple = (None, "UNKNOWN", None, None)) -> None:
        ended, outcome, helpful, rating = done
        out.append((owner, s["id"], s["first"] // 1000, s["last"] // 1000, ended, s["issue"], s["solution"], outcome, helpful, rating))

    def take(held: dict, rows: pd.DataFrame, out: list) -> set:
        new, rows = set(), rows[rows["known"]].sort_values(["at", "id"])
        for owner, t, i, kind, value, outcome, helpful, rating in zip(*(rows[c].tolist() for c in ("owner", "at", "id", "kind", "value", "outcome", "helpful", "rating"))):
            s = held.get(owner)
            if s is not None and t - s["last"] >= gap:
                end(owner, s, out)
                s = None
            if s is None:
                s = held[owner] = {"id": i, "first": t, "last": t, "issue": [], "solution": []}
            new.add(owner)
            s["last"] = t
            s["until"] = (t + gap) // 1000
            if kind in ("issue", "solution") and value is not None and value not in s[kind]:
                s[kind].append(value)
            if kind == "complete":
                end(owner, held.pop(owner), out, (t // 1000, outcome, None if pd.isna(helpful) else bool(helpful), None if rating is None else int(rating)))
        return new

    # the row that ends a stream has no owner; longs beside nulls would pass through doubles
    known = F.col("owner").isNotNull() & F.col("id").isNotNull()
    found = facts(rows).where("ts is not null").withColumns({"at": F.unix_micros("ts"), "known": known, "id": F.coalesce("id", F.lit(0).cast("long")), "rating": F.col("rating").cast("string")})
    return with_state(found, "owner", _EPISODE, take, end)


def solution_outcomes(done: DataFrame) -> DataFrame:
    """(solution_id, success_count, failure_count, last_used_ms): what a completed episode says of each solution tried in it. A resolved one is a success of
    all, a partly resolved one a failure; other outcomes say nothing."""
    said = done.where(F.col("outcome").isin("RESOLVED", "PARTIALLY_RESOLVED")).select("outcome", "ended_ms", F.explode("solutions").alias("solution_id"))
    return said.groupBy("solution_id").agg(F.count_if(F.col("outcome") == "RESOLVED").alias("success_count"), F.count_if(F.col("outcome") != "RESOLVED").alias("failure_count"), F.max("ended_ms").alias("last_used_ms"))


def store(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What learning a solution adds: solutions (id, issue_type, title, steps, counts, created_at, source), entries (entry_id, solution_id, signature) for
    `find_similar`, and facts that add the attempt to the owner's open episode.

    requests: (owner, ts, id, issue_type, title, steps, signature); a request's id makes the solution's."""
    made = requests.withColumn("solution_id", F.concat(F.lit("sol_"), F.col("id").cast("string")))
    zero = F.lit(0).cast("long")
    solutions = made.select(F.col("solution_id").alias("id"), "issue_type", "title", "steps", zero.alias("success_count"), zero.alias("failure_count"), F.col("ts").alias("created_at"), F.lit("LEARNED").alias("source"))
    entries = made.select(F.col("id").alias("entry_id"), "solution_id", F.col("signature").withField("issue_type", F.col("issue_type")).alias("signature"))
    none = F.lit(None)
    tried = made.select("owner", "ts", "id", F.lit("solution").alias("kind"), F.col("solution_id").alias("value"), none.cast("string").alias("outcome"), none.cast("boolean").alias("helpful"), none.cast("long").alias("rating"))
    return solutions, entries, tried


def maintenance(done: DataFrame, keys: DataFrame, now_ms: Column, days: int = 90, most: int = 1000) -> DataFrame:
    """One row: expired_keys (of keys with expires_at), old_episodes (started over `days` ago), extra_episodes (older than the `most` newest of the rest)."""
    fresh = F.col("started_ms") >= now_ms - days * 86_400_000
    extra = F.greatest(F.lit(0), F.count_if(fresh) - most).cast("long").alias("extra_episodes")
    seen = done.agg(F.lit(0).cast("long").alias("expired_keys"), F.count_if(~fresh).alias("old_episodes"), extra)
    gone = keys.agg(F.count_if(F.col("expires_at") < now_ms).alias("expired_keys"))
    return seen.unionByName(gone, allowMissingColumns=True).agg(*[F.sum(c).alias(c) for c in seen.columns])
