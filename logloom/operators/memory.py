"""Memory of past solutions: keyword search, similarity, episodes, key/value entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash31, keywords, normalize_error, query_object
from .similar import WEIGHTS, find_similar, signature_similarity, similarity, top_per_key  # noqa: F401


def keyword_search(entries: DataFrame, query_words: list[str], id_col: str, text: Column) -> DataFrame:
    """(id, hits) of entries that hold any of the words, most first, then by id."""
    words = F.array(*map(F.lit, query_words))
    hits = F.size(F.array_intersect(keywords(text), words))
    return entries.select(id_col, hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), id_col)


def error_signature(text: Column) -> Column:
    return hash31(normalize_error(text))


def query_signature(query: Column) -> Column:
    """Object and which of WHERE, LIMIT and sub-select a query has."""
    q = F.upper(query)
    return F.concat(F.coalesce(query_object(query), F.lit("UNKNOWN")), F.lit(":"), F.when(q.contains("WHERE"), "W").otherwise(""), F.when(q.contains("LIMIT"), "L").otherwise(""), F.when(q.contains("(SELECT"), "S").otherwise(""))


def method_pattern(name: Column) -> Column:
    """The last two dotted parts."""
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")


def ema(outcomes: DataFrame, key: str, order: str, outcome: Column, keep: float = 0.7, start: float = 0.5) -> DataFrame:
    """(key, n, success_rate): outcomes in order, each moving the rate by 1 - keep."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), outcome.cast("double").alias("y"))))
    rate = F.aggregate(rows, F.lit(float(start)), lambda s, r: s * keep + r["y"] * (1 - keep))
    return outcomes.groupBy(key).agg(F.count("*").alias("n"), rate.alias("success_rate"))


def search_episodes(episodes: DataFrame, issue_types: list[str] | None = None, tags: list[str] | None = None, outcome: str | None = None, since=None, until=None) -> DataFrame:
    """Episodes that fit all that is asked, newest first."""
    c = F.lit(True)
    if issue_types:
        c &= F.arrays_overlap("issue_types", F.array(*map(F.lit, issue_types)))
    if tags:
        c &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if outcome:
        c &= F.col("outcome") == outcome
    if since is not None:
        c &= F.col("started_at") >= F.lit(since)
    if until is not None:
        c &= F.col("started_at") <= F.lit(until)
    return episodes.where(c).orderBy(F.desc("started_at"), "session_id")


def retain(rows: DataFrame, at: str, now: Column, days: int = 90, most: int = 1000, order: str = "id") -> DataFrame:
    """Rows of the last `days`, at most `most` newest. The newest are found by a top-k, not by one sorted partition."""
    fresh = rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))
    return fresh.orderBy(F.desc(at), order).limit(most)


def solution_ranking(solutions: DataFrame, least_uses: int = 3) -> DataFrame:
    """Solutions used often enough with their success rate."""
    uses = F.col("success_count") + F.col("failure_count")
    return solutions.withColumn("uses", uses).where(F.col("uses") >= least_uses).withColumn("success_rate", F.col("success_count") / F.col("uses"))


def latest(entries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return top_per_key(entries, [key], order, 1).drop("place")


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def kv_writes(rows: DataFrame, op: Column, key: Column, value: Column, expires_at: Column, at: Column, order: Column) -> DataFrame:
    """A log of writes to a key-value store: op is SET, DELETE or CLEAR (of all keys); order is total."""
    return rows.select(op.alias("op"), key.alias("key"), value.alias("value"), expires_at.alias("expires_at"), at.alias("created_at"), at.alias("updated_at"), order.alias("order"))


def kv_state(writes: DataFrame) -> DataFrame:
    """key, value, expires_at, created_at, updated_at, order of what is set, expired or not, after all writes: merge on read.

    A key's last write decides; it was created by its first SET since its last DELETE, or the last CLEAR."""
    cleared = writes.agg(F.max(F.when(F.col("op") == "CLEAR", F.col("order"))).alias("_cleared"))  # one row
    since = writes.where("op <> 'CLEAR' and key is not null").join(F.broadcast(cleared), F.col("_cleared").isNull() | (F.col("order") > F.col("_cleared")))
    ends = since.where("op = 'DELETE'").groupBy("key").agg(F.max("order").alias("_deleted"))
    alive = since.where("op = 'SET'").join(ends, "key", "left").where("_deleted is null or `order` > _deleted")
    last = F.max_by(F.struct("value", "expires_at", "updated_at", "order"), "order")
    return alive.groupBy("key").agg(last.alias("_l"), F.min_by("created_at", "order").alias("created_at")).select("key", "_l.value", "_l.expires_at", "created_at", "_l.updated_at", "_l.order")


def kv_compact(writes: DataFrame, now: Column | None = None) -> DataFrame:
    """The shortest log with the same state: a SET for each key. With `now`, expired keys are cleaned up too."""
    state = kv_state(writes)
    kept = state if now is None else state.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return kept.select(F.lit("SET").alias("op"), "key", "value", "expires_at", "created_at", "updated_at", "order")


def kv_stats(state: DataFrame, now: Column) -> DataFrame:
    """One row: total_keys, expired_keys, bytes (of keys and values)."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return state.agg(F.count("*").alias("total_keys"), F.count_if(F.col("expires_at") < now).alias("expired_keys"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def keys_like(entries: DataFrame, glob: str, key: str = "key") -> DataFrame:
    """Keys that fit a pattern of * and ?."""
    like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return entries.where(F.col(key).like(like))


def encrypt(value: Column, key: bytes) -> Column:
    """AES-GCM, base 64; the key comes from a pass phrase by `derive_key`."""
    return F.base64(F.aes_encrypt(value, F.lit(key), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM")).cast("string")


def derive_key(phrase: str, salt: bytes, rounds: int = 100_000) -> bytes:
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, rounds, 32)


def matching_patterns(rows: DataFrame, patterns: dict[str, str], text: Column, *keep: str) -> DataFrame:
    """(keep, name): every known error pattern that a row's text matches."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in patterns.items()]))
    return rows.select(*keep, F.explode(hits).alias("name"))


def outcomes(episodes: DataFrame, outcome: str, value: str) -> DataFrame:
    """(outcome, n, mean) of all episodes."""
    return episodes.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def similar_episodes(episodes: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(id, first_id, n): each episode's group of equal keys, by its first member and size: pairs are not spelled out."""
    groups = episodes.groupBy(*keys).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    return episodes.select(*keys, id_col).join(groups, keys).select(id_col, "first_id", "n")


def recall(facts: DataFrame, matches: DataFrame, episodes: DataFrame, solutions: DataFrame, most: int = 10, least_uses: int = 2, least_rate: float = 0.5) -> DataFrame:
    """(query_id, n_facts, n_matches, n_episodes, n_solutions, confidence) of every query that recalls something.

    facts: (query_id, fact_id, by_code), facts found by keywords, of which `most` count, and all that an issue's code gives; matches, episodes and
    solutions: (query_id, place, ...), of which `most` count; solutions need `least_uses` uses (success_count, failure_count) and a share of successes."""
    words = facts.where("not by_code").select("query_id", "fact_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("fact_id"))).where(F.col("_r") <= most)
    coded = facts.where("by_code").select("query_id", "fact_id").distinct()
    n = {"n_facts": words.select("query_id", "fact_id").unionByName(coded).distinct().groupBy("query_id").count()}
    uses = F.col("success_count") + F.col("failure_count")
    good = solutions.where((uses >= least_uses) & (uses > 0) & (F.col("success_count") >= least_rate * uses))
    for name, df in (("n_matches", matches), ("n_episodes", episodes), ("n_solutions", good)):
        n[name] = df.groupBy("query_id").agg(F.least(F.count("*"), F.lit(most)).alias("count"))
    out = None
    for name, df in n.items():
        part = df.withColumnRenamed("count", name)
        out = part if out is None else out.join(part, "query_id", "full")
    out = out.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in n])
    return out.withColumn("confidence", F.least(F.lit(1.0), sum(F.col(c) for c in n) / 10))


def recall_for(requests: DataFrame, facts: DataFrame, entries: DataFrame, episodes: DataFrame, solutions: DataFrame, most: int = 10, least_uses: int = 2, least_rate: float = 0.5) -> DataFrame:
    """(query_id, n_facts, n_matches, n_episodes, n_solutions, confidence) of every request, each part found in what is remembered.

    requests: (query_id, text, code, signature), facts: (fact_id, text, code), entries: (entry_id, signature), episodes: (issues), solutions: (issue_type,
    success_count, failure_count). A word's facts are cut to its `most` smallest ids, among which a request's `most` smallest are; what a code gives is
    counted once for each code, so no request meets all that is remembered. Requests with a null code recall by words and signature alone."""
    words = facts.select("fact_id", F.col("code").alias("_of"), F.explode(keywords(F.col("text"))).alias("_w"))
    words = top_per_key(words, ["_w"], [F.col("fact_id")], most).drop("place")
    asked = requests.select("query_id", "code", F.explode(keywords(F.col("text"))).alias("_w")).join(words, "_w").select("query_id", "code", "fact_id", "_of").distinct()
    said = top_per_key(asked, ["query_id"], [F.col("fact_id")], most).where(~F.col("_of").eqNullSafe(F.col("code")) | F.col("code").isNull()).groupBy("query_id").agg(F.count("*").alias("_said"))
    near = find_similar(requests.select("query_id", "signature"), entries, 0.3, most).groupBy("query_id").agg(F.count("*").alias("n_matches"))
    uses = F.col("success_count") + F.col("failure_count")
    good = solutions.where((uses >= least_uses) & (uses > 0) & (F.col("success_count") >= least_rate * uses))
    codes = facts.select("code", F.lit("_coded").alias("_what")).unionByName(episodes.select(F.explode(F.array_distinct("issues")).alias("code"), F.lit("n_episodes").alias("_what"))).unionByName(good.select(F.col("issue_type").alias("code"), F.lit("n_solutions").alias("_what")))
    counted = codes.groupBy("code").agg(*[F.count_if(F.col("_what") == c).alias(c) for c in ("_coded", "n_episodes", "n_solutions")])
    # the codes asked for most are dealt without moving their requests
    often = requests.groupBy("code").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "code").limit(1000).select("code")
    some = requests.select("query_id", "code")
    known = counted.join(F.broadcast(often), "code", "left_semi")
    both = some.join(F.broadcast(often), "code", "left_semi").join(F.broadcast(known), "code").unionByName(some.join(F.broadcast(often), "code", "left_anti").join(counted, "code"))
    out = some.select("query_id").join(both.drop("code"), "query_id", "left").join(said, "query_id", "left").join(near, "query_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    few = lambda c: F.least(n(F.col(c)), F.lit(most)).cast("long").alias(c)
    out = out.select("query_id", (n(F.col("_coded")) + n(F.col("_said"))).alias("n_facts"), few("n_matches"), few("n_episodes"), few("n_solutions"))
    return out.withColumn("confidence", F.least(F.lit(1.0), (F.col("n_facts") + F.col("n_matches") + F.col("n_episodes") + F.col("n_solutions")) / 10))
