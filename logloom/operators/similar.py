"""Entries most like each query: a set-similarity join with prefix filters, exact for any skew.

A signature is (issue_type, error_signature, objects, namespaces, methods, queries, limits). An entry is a candidate of a query that has
its issue type or one of its objects; a query without any candidate gets all entries. The score is a weighted mean of equal types, equal errors
(where both have one) and Jaccard similarities of the lists.

* Equal signatures are one node on either side; a node keeps its `top` smallest ids, as ties go by id.
* A token is a type, an error, a list's value or "this list is empty". A Jaccard similarity is at most (shared values) / (the query's values), so
  a pair's score is at most the sum of the weights of the query's tokens that it shares.
* A first look at few entries for each query gives the score that its last place has at least. The query's tokens are then taken
  rarest first until those left over can't reach that score: an entry above it shares one of the tokens taken. Where the query's type and
  objects are rarer together, those are taken instead. Nothing is dropped: entries that share a taken token are all scored.
* Long lists of entries with a token and long lists of queries that take it are dealt as tiles, so no key holds more than about TILE rows of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..sources.tables import discard, materialize

# fixed values: weights of the parts of a similarity
WEIGHTS = {"issue_type": 0.25, "error": 0.15, "objects": 0.15, "namespaces": 0.10, "methods": 0.15, "queries": 0.10, "limits": 0.10}
LISTS = ("objects", "namespaces", "methods", "queries", "limits")
#: What every score is divided by at least: all weights but that of errors.
LEAST_WEIGHT = 0.85
#: Rows of a side that meet under one key.
TILE = 1024
#: Entries looked at under one key, and tokens of a query, in the first look. Both only sharpen a bound.
LOOK, LOOK_TOKENS = 32, 4
#: Tokens that most queries have: their counts are broadcast, this many at most.
FREQUENT = 1000


def similarity(parts: list[tuple[float, Column, Column | None]]) -> Column:
    """Weighted mean of (weight, score, whether it counts)."""
    top = bottom = F.lit(0.0)
    for weight, score, counts in parts:
        w = F.lit(weight) if counts is None else F.when(counts, weight).otherwise(0.0)
        top, bottom = top + w * score, bottom + w
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def signature_similarity(a: str, b: str) -> Column:
    """Of two signature structs whose lists are in lower case (`plain`)."""
    f = lambda side, name: F.col(f"{side}.{name}")
    both_errors = f(a, "error_signature").isNotNull() & f(b, "error_signature").isNotNull()
    sets = [(WEIGHTS[n], jaccard(f(a, n), f(b, n)), None) for n in LISTS]
    same = lambda n: F.when(f(a, n) == f(b, n), 1.0).otherwise(0.0)
    return similarity([(WEIGHTS["issue_type"], same("issue_type"), None), (WEIGHTS["error"], same("error_signature"), both_errors), *sets])


def plain(sig: str) -> Column:
    """A signature with sorted distinct lower-case lists: a null list is empty, null values and an empty error vanish."""
    values = [F.sort_array(F.array_distinct(F.transform(F.filter(F.coalesce(F.col(f"{sig}.{n}"), F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower))).alias(n) for n in LISTS]
    error = F.col(f"{sig}.error_signature").cast("string")
    return F.struct(F.col(f"{sig}.issue_type").alias("issue_type"), F.when(error != "", error).alias("error_signature"), *values)


def tokens(sig: str) -> Column:
    """(t, u, gate) of each token: hash, the most it adds to a sum of weighted scores, whether sharing it makes a candidate."""
    one = lambda hash_, u, gate: F.struct(hash_.alias("t"), u.alias("u"), F.lit(gate).alias("gate"))
    single = lambda name, value, gate: F.when(value.isNotNull(), F.array(one(F.xxhash64(F.lit(name), value), F.lit(WEIGHTS[name]), gate)))
    parts = [single("issue_type", F.col(f"{sig}.issue_type"), True), single("error", F.col(f"{sig}.error_signature"), False)]
    for name in LISTS:
        values, empty = F.col(f"{sig}.{name}"), F.array(one(F.xxhash64(F.lit(f"no {name}")), F.lit(WEIGHTS[name]), False))
        share = F.lit(WEIGHTS[name]) / F.size(values)
        full = F.transform(values, lambda x: one(F.xxhash64(F.lit(name), x), share, name == "objects"))  # noqa: B023
        parts.append(F.when(F.size(values) > 0, full).otherwise(empty))
    return F.flatten(F.array_compact(F.array(*parts)))


def nearly(sig: str) -> Column:
    """Hashes of the whole signature and of it without one part each: keys of the first look."""
    parts = ("issue_type", "error_signature", *LISTS)
    left = [F.xxhash64(F.lit(f"but {out}"), *[F.coalesce(F.to_json(F.struct(f"{sig}.{p}")), F.lit("")) for p in parts if p != out]) for out in ("", *parts)]
    return F.array(*left)


def _fold(rows: DataFrame, id_col: str, top: int) -> DataFrame:
    """(sig, ids): one row for each plain signature with its `top` smallest ids; a hot signature is cut down before the shuffle."""
    all_ = rows.select(F.col(id_col).alias("id"), plain("signature").alias("sig"))
    ids = all_.withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy("id"))).where(F.col("_r") <= top)
    return ids.groupBy("sig").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _is_candidate(q: str, e: str) -> Column:
    return F.coalesce(F.col(f"{q}.issue_type") == F.col(f"{e}.issue_type"), F.lit(False)) | F.arrays_overlap(f"{q}.objects", f"{e}.objects")


def _join_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (t, ...) with n_e of counts (t, n_q, n_e); the FREQUENT tokens most queries have don't shuffle them."""
    often = counts.orderBy(F.desc("n_q"), "t").limit(FREQUENT).select("t", "n_e")
    rest = counts.join(F.broadcast(often.select("t")), "t", "left_anti").select("t", "n_e")
    rare = rows.join(F.broadcast(often.select("t")), "t", "left_anti")
    return rows.join(F.broadcast(often), "t").unionByName(rare.join(rest, "t"))


def last_place(query_tokens: DataFrame, queries: DataFrame, entries: DataFrame, least: float, top: int) -> DataFrame:
    """(query, bound): a score that the query's place `top` has at least, from a first look at LOOK entries for each of few keys."""
    salts = 8
    looked = entries.select("entry", "esig", "ids", F.explode(F.array_distinct(F.concat(F.col("tokens.t"), nearly("esig")))).alias("k"))
    looked = looked.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("entry"))).where(F.col("_r") <= LOOK).drop("_r")
    looked = looked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rarest = query_tokens.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("n_e", "t"))).where(F.col("_r") <= LOOK_TOKENS)
    keys = rarest.groupBy("query").agg(F.collect_set("t").alias("ks"), F.max("met").alias("met"))
    asks = queries.join(keys, "query").select("query", "qsig", "met", F.explode(F.array_distinct(F.concat("ks", nearly("qsig")))).alias("k"))
    asks = asks.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    found = asks.join(looked, ["k", "salt"]).where(~F.col("met") | _is_candidate("qsig", "esig"))
    scored = found.select("query", "entry", F.size("ids").alias("n"), F.round(signature_similarity("qsig", "esig"), 6).alias("score")).where(F.col("score") >= least).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    first = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top)
    return first.withColumn("_n", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") >= top).groupBy("query").agg(F.max("score").alias("bound"))


def taken_tokens(query_tokens: DataFrame, bounds: DataFrame, least: float) -> DataFrame:
    """(query, met, t, n_e) that every entry at or above the query's bound shares one of."""
    whole = Window.partitionBy("query")
    rarest_last = whole.orderBy(F.desc("n_e"), "t").rowsBetween(Window.unboundedPreceding, 0)
    rows = query_tokens.join(bounds, "query", "left").withColumn("need", F.coalesce("bound", F.lit(least)) * LEAST_WEIGHT - 2e-6)
    rows = rows.withColumn("prefix", F.sum("u").over(rarest_last) >= F.col("need"))
    cost = lambda c: F.sum(F.when(F.col(c), F.col("n_e")).otherwise(0)).over(whole)
    rows = rows.withColumn("by_gate", F.col("met") & (cost("gate") < cost("prefix")))
    return rows.where(F.when(F.col("by_gate"), F.col("gate")).otherwise(F.col("prefix"))).select("query", "met", "t", "n_e").dropDuplicates(["query", "t"])


def scored_pairs(taken: DataFrame, asked: DataFrame, queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, entry, ids, score) of all candidates that share a taken token, each pair once, under the first such token.

    asked: (t, q_tiles, e_tiles, n_q, n_e) of the tokens taken."""
    often = asked.orderBy(F.desc("n_q"), "t").limit(FREQUENT).unionByName(asked.orderBy(F.desc("n_e"), "t").limit(FREQUENT)).distinct()
    often = F.broadcast(often.select("t", "q_tiles", "e_tiles"))
    others = asked.select("t", "q_tiles", "e_tiles").join(often, "t", "left_anti")

    def dealt(rows: DataFrame, mine: str, other: str, id_col: str) -> DataFrame:
        """Each row in one tile of its own side and all of the other's."""
        both = rows.join(often, "t").unionByName(rows.join(often, "t", "left_anti").join(others, "t"))
        return both.withColumn(mine, F.pmod(F.xxhash64(id_col, "t"), F.col(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = queries.join(taken.groupBy("query", "met").agg(F.collect_set("t").alias("ts")), "query")
    left = dealt(left.select("query", "met", "qsig", "ts", F.explode("ts").alias("t")), "q_tiles", "e_tiles", "query")
    right = dealt(entries.select("entry", "esig", "ids", F.array_distinct("tokens.t").alias("es")).select("*", F.explode("es").alias("t")), "e_tiles", "q_tiles", "entry")
    pairs = left.join(right, ["t", "q_tiles", "e_tiles"]).where(F.col("t") == F.array_intersect("ts", "es")[0])
    pairs = pairs.where(~F.col("met") | _is_candidate("qsig", "esig"))
    return pairs.select("query", "entry", "ids", F.round(signature_similarity("qsig", "esig"), 6).alias("score"))


def find_similar(queries: DataFrame, entries: DataFrame, least: float = 0.3, top: int = 10) -> DataFrame:
    """(query_id, entry_id, score, place): the `top` entries most like each query of at least `least`, by score and then by id; `least` is over 0.

    queries: (query_id, signature), entries: (entry_id, signature); ids are distinct. A null type equals none; queries without a fitting entry have no row."""
    e = materialize(_fold(entries, "entry_id", top).select(F.col("ids")[0].alias("entry"), F.col("sig").alias("esig"), "ids", tokens("sig").alias("tokens")), "similar-entries")
    asks = queries.select("query_id", plain("signature").alias("sig"))
    q = materialize(asks.groupBy("sig").agg(F.min("query_id").alias("query"), F.count("*").alias("n")).select("query", F.col("sig").alias("qsig"), "n", tokens("sig").alias("tokens")), "similar-queries")
    n_e = e.select(F.explode(F.array_distinct("tokens.t")).alias("t")).groupBy("t").agg(F.count("*").alias("n_e"))
    each = q.select("query", F.inline("tokens"))
    counts = n_e.join(each.groupBy("t").agg(F.count("*").alias("n_q")), "t")
    known = _join_counts(each, counts)
    known = materialize(known.withColumn("met", F.max("gate").over(Window.partitionBy("query"))), "similar-tokens")
    taken = materialize(taken_tokens(known, last_place(known, q, e, least, top), least), "similar-taken")
    asked = taken.groupBy("t").agg(F.count("*").alias("n_q"), F.max("n_e").alias("n_e"))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    asked = materialize(asked.select("t", tiles("n_q").alias("q_tiles"), tiles("n_e").alias("e_tiles"), "n_q", "n_e"), "similar-asked")
    scored = scored_pairs(taken, asked, q.select("query", "qsig"), e).where(F.col("score") >= least)
    nodes = top_per_key(scored, ["query"], [F.desc("score"), F.col("entry")], top)
    rows = top_per_key(nodes.select("query", "score", F.explode("ids").alias("entry_id")), ["query"], [F.desc("score"), F.col("entry_id")], top)
    rows = materialize(rows, "similar-rows")
    for df in (e, known, taken, asked):
        discard(df)
    # a hot signature's queries are dealt to as many tasks as they need
    of = q.select("query", "qsig", F.ceil(F.col("n") / (TILE * 64)).cast("int").alias("parts"))
    answers = of.join(rows, "query").select("qsig", "entry_id", "score", "place", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    most = of.where("parts > 1").select(F.col("qsig").alias("sig"), "parts")
    split = asks.join(F.broadcast(most.limit(FREQUENT)), "sig", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("parts")), F.lit(0)).cast("int"))
    return split.join(answers.withColumnRenamed("qsig", "sig").drop("parts"), ["sig", "part"]).select("query_id", "entry_id", "score", "place")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
