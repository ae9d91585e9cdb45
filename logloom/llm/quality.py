"""Quality rules: counts of a text's faults, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs are counted: one of trusted documents (labelled good
and not toxic; a bounded sample of labelled rows), one of the whole corpus, every word of every
document. A text's verdict is its mean log ratio of the two over its n-grams, held against one fixed threshold.

All of it is DataFrame expressions. What is done to a document is done inside its row, so
text is never shuffled; counting shuffles one row for each bucket and task.

Defined cases: null, empty and blank texts have no words, fail the base rule and score 0; whole texts of
any length are counted; repeated rows count and are judged as often as they come; null labels or ids
trust nothing; without trusted documents every score is 0; an empty table gives no rows; extra
columns are ignored. Windows of three words are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, let

BUCKETS = 1 << 14
#: Mean log ratio, in nats an n-gram, under which a document is rejected.
THRESHOLD = -0.09
TRUSTED = 20_000
_SPACE = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def same(s: Column) -> Column:
            both = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: both(x, i - 1) | both(x, i + 1))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            merge = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
            return F.aggregate(F.sort_array(F.transform(hit, lambda x: x["p"])), start, merge, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, same))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with column w (words) and text; adds the counts of the base rule and base_failed."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("w")),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(buckets: int, *words: Column) -> Column:
    """Numbered from 1; pairs come after single words."""
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int") + (1 if len(words) == 1 else buckets + 1)


def bucket_array(w: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: _bucket(buckets, F.element_at(w, i), F.element_at(w, i + 1))))
    return F.concat(F.transform(w, lambda x: _bucket(buckets, x)), F.coalesce(pairs, F.array().cast("array<int>")))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int) -> list[float]:
    """log(p trusted / p corpus) of each bucket; both counts are smoothed by one half."""
    flagged = docs.join(F.broadcast(trusted_ids.withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = flagged.select(F.explode(bucket_array(F.col("w"), buckets)).alias("bucket"), F.coalesce("trusted", F.lit(0)).cast("long").alias("trusted"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).collect()  # at most 2 * buckets rows
    n, t = [0.5] * (2 * buckets), [0.5] * (2 * buckets)
    for r in rows:
        n[r.bucket - 1] += r.n
        t[r.bucket - 1] += r.t
    out = []
    for half in (slice(0, buckets), slice(buckets, 2 * buckets)):
        sn, st = sum(n[half]), sum(t[half])
        known = st > buckets / 2
        out += [math.log(b / st) - math.log(a / sn) if known else 0.0 for a, b in zip(n[half], t[half])]
    return out


def trusted_documents(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` ids labelled good and not toxic: the same for the same labels, and so few that they can be broadcast."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, llr, kept; `keep` names columns to carry along."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    src = src.withColumn("w", word_array(F.col("text")))
    ratios = log_ratios(src.select("doc_id", "w"), trusted_documents(labels, trusted), buckets)
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    grams = F.greatest(F.lit(1), 2 * F.size("w") - 1)
    total = F.aggregate(bucket_array(F.col("w"), buckets), F.lit(0.0), lambda a, b: a + F.element_at(table, b))
    out = base_rules(src).withColumn("llr", total / grams)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", *[c for c in keep if c != "doc_id"])


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    src = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"))
    judged = quality_rules(src, labels, keep=("row", "text"), **options)
    # a number that isn't deterministic keeps the filter above the projection: pushed below it, the
    # words would be split again wherever the rules mention them
    kept = judged.withColumn("_stay", F.monotonically_increasing_id()).where("kept and _stay >= 0")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
