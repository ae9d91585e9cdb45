"""Scores, ranks and summaries of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum, half_up
from ..schema import SEVERITIES, severity_rank

WEIGHTS = {"CRITICAL": 25.0, "HIGH": 15.0, "MEDIUM": 8.0, "LOW": 3.0, "INFO": 0.0}


def counts_by_severity(issues: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """One column for each severity, zero where there is none."""
    return issues.groupBy(*keys).agg(*[F.count_if(F.col(severity) == s).alias(s.lower()) for s in reversed(SEVERITIES)])


def health_score(issues: DataFrame, key: str = "log_id", kind: str = "type", severity: str = "severity", confidence: str = "confidence", order: str = "det_seq") -> DataFrame:
    """(key, health): 100 less each issue's weight times confidence, each further issue of a type counting 0.7 of the one before."""
    k = F.row_number().over(Window.partitionBy(key, kind).orderBy(order)) - 1
    weights = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    cost = F.coalesce(F.element_at(weights, F.col(severity)), F.lit(0.0)) * F.col(confidence) * F.pow(F.lit(0.7), k)
    return issues.select(key, cost.alias("_c")).groupBy(key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - exact_sum(half_up(F.col("_c"), 9))))).cast("long").alias("health"))


def prioritize(issues: DataFrame, key: str = "log_id", severity: str = "severity", fixable: str = "can_modify", confidence: str = "confidence", impact: Column | None = None, order: str = "det_seq") -> DataFrame:
    """issues with priority from 1: severity, fixable first, confidence to one place, impact, detection order.

    Confidences that differ by at most a tenth count as equal; as a total order that is rounding, which differs at the edges."""
    impact = F.coalesce("limit_pct", F.col("occurrences").cast("double"), F.lit(0.0)) if impact is None else impact
    w = Window.partitionBy(key).orderBy(severity_rank(F.col(severity)).desc(), F.col(fixable).desc(), F.round(confidence, 1).desc(), impact.desc(), F.col(order))
    return issues.withColumn("priority", F.row_number().over(w))


def at_least(severity: Column, least: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(least) + 1


def dedupe_by_type(issues: DataFrame, key: str = "log_id", kind: str = "type", severity: str = "severity", order: str = "det_seq") -> DataFrame:
    """The most severe issue of each type, the first of equals."""
    w = Window.partitionBy(key, kind).orderBy(severity_rank(F.col(severity)).desc(), F.col(order))
    return issues.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def one_liner(health: Column, urgent: Column, top: Column) -> Column:
    """Words for a score, the number of urgent issues and the category with most."""
    band = F.when(health >= 80, "Mostly healthy").when(health >= 60, "Some concerns").when(health >= 40, "Needs attention").otherwise("Critical issues")
    some = F.when(urgent > 0, F.concat(urgent.cast("string"), F.lit(" critical/high priority issue"), F.when(urgent > 1, "s").otherwise("")))
    return F.concat_ws(" - ", band, some, F.when(top.isNotNull(), F.concat(F.lit("primary: "), top)))


def summary(issues: DataFrame, key: str = "log_id") -> DataFrame:
    """Per log: counts, health, top category and one line."""
    by = issues.groupBy(key, "category").agg(F.count("*").alias("n"), F.min("det_seq").alias("_first"))
    top = by.groupBy(key).agg(F.max_by("category", F.struct("n", -F.col("_first"))).alias("top_category"))
    out = counts_by_severity(issues, [key]).join(health_score(issues, key), key).join(top, key)
    return out.withColumn("one_liner", one_liner(F.col("health"), F.col("critical") + F.col("high"), F.col("top_category")))


def weighted_confidence(issues: DataFrame, keys: list[str], confidence: str = "confidence", severity: str = "severity") -> DataFrame:
    """Mean confidence weighted by severity, 1 to 5."""
    w = severity_rank(F.col(severity))
    return issues.groupBy(*keys).agg((F.sum(F.col(confidence) * w) / F.sum(w)).alias("weighted_confidence"))


def parse_confidence(parsed: Column, total: Column, truncated: Column) -> Column:
    rate = F.when(total > 0, parsed / total).otherwise(0.0)
    score = rate * F.when(rate < 0.7, 0.8).otherwise(1.0) * F.when(truncated, 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def overall_confidence(parsing: Column, detection: Column, attribution: Column, completeness: Column) -> Column:
    return 0.25 * parsing + 0.30 * detection + 0.20 * attribution + 0.25 * completeness


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MEDIUM").when(score >= 0.4, "LOW").otherwise("VERY_LOW")


def parsing_confidence(score: Column, parsed: Column, failed: Column, total: Column, n_types: Column) -> Column:
    """The parser's own score, less for lines that gave nothing and for few kinds of events."""
    rate = parsed / total
    s = score * F.when(rate >= 0.95, 1.0).when(rate >= 0.9, 0.9).otherwise(0.7)
    s = s * F.when(failed > 0, F.greatest(F.lit(0.5), 1 - 2 * failed / total)).otherwise(1.0) * F.when(n_types < 3, 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def _by_mean(mean: Column) -> Column:
    return F.when(mean.isNull() | (mean >= 0.8), 1.0).when(mean >= 0.6, 0.9).otherwise(0.7)


def detection_confidence(mean_confidence: Column, n_events: Column) -> Column:
    """From the issues' mean confidence (null without issues) and the number of events."""
    return _by_mean(mean_confidence) * F.when(n_events < 10, 0.6).when(n_events < 100, 0.9).otherwise(1.0)


def attributed_confidence(n_issues: Column, n_unknown: Column, mean_confidence: Column) -> Column:
    """From the share of issues of unknown origin and the mean confidence of their attribution."""
    share = F.when(n_unknown > 0, F.greatest(F.lit(0.5), 1 - 0.5 * n_unknown / n_issues)).otherwise(1.0)
    return F.when(n_issues > 0, share * _by_mean(mean_confidence)).otherwise(1.0)


# fixed values: what is left of the confidence by kind of truncation; other kinds are like the last
TRUNCATION_FACTORS = {"SIZE_LIMIT": 0.5, "TIMEOUT": 0.6, "LINE_LIMIT": 0.7}


def completeness_confidence(truncated: Column, kind: Column, lost: Column, total: Column, started: Column, finished: Column) -> Column:
    """From how a log was cut, the lines lost (null where unknown), and whether what started has finished."""
    percent = F.floor(100 * lost / (total + lost) + 0.5)
    cut = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TRUNCATION_FACTORS.items() for x in p]), kind), F.lit(0.7))
    cut = cut * F.when(lost > 0, F.greatest(F.lit(0.3), 1 - 0.7 * percent / 100)).otherwise(1.0)
    return F.when(truncated, cut).otherwise(1.0) * F.when(started & ~finished, 0.7).otherwise(1.0)
