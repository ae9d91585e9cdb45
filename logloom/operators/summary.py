"""Log summaries that fit a token budget, for all logs at once.

A summary is a JSON object; its tokens are its length over 3.5, rounded up. What is over the budget goes in a fixed order, from the end of each list: recommendations
down to two, limit warnings down to one, issues down to one, then limitations to one. Nothing is removed in a loop: a list's JSON length is
a running sum over its elements, so how many of them fit is read off it.

Lengths are those of the JSON text in UTF-16 units, with absent fields left out and whole numbers without a decimal point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, CHARS_PER_TOKEN = 500, 3.5
ISSUES, WARNINGS, RECOMMENDATIONS, DESCRIPTION = 3, 3, 5, 60
# fixed values: least numbers of elements that trimming leaves
LEAST = {"recommendations": 2, "limitWarnings": 1, "topIssues": 1}
# fixed values: signs of limit use, and advice for sick logs
SIGNS = {90: "\U0001f534", 75: "\U0001f7e1", 0: "\U0001f7e2"}
GENERIC_ADVICE = "Consider enabling debug logging at FINEST level for more detail"
ISSUE = "array<struct<type:string,desc:string,sev:string,fixable:boolean>>"


def shortened(text: Column, most: int = DESCRIPTION) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def compact_issues(ranked: DataFrame, most: int = ISSUES) -> DataFrame:
    """(log_id, topIssues): the first issues by priority, short."""
    short = F.struct(F.replace("type", F.lit("_"), F.lit(" ")).alias("type"), shortened(F.col("title")).alias("desc"), F.substring("severity", 1, 1).alias("sev"), F.col("can_modify").alias("fixable"))
    listed = F.sort_array(F.collect_list(F.struct("priority", short.alias("i"))))
    return ranked.where(F.col("priority") <= most).groupBy("log_id").agg(F.transform(listed, lambda x: x["i"]).alias("topIssues"))


def limit_warnings(limits: DataFrame, most: int = WARNINGS, order: str = "id") -> DataFrame:
    """(log_id, limitWarnings) of limits (log_id, limit_name, used, max, pct) over half used: the most used first, then by `order`."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("pct"), order))
    sign = F.when(F.col("pct") >= 90, SIGNS[90]).when(F.col("pct") >= 75, SIGNS[75]).otherwise(SIGNS[0])
    said = F.format_string("%s %s: %s/%s (%s%%)", sign, "limit_name", F.col("used").cast("string"), F.col("max").cast("string"), F.floor(F.col("pct") + 0.5).cast("string"))
    near = limits.where("pct > 50").withColumns({"_place": place, "_said": said}).where(F.col("_place") <= most)
    return near.groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_said"))), lambda x: x["_said"]).alias("limitWarnings"))


def recommended(advice: DataFrame, most: int = RECOMMENDATIONS) -> DataFrame:
    """(log_id, recommendations): different texts of advice (log_id, priority, place, text), in order of issue and place."""
    first = advice.groupBy("log_id", "text").agg(F.min(F.struct("priority", "place")).alias("_at"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("log_id").orderBy("_at", "text"))).where(F.col("_n") <= most)
    return ranked.groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("recommendations"))


def status_line(health: Column, urgent: Column, issues: Column) -> Column:
    band = F.when(health >= 90, "Excellent").when(health >= 75, "Good").when(health >= 60, "Fair").when(health >= 40, "Poor").otherwise("Critical")
    some = lambda n, one: F.concat(F.lit(" - "), n.cast("string"), F.lit(one), F.when(n > 1, "s").otherwise(""))
    return F.concat(band, F.when(urgent > 0, some(urgent, " high priority issue")).when(issues > 0, F.concat(some(issues, " issue"), F.lit(" detected"))).otherwise(" - No issues detected"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def _element_lengths(items: Column, strings: bool) -> Column:
    return F.transform(items, lambda x: utf16_length(F.to_json(F.array(x))) - 2 if strings else utf16_length(F.to_json(x)))


def _of_first(lengths: Column, n: Column) -> Column:
    """Length of the first n elements with their commas."""
    return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x) + F.greatest(F.lit(0), n - 1)


def _fitting(lengths: Column, least: int, others: Column, room: Column) -> Column:
    """The most elements, no fewer than `least` if there are so many, with which the text keeps within room."""
    n, low = F.size(lengths), F.least(F.lit(least), F.size(lengths))
    return F.coalesce(F.array_max(F.filter(F.sequence(low, n), lambda k: others + _of_first(lengths, k) <= room)), low)


def tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def fit_budget(summaries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """log_id, summary (JSON), token_count, and how many of each list stay: n_recommendations, n_warnings, n_issues, n_limitations.

    summaries: log_id, health, status, metrics (struct), topIssues, limitWarnings, recommendations, context: a struct of what else the summary says about itself, with truncated,
    namespaces, confidence and what else it may have, and limitations beside it. Null lists count as empty."""
    src = summaries.withColumns({
        "topIssues": F.coalesce(F.col("topIssues").cast(ISSUE), F.array().cast(ISSUE)),
        **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("limitWarnings", "recommendations", "limitations")},
    })

    def written(issues: Column, warnings: Column, advice: Column, limits: Column, count: Column) -> Column:
        context = F.col("context").withField("limitations", limits)
        whole = F.struct(F.col("log_id").cast("string").alias("logId"), "health", "status", "metrics", issues.alias("topIssues"), warnings.alias("limitWarnings"), advice.alias("recommendations"), context.alias("aiContext"), count.alias("tokenCount"))
        # a whole number is written as one
        return F.regexp_replace(F.to_json(whole), r'("confidence":\d+)\.0(?=[,}])', "$1")

    empty = lambda c: F.slice(c, F.lit(1), F.lit(0))
    src = src.withColumn("_base", utf16_length(written(empty("topIssues"), empty("limitWarnings"), empty("recommendations"), empty("limitations"), F.lit(0))))
    src = src.withColumns({"_i": _element_lengths(F.col("topIssues"), False), "_w": _element_lengths(F.col("limitWarnings"), True), "_r": _element_lengths(F.col("recommendations"), True), "_l": _element_lengths(F.col("limitations"), True)})
    part = lambda c: _of_first(F.col(c), F.size(c))
    src = src.withColumn("_first", tokens(F.col("_base") + part("_i") + part("_w") + part("_r") + part("_l")))
    # the count is written into what is trimmed, where a single zero stood
    src = src.withColumn("_fixed", F.col("_base") + F.when(F.col("_first") > budget, F.length(F.col("_first").cast("string")) - 1).otherwise(0))
    room = F.lit(int(budget * CHARS_PER_TOKEN))
    src = src.withColumn("n_recommendations", _fitting(F.col("_r"), LEAST["recommendations"], F.col("_fixed") + part("_i") + part("_w") + part("_l"), room))
    advice = _of_first(F.col("_r"), F.col("n_recommendations"))
    src = src.withColumn("n_warnings", _fitting(F.col("_w"), LEAST["limitWarnings"], F.col("_fixed") + part("_i") + advice + part("_l"), room))
    advice = advice + _of_first(F.col("_w"), F.col("n_warnings"))
    src = src.withColumn("n_issues", _fitting(F.col("_i"), LEAST["topIssues"], F.col("_fixed") + advice + part("_l"), room))
    advice = advice + _of_first(F.col("_i"), F.col("n_issues"))
    over = F.col("_fixed") + advice + part("_l") > room
    src = src.withColumn("n_limitations", F.when(over, F.least(F.lit(1), F.size("_l"))).otherwise(F.size("_l")))
    src = src.withColumn("token_count", tokens(F.col("_fixed") + advice + _of_first(F.col("_l"), F.col("n_limitations"))))
    first = lambda c, n: F.slice(c, F.lit(1), F.col(n))
    text = written(first("topIssues", "n_issues"), first("limitWarnings", "n_warnings"), first("recommendations", "n_recommendations"), first("limitations", "n_limitations"), F.col("token_count"))
    return src.select("log_id", text.alias("summary"), "token_count", "n_recommendations", "n_warnings", "n_issues", "n_limitations")


def with_generic_advice(summaries: DataFrame, most: int = RECOMMENDATIONS) -> DataFrame:
    """One more recommendation for logs in bad health that have room for it."""
    have = F.coalesce("recommendations", F.array().cast("array<string>"))
    return summaries.withColumn("recommendations", F.when((F.col("health") < 50) & (F.size(have) < most), F.concat(have, F.array(F.lit(GENERIC_ADVICE)))).otherwise(have))
