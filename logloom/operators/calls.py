"""Method calls whose exits don't come in order: an exit closes the nearest open call of its own name.

A stack that is searched from the top for an exit's name, and loses that entry alone, is two questions without a sequential pass:

* Which entry does an exit close? Entries of other names don't matter, so it is bracket matching among the events of one name: at each level of
  a name's depth entries and exits alternate. An exit at depth zero closes nothing.
* Which call lies on top when one has closed? The one that started last among those that started before the exit and close after it. Rows are dealt to
  buckets; calls that start or close in the exit's bucket are compared there, and calls that span it whole are
  looked up: a call is filed under the few dyadic runs of buckets that make up its span, each run keeps its latest start, and
  a bucket asks the runs that hold it (one a power of two).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENTRIES, _EXITS = ("METHOD_ENTRY", "CONSTRUCTOR_ENTRY"), ("METHOD_EXIT", "CONSTRUCTOR_EXIT")
#: Rows of a log in one bucket.
_BUCKET = 64


def paired_calls(events: DataFrame, name: Column, entries=_ENTRIES, exits=_EXITS, time: str = "timestamp") -> DataFrame:
    """(log_id, id, close_id, name, start_row, close_row, span, n_rows) of every call: close_id, close_row and span are null if nothing closes it.

    span is the exit's own duration if it has one, else the time from entry to exit. Rows count a log's entries and exits."""
    log = Window.partitionBy("log_id")
    is_entry = F.col("type").isin(*entries)
    own = F.col("duration").cast("double") if "duration" in events.columns else F.lit(None).cast("double")
    rows = events.where(F.col("type").isin(*entries, *exits)).select("log_id", "id", name.alias("name"), is_entry.alias("opens"), F.col(time).alias("at"), own.alias("own"))
    rows = rows.withColumns({"row": F.row_number().over(log.orderBy("id")), "n_rows": F.count("*").over(log)})
    by_name = Window.partitionBy("log_id", "name").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(by_name))
    depth = F.col("run") - F.least(F.lit(0), F.min("run").over(by_name))
    rows = rows.withColumn("depth", depth).withColumn("before", F.coalesce(F.lag("depth").over(Window.partitionBy("log_id", "name").orderBy("row")), F.lit(0)))
    rows = rows.where("opens or before > 0").withColumn("level", F.when(F.col("opens"), F.col("depth")).otherwise(F.col("before")))
    # at a level an entry is followed by the exit that closes it, or by nothing
    next_ = lambda c: F.lead(c).over(Window.partitionBy("log_id", "name", "level").orderBy("row"))
    pairs = rows.withColumn("close", next_(F.struct("id", "row", "at", "own"))).where("opens")
    span = F.coalesce("close.own", (F.col("close.at") - F.col("at")).cast("double"))
    return pairs.select("log_id", "id", F.col("close.id").alias("close_id"), "name", F.col("row").alias("start_row"), F.col("close.row").alias("close_row"), span.alias("span"), "n_rows")


def _bucket(row: Column) -> Column:
    return F.floor(row / _BUCKET)


def calls_on_top(calls: DataFrame) -> DataFrame:
    """(log_id, id, parent_id) of every closed call: the call on top when it has closed, if there is one."""
    closed = calls.where("close_row is not null")
    asks = closed.select("log_id", "id", F.col("close_row").alias("x"), _bucket(F.col("close_row")).alias("b"))
    last = F.coalesce("close_row", F.col("n_rows") + 1)  # what nothing closes stays open to the end
    spans = calls.select("log_id", F.col("start_row").alias("s"), last.alias("e"))
    inside = spans.withColumn("b", F.explode(F.array_distinct(F.array(_bucket(F.col("s")), _bucket(F.col("e"))))))
    near = asks.join(inside, ["log_id", "b"]).where("s < x and e > x").groupBy("log_id", "id").agg(F.max("s").alias("near"))
    # runs of whole buckets between the first and the last, as dyadic pieces: at each power of two one at either end at most
    lo, hi = _bucket(F.col("s")) + 1, _bucket(F.col("e"))  # hi is beyond the last one
    piece = lambda k: F.struct(F.ceil(F.col("lo") / F.pow(F.lit(2), k)).alias("l"), F.floor(F.col("hi") / F.pow(F.lit(2), k)).alias("r"))
    filed = spans.select("log_id", "s", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    filed = filed.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("hi") + 1)).cast("int")))).withColumn("p", piece(F.col("k"))).where("p.l < p.r")
    ends = F.array_compact(F.array(F.when(F.col("p.l") % 2 == 1, F.col("p.l")), F.when(F.col("p.r") % 2 == 1, F.col("p.r") - 1)))
    latest = filed.select("log_id", "s", "k", F.explode(F.array_distinct(ends)).alias("run")).groupBy("log_id", "k", "run").agg(F.max("s").alias("s"))
    buckets = asks.select("log_id", "b").distinct()
    power = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("b") + 2)).cast("int")))
    held = buckets.withColumn("k", power).withColumn("run", F.floor(F.col("b") / F.pow(F.lit(2), F.col("k")))).join(latest, ["log_id", "k", "run"]).groupBy("log_id", "b").agg(F.max("s").alias("far"))
    found = asks.join(near, ["log_id", "id"], "left").join(held, ["log_id", "b"], "left").select("log_id", "id", F.greatest("near", "far").alias("s")).where("s is not null")
    return found.join(calls.select("log_id", F.col("id").alias("parent_id"), F.col("start_row").alias("s")), ["log_id", "s"]).select("log_id", "id", "parent_id")


def signature_calls(events: DataFrame, name: Column | None = None, entries=_ENTRIES, exits=_EXITS, time: str = "timestamp") -> DataFrame:
    """(log_id, id, close_id, method, inclusive, exclusive, parent_id) of every closed call.

    exclusive is inclusive less the inclusive times of the calls that closed with this one on top, and no less than zero."""
    who = F.concat_ws(".", F.coalesce("class_name", F.lit("Unknown")), F.coalesce("method_name", F.lit("Unknown"))) if name is None else name
    calls = paired_calls(events, who, entries, exits, time)
    closed = calls.where("close_id is not null").join(calls_on_top(calls), ["log_id", "id"], "left")
    inner = closed.where("parent_id is not null").groupBy("log_id", F.col("parent_id").alias("id")).agg(F.sum("span").alias("inner"))
    out = closed.join(inner, ["log_id", "id"], "left")
    exclusive = F.greatest(F.lit(0.0), F.col("span") - F.coalesce("inner", F.lit(0.0)))
    return out.select("log_id", "id", "close_id", F.col("name").alias("method"), F.col("span").alias("inclusive"), exclusive.alias("exclusive"), "parent_id")
