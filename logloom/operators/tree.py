"""Call trees of many logs at once, by windows: no stack, no loop over a log.

With d = 1 for an entry, -1 for an exit and 0 otherwise, a log's depth after an event is the running sum of d less its running
minimum below zero (a stack never pops its root). An event's parent is the latest earlier entry that left the
depth at which the event starts: coming back to a depth after dropping below it takes a newer entry there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTRY_TYPES, EXIT_TYPES

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def clamped_depth(events: DataFrame, step: Column, log: str = "log_id", order: str = "id", name: str = "depth_after") -> DataFrame:
    """events with the running sum of step, floored at zero at every row."""
    w = Window.partitionBy(log).orderBy(order).rowsBetween(*_UP_TO_HERE)
    summed = events.withColumn("_s", F.sum(step).over(w).cast("long"))
    return summed.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def entry_exit_step(entries=ENTRY_TYPES, exits=EXIT_TYPES, kind: str = "type") -> Column:
    return F.when(F.col(kind).isin(*entries), 1).when(F.col(kind).isin(*exits), -1).otherwise(0)


def call_tree(events: DataFrame, entries=ENTRY_TYPES, exits=EXIT_TYPES, root: int = 0, time: str = "timestamp") -> DataFrame:
    """events with parent_id (root at the top), depth (of the event, 0 at the top) and duration.

    An exit is the child of the entry that it closes; an entry's duration is the time to its exit, null if it has none or it isn't positive."""
    step = entry_exit_step(entries, exits)
    deep = clamped_depth(events, step)
    w = Window.partitionBy("log_id").orderBy("id")
    deep = deep.withColumn("depth", F.lag("depth_after", 1, 0).over(w))
    is_entry = F.col("type").isin(*entries)
    asks = deep.select("*", F.col("depth").alias("_level"), F.lit(1).alias("_asks"))
    gives = deep.where(is_entry).select("*", F.col("depth_after").alias("_level"), F.lit(0).alias("_asks"))
    at_level = Window.partitionBy("log_id", "_level").orderBy("id", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, -1)
    both = asks.unionByName(gives).withColumn("parent_id", F.last(F.when(F.col("_asks") == 0, F.col("id")), ignorenulls=True).over(at_level))
    tree = both.where("_asks = 1").drop("_level", "_asks", "depth_after").withColumn("parent_id", F.coalesce("parent_id", F.lit(root)))
    closes = tree.where(F.col("type").isin(*exits)).select("log_id", F.col("parent_id").alias("id"), F.col(time).alias("_end"), F.col("id").alias("close_id"))
    out = tree.drop("duration", "close_id").join(closes, ["log_id", "id"], "left")
    return out.withColumn("duration", F.when(F.col("_end") > F.col(time), F.col("_end") - F.col(time))).drop("_end")


#: Rows of a log in one bucket of the interval join.
_BUCKET = 256


def with_ancestors(tree: DataFrame, pick: Column, name: str = "ancestor") -> DataFrame:
    """(log_id, id, <name>_id) for every event and every picked entry around it.

    An entry is an ancestor of the events between it and its exit (or the log's end); no recursion. Entries are
    dealt to the row buckets that they span, so a long log is many small equality joins and not one of all pairs."""
    log = Window.partitionBy("log_id")
    rows = tree.select("log_id", "id", "close_id", pick.alias("_pick"), F.row_number().over(log.orderBy("id")).alias("_row"), F.count("*").over(log).alias("_last"))
    ends = rows.select("log_id", F.col("id").alias("close_id"), F.col("_row").alias("_end"))
    entries = rows.where("_pick").join(ends, ["log_id", "close_id"], "left")
    entries = entries.select("log_id", F.col("id").alias(f"{name}_id"), F.col("_row").alias("_start"), F.coalesce("_end", "_last").alias("_stop")).where("_stop > _start")
    bucket = lambda row: F.floor(row / _BUCKET)
    a = entries.withColumn("_b", F.explode(F.sequence(bucket(F.col("_start") + 1), bucket(F.col("_stop")))))
    e = rows.select("log_id", "id", "_row", bucket(F.col("_row")).alias("_b"))
    return e.join(a, ["log_id", "_b"]).where("_row > _start and _row <= _stop").select("log_id", "id", f"{name}_id")


def ancestors(tree: DataFrame, of: Column) -> DataFrame:
    """(log_id, id, ancestor_id) of the events picked by `of`."""
    entries = F.col("type").isin(*ENTRY_TYPES)
    return with_ancestors(tree, entries).join(tree.where(of).select("log_id", "id"), ["log_id", "id"], "left_semi")


def subtree_duration(tree: DataFrame, entries=ENTRY_TYPES) -> DataFrame:
    """(log_id, id, total): an entry's duration and those of all events under it.

    What lies under an entry are the events up to its exit (or the log's end): a difference of two running sums, without a row per ancestor."""
    log = Window.partitionBy("log_id")
    run = F.sum(F.coalesce("duration", F.lit(0))).over(log.orderBy("id").rowsBetween(*_UP_TO_HERE))
    rows = tree.select("log_id", "id", "type", "close_id", "duration", run.alias("_run"), F.sum(F.coalesce("duration", F.lit(0))).over(log).alias("_all"))
    ends = rows.where(~F.col("type").isin(*entries)).select("log_id", F.col("id").alias("close_id"), F.col("_run").alias("_end"))
    own = rows.where(F.col("type").isin(*entries)).join(ends, ["log_id", "close_id"], "left")
    return own.select("log_id", "id", (F.coalesce("duration", F.lit(0)) + F.when(F.col("close_id").isNull(), F.col("_all")).otherwise(F.col("_end")) - F.col("_run")).alias("total"))


def tree_depth(tree: DataFrame) -> DataFrame:
    return tree.groupBy("log_id").agg((F.max("depth") + 1).alias("tree_depth"))


def boundary_crossings(events: DataFrame, value: Column, log: str = "log_id", order: str = "id") -> DataFrame:
    """Events whose value differs from the event's before, with both values and the direction."""
    w = Window.partitionBy(log).orderBy(order)
    moved = events.select(log, order, value.alias("to_ns"), F.lag(value).over(w).alias("from_ns"), F.row_number().over(w).alias("_n"))
    crossed = moved.where(~F.col("from_ns").eqNullSafe(F.col("to_ns")) & (F.col("_n") > 1)).drop("_n")
    return crossed.withColumn("direction", F.when(F.col("from_ns").isNull(), "USER_TO_MANAGED").when(F.col("to_ns").isNull(), "MANAGED_TO_USER").otherwise("MANAGED_TO_MANAGED"))


def skipped_lines(statements: DataFrame, log: str = "log_id", line: str = "source_line") -> DataFrame:
    """(log, line) of every line between two neighbouring executed lines."""
    w = Window.partitionBy(log).orderBy(line)
    gaps = statements.select(log, line).where(F.col(line) > 0).withColumn("_p", F.lag(line).over(w)).where(F.col(line) - F.col("_p") > 1)
    return gaps.select(log, F.explode(F.sequence(F.col("_p") + 1, F.col(line) - 1)).alias(line))


def variable_history(assignments: DataFrame, log: str = "log_id", name: str = "variable_name", order: str = "id", value: str = "raw_value") -> DataFrame:
    """(log, name, n, history): values in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return assignments.groupBy(log, name).agg(F.count("*").alias("n"), F.transform(rows, lambda r: r["v"]).alias("history"))


def execution_trace(events: DataFrame) -> DataFrame:
    """(log_id, id, line, timestamp, kind, detail) of statements, variables and debug messages that have a source line."""
    parts = (("STATEMENT_EXECUTE",), "statement", F.lit(None)), (("VARIABLE_ASSIGNMENT",), "variable", F.col("variable_name")), (("USER_DEBUG", "SYSTEM_DEBUG"), "debug", F.col("message"))
    out = None
    for types, kind, detail in parts:
        some = events.where(F.col("type").isin(*types) & (F.col("source_line") > 0)).select("log_id", "id", F.col("source_line").alias("line"), "timestamp", F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
        out = some if out is None else out.unionByName(some)
    return out


# fixed values: types of exits and of the entries that they close
EXIT_OF = {
    "METHOD_EXIT": "METHOD_ENTRY",
    "CONSTRUCTOR_EXIT": "CONSTRUCTOR_ENTRY",
    "CODE_UNIT_FINISHED": "CODE_UNIT_STARTED",
    "SOQL_EXECUTE_END": "SOQL_EXECUTE_BEGIN",
    "DML_END": "DML_BEGIN",
    "EXECUTION_FINISHED": "EXECUTION_STARTED",
    "FLOW_START_INTERVIEW_END": "FLOW_START_INTERVIEW_BEGIN",
    "FLOW_ELEMENT_END": "FLOW_ELEMENT_BEGIN",
    "SYSTEM_METHOD_EXIT": "SYSTEM_METHOD_ENTRY",
    "SYSTEM_CONSTRUCTOR_EXIT": "SYSTEM_CONSTRUCTOR_ENTRY",
    "SYSTEM_MODE_EXIT": "SYSTEM_MODE_ENTER",
}


def matching_entries(events: DataFrame) -> DataFrame:
    """(log_id, id, entry_id) of every exit that an entry of its type matches: a log's first; methods also match by class and name."""
    names = F.create_map(*[F.lit(x) for p in EXIT_OF.items() for x in p])
    method = F.col("type").isin("METHOD_ENTRY", "METHOD_EXIT", "CONSTRUCTOR_ENTRY", "CONSTRUCTOR_EXIT")
    who = F.when(method, F.struct("class_name", "method_name"))
    entries = events.where(F.col("type").isin(*EXIT_OF.values())).groupBy("log_id", F.col("type").alias("_type"), who.alias("_who")).agg(F.min("id").alias("entry_id"))
    exits = events.select("log_id", "id", F.element_at(names, F.col("type")).alias("_t"), who.alias("_w")).where("_t is not null").withColumnRenamed("log_id", "_log")
    return exits.join(entries, (F.col("_log") == F.col("log_id")) & (F.col("_t") == F.col("_type")) & F.col("_w").eqNullSafe(F.col("_who"))).select("log_id", "id", "entry_id")
