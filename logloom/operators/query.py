"""Query engines over events and issues: filters as data, text search, sorting, paging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DML_TYPES, EXCEPTION_TYPES, LIMIT_TYPES, METHOD_TYPES, QUERY_TYPES
from .scoring import at_least

SEARCHED = ("type", "query", "method_name", "class_name", "message", "exception_type", "sobject_type")


def text_search(text: str, *columns: Column) -> Column:
    """Whether any column holds the text, whatever the case; nulls hold nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns])


@dataclass
class EventFilter:
    """Conditions that must all hold; None asks for nothing."""

    types: tuple[str, ...] | None = None
    exclude_types: tuple[str, ...] | None = None
    namespaces: tuple[str, ...] | None = None
    exclude_namespaces: tuple[str, ...] | None = None
    lines: tuple[int, int] | None = None
    times: tuple[int, int] | None = None
    min_duration: float | None = None
    max_duration: float | None = None
    parent_id: int | None = None
    has_children: bool | None = None
    root_only: bool = False
    text: str | None = None
    predicate: Column | None = None

    def condition(self) -> Column:
        """Everything but has_children, as one conjunction."""
        c = F.lit(True)
        if self.types is not None:
            c &= F.col("type").isin(*self.types)
        if self.exclude_types is not None:
            c &= ~F.col("type").isin(*self.exclude_types)
        if self.namespaces is not None:
            c &= F.coalesce(F.col("namespace").isin(*self.namespaces), F.lit(False))
        if self.exclude_namespaces is not None:
            c &= ~F.coalesce(F.col("namespace").isin(*self.exclude_namespaces), F.lit(False))
        if self.lines is not None:
            c &= F.col("line_number").between(*self.lines)
        if self.times is not None:
            c &= F.col("timestamp").between(*self.times)
        if self.min_duration is not None:
            c &= F.col("duration") >= self.min_duration
        if self.max_duration is not None:
            c &= F.col("duration") <= self.max_duration
        if self.parent_id is not None:
            c &= F.col("parent_id") == self.parent_id
        if self.root_only:
            c &= F.col("parent_id") == 0
        if self.text is not None:
            c &= text_search(self.text, *[F.col(x) for x in SEARCHED])
        if self.predicate is not None:
            c &= self.predicate
        return c


def query_events(events: DataFrame, f: EventFilter, log: str = "log_id") -> DataFrame:
    out = events.where(f.condition())
    return out if f.has_children is None else has_children(out, events, f.has_children, log)


def has_children(rows: DataFrame, events: DataFrame, wanted: bool = True, log: str = "log_id", own: str = "id", parent: str = "parent_id") -> DataFrame:
    """rows with (or without) an event whose parent they are."""
    parents = events.select(F.col(log), F.col(parent).alias(own)).where(F.col(own).isNotNull())
    return rows.join(parents, [log, own], "left_semi" if wanted else "left_anti")


@dataclass
class IssueFilter:
    types: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    severities: tuple[str, ...] | None = None
    min_severity: str | None = None
    fixable_only: bool = False
    namespaces: tuple[str, ...] | None = None
    min_confidence: float | None = None
    text: str | None = None
    predicate: Column | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        for name, values in (("type", self.types), ("category", self.categories), ("severity", self.severities), ("namespace", self.namespaces)):
            if values is not None:
                c &= F.coalesce(F.col(name).isin(*values), F.lit(False))
        if self.min_severity is not None:
            c &= at_least(F.col("severity"), self.min_severity)
        if self.fixable_only:
            c &= F.coalesce(F.col("can_modify"), F.lit(False))
        if self.min_confidence is not None:
            c &= F.col("confidence") >= self.min_confidence
        if self.text is not None:
            c &= text_search(self.text, F.col("title"), F.col("type"))
        if self.predicate is not None:
            c &= self.predicate
        return c


def query_issues(issues: DataFrame, f: IssueFilter) -> DataFrame:
    return issues.where(f.condition())


def order_by(df: DataFrame, *keys: tuple[str, bool], tie: str = "id") -> DataFrame:
    """Sorted by (column, descending) keys, nulls last either way, ties by id."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys], F.col(tie))


def paginate(df: DataFrame, page: int, size: int = 50, *keys: tuple[str, bool], tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the page, numbered from 1, and one row with total, total_pages, has_more)."""
    rows = order_by(df, *keys, tie=tie).offset((page - 1) * size).limit(size)
    total = F.count("*")
    return rows, df.agg(total.alias("total"), F.ceil(total / size).alias("total_pages"), (total > page * size).alias("has_more"))


def of_types(events: DataFrame, kind: str) -> DataFrame:
    kinds = {"query": QUERY_TYPES, "dml": DML_TYPES, "method": METHOD_TYPES, "exception": EXCEPTION_TYPES, "limit": LIMIT_TYPES}
    return events.where(F.col("type").isin(*kinds[kind]))


def slow_operations(events: DataFrame, at_least_ms: float) -> DataFrame:
    return events.where(F.col("duration") >= at_least_ms * 1e6)


def count_by(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, value: str, order: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct non-empty values with where each is first seen."""
    return events.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(order).alias("first_id"))


def near_lines(events: DataFrame, centres: DataFrame, within: int, log: str = "log_id", line: str = "line_number", width: int | None = None) -> DataFrame:
    """(centre_id, ...event) of events at most `within` lines from a centre (log, line, id).

    A band join by buckets of lines, so it is an equality join with a range inside a bucket."""
    size = max(1, 2 * within + 1 if width is None else width)
    c = centres.select(log, F.col("id").alias("centre_id"), F.col(line).alias("_at"))
    c = c.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_at") - within) / size), F.floor((F.col("_at") + within) / size))))
    e = events.withColumn("_b", F.floor(F.col(line) / size))
    return e.join(c, [log, "_b"]).where(F.abs(F.col(line) - F.col("_at")) <= within).drop("_b", "_at")


def queries_under_looping_methods(tree: DataFrame) -> DataFrame:
    """Queries with a method around them whose parent has more than one method among its children."""
    from .tree import with_ancestors

    methods = tree.where("type = 'METHOD_ENTRY'").select("log_id", F.col("id").alias("ancestor_id"), "parent_id")
    crowded = methods.groupBy("log_id", "parent_id").agg(F.count("*").alias("n")).where("n > 1")
    loops = methods.join(crowded, ["log_id", "parent_id"], "left_semi").select("log_id", "ancestor_id")
    queries = tree.where("type = 'SOQL_EXECUTE_BEGIN'")
    hit = with_ancestors(tree, F.col("type") == "METHOD_ENTRY").join(loops, ["log_id", "ancestor_id"], "left_semi").select("log_id", "id")
    return queries.join(hit, ["log_id", "id"], "left_semi")


def debug_messages(events: DataFrame, pattern: str, types: tuple[str, ...] = ("USER_DEBUG", "SYSTEM_DEBUG"), message: str = "message") -> DataFrame:
    """Debug events whose message matches the pattern, letters in either case."""
    return events.where(F.col("type").isin(*types) & F.col(message).rlike(f"(?i){pattern}"))


def catalogue(logs: DataFrame, order: list[Column], limit: int | None = None, **filters) -> DataFrame:
    """Logs by column, in an order: name=value, name__min, name__max (both included), name__has (a part of it, letters in either case)."""
    for name, value in filters.items():
        column, _, how = name.partition("__")
        c = F.col(column)
        logs = logs.where(c >= value if how == "min" else c <= value if how == "max" else F.contains(F.lower(c), F.lit(str(value).lower())) if how == "has" else c == value)
    out = logs.orderBy(*order)
    return out if limit is None else out.limit(limit)


def command_query(events: DataFrame, type_part: str | None = None, namespace_part: str | None = None, offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Events whose type and namespace hold the parts (letters in either case), a page of them in the order of ids, and (total, has_more)."""
    if type_part:
        events = events.where(F.contains(F.upper("type"), F.lit(type_part.upper())))
    if namespace_part:
        events = events.where(F.contains(F.lower("namespace"), F.lit(namespace_part.lower())))
    total = events.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > offset + limit)
    return events.orderBy("id").offset(offset).limit(limit), total
