"""Typed events: every token of a handled type becomes one row of a wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import found, number, trim_all
from .. import schema as S

_OPERATIONS = ("insert", "update", "delete", "upsert", "undelete", "merge")


def _seg(i: int, default: str | None = None) -> Column:
    """The i-th segment from 0; the default where it is missing."""
    return F.coalesce(F.get("segments", F.lit(i)), F.lit(default))


def _rest(i: int) -> Column:
    """Segments from the i-th on, joined by pipes."""
    return F.array_join(F.slice("segments", i + 1, F.greatest(F.size("segments") - i, F.lit(0))), "|")


def _last(pattern: str, group: int = 1, where: Column | None = None) -> Column:
    """Group of the pattern in the last segment that matches."""
    hits = F.filter("segments", lambda s: s.rlike(pattern))
    return F.when(F.size(hits) > 0, F.regexp_extract(F.element_at(hits, -1), pattern, group))


def _first(pattern: str, group: int = 1) -> Column:
    hits = F.filter("segments", lambda s: s.rlike(pattern))
    return F.when(F.size(hits) > 0, F.regexp_extract(F.element_at(hits, 1), pattern, group))


def _method() -> dict[str, Column]:
    signature = F.regexp_replace(F.when(F.size("segments") > 1, _rest(1)).otherwise(_seg(0, "")), r"^\[\d+\]\|?", "")
    dotted = r"^([\s\S]*)\.([^.]*)$"
    return {
        "class_name": F.when(signature.rlike(dotted), F.regexp_extract(signature, dotted, 1)).otherwise(signature),
        "method_name": F.when(signature.rlike(dotted), F.regexp_extract(signature, dotted, 2)).otherwise("<unknown>"),
        "source_location": _seg(0),
    }


def _query_begin() -> dict[str, Column]:
    is_query = lambda s: ~s.rlike(r"(?i)^Aggregations:\d+$") & ~s.rlike(r"^\[\d+\]$") & s.rlike(r"(?i)^SELECT|FROM")
    place = F.array_position(F.transform("segments", is_query), True).cast("int")
    query = F.array_join(F.slice("segments", F.greatest(place, F.lit(1)), F.greatest(F.size("segments") - place + 1, F.lit(0))), "|")
    return {"query": F.when(place > 0, trim_all(query)), "aggregations": _last(r"(?i)^Aggregations:(\d+)$").cast("long")}


def _query_plan() -> Column:
    parts = {
        "cardinality": _last(r"(?i)Cardinality[:\s]*(\d+)").cast("long"),
        "relative_cost": _last(r"(?i)RelativeCost[:\s]*([\d.]+)").cast("double"),
        "sobject_type": _last(r"(?i)SobjectType[:\s]*(\w+)"),
        "leading_operation_type": _last(r"(?i)LeadingOperationType[:\s]*(\w+)"),
    }
    any_part = F.coalesce(*[p.cast("string") for p in parts.values()]).isNotNull()
    return F.when(any_part, F.struct(*[c.alias(n) for n, c in parts.items()]))


def _operation() -> dict[str, Column]:
    words = "|".join(_OPERATIONS)
    marked = rf"(?i)^(?:Op:(\w+)|({words}))$"
    hit = F.element_at(F.filter("segments", lambda s: s.rlike(marked)), -1)
    name = F.upper(F.regexp_replace(hit, "(?i)^Op:", ""))
    typed = F.filter("segments", lambda s: ~s.rlike(rf"(?i)^(?:\[\d+\]|Op:\w+|Rows:\d+|{words})$") & s.rlike(r"^(?:(?i:Type):\w+|[A-Z]\w*)$"))
    return {
        "operation": F.when(F.size(F.filter("segments", lambda s: s.rlike(marked))) == 0, "INSERT").when(name.isin(*[o.upper() for o in _OPERATIONS]), name).otherwise("INSERT"),
        "sobject_type": F.when(F.size(typed) > 0, F.regexp_replace(F.element_at(typed, -1), "(?i)^Type:", "")).otherwise("Unknown"),
        "row_count": _last(r"(?i)^Rows:(\d+)$").cast("long"),
    }


def _limit(text: Column, anchor: str) -> dict[str, Column]:
    shape = anchor + r"([^:]+):\s*(\d+)\s+(?i:out\s+of)\s+(\d+)"
    return {"limit_name": trim_all(found(text, shape, 1)), "used": number(text, shape, 2), "max": number(text, shape, 3)}


def _exception() -> dict[str, Column]:
    text = trim_all(F.regexp_replace(F.array_join("segments", "|"), r"^\[[\d\s]*\]\|?", ""))
    shape = r"^([\w.]+(?:(?i:Exception|Error))?):?\s*(.*)$"
    return {"exception_type": F.coalesce(found(text, shape, 1), F.lit("Unknown")), "message": F.coalesce(found(text, shape, 2), text)}


def _debug() -> dict[str, Column]:
    n = F.size("segments")
    return {"level": F.when(n >= 3, _seg(1)), "message": F.when(n >= 3, _rest(2)).when(n == 2, _seg(1)).otherwise(_seg(0, "")), **_source()}


def _source() -> dict[str, Column]:
    return {"source_location": _seg(0), "source_line": number(_seg(0), r"\[(\d+)\]", kind="int")}


def value_type(raw: Column) -> Column:
    """List, Object, null, Boolean, Decimal, Integer or String, as a variable's value is written."""
    parsed = F.try_parse_json(raw)
    is_json = raw.rlike(r"^[{\[]") & parsed.isNotNull()
    return (
        F.when(is_json, F.when(raw.startswith("["), "List").otherwise("Object"))
        .when(raw == "null", "null")
        .when(raw.isin("true", "false"), "Boolean")
        .when(raw.rlike(r"^-?\d+\.\d+$"), "Decimal")
        .when(raw.rlike(r"^-?\d+$"), "Integer")
        .otherwise("String")
    )


def code_unit(description: Column, prefix_type: Column | None = None) -> dict[str, Column]:
    """Type, name, object and operation of a code unit from its description."""
    full = r"(?i)trigger\s+(\w+)\s+on\s+(\w+)(?:\s+trigger\s+event\s+(\w+))?"
    short = r"(?i)(\w+(?:Trigger)?)\s+on\s+(\w+)"
    given = F.lit(None).cast("string") if prefix_type is None else prefix_type
    is_full, is_short = description.rlike(full), description.rlike(short)
    kind = (
        F.when(is_full, "Trigger")
        .when(is_short, F.coalesce(given, F.lit("Trigger")))
        .when(description.startswith("Validation:"), "Validation")
        .when(description.contains("Workflow:"), "Workflow")
        .when(description.contains("Flow:") | description.contains("flow"), "Flow")
        .otherwise(given)
    )
    return {
        "unit_type": kind,
        "unit_name": F.when(is_full, F.regexp_extract(description, full, 1)).when(is_short, F.regexp_extract(description, short, 1)).when(description != "", description),
        "trigger_object": F.when(is_full, F.regexp_extract(description, full, 2)).when(is_short, F.regexp_extract(description, short, 2)),
        "trigger_operation": F.when(is_full & (F.regexp_extract(description, full, 3) != ""), F.regexp_extract(description, full, 3)),
    }


def _code_unit() -> dict[str, Column]:
    named = F.filter("segments", lambda s: ~s.startswith("[") & ~s.rlike(r"^[0-9a-zA-Z]{15,18}$"))
    description = F.when(F.size(named) > 0, F.element_at(named, -1)).otherwise("")
    ids = F.filter("segments", lambda s: s.rlike(r"^01[pq][0-9a-zA-Z]{12,15}$"))
    prefix = F.when(F.size(ids) > 0, F.when(F.element_at(ids, -1).startswith("01q"), "Trigger").otherwise("Class"))
    return code_unit(description, prefix)


def _projections(fixed: bool) -> list[tuple[tuple[str, ...], dict[str, Column]]]:
    joined = F.array_join("segments", "|")
    single = F.regexp_replace(joined, r"^\[\d+\]\|", "") if fixed else joined
    return [
        (S.METHOD_TYPES, _method()),
        (("SOQL_EXECUTE_BEGIN",), _query_begin()),
        (("SOQL_EXECUTE_END",), {"row_count": _last(r"(?i)^Rows:(\d+)$").cast("long")}),
        (("SOQL_EXECUTE_EXPLAIN",), {"query_plan": _query_plan()}),
        (S.DML_TYPES, _operation()),
        (("LIMIT_USAGE",), _limit(single, "^")),
        (("LIMIT_USAGE_FOR_NS",), {"namespace": _seg(0), **_limit(_rest(1), "")}),
        (S.EXCEPTION_TYPES, _exception()),
        (S.PACKAGE_TYPES, {"namespace": _seg(0, "unknown")}),
        (S.DEBUG_TYPES, _debug()),
        (("VARIABLE_ASSIGNMENT",), {"variable_name": _seg(1, "<unknown>"), "raw_value": _seg(2, ""), "value_type": value_type(_seg(2, "")), "address": _seg(3), "is_external": F.coalesce(_seg(0) == "[EXTERNAL]", F.lit(False)), **_source()}),
        (("STATEMENT_EXECUTE",), _source()),
        (S.HEAP_TYPES, {"bytes": F.coalesce(number(_seg(1, ""), r"Bytes:(\d+)"), F.lit(0)), **_source()}),
        (S.SYSTEM_METHOD_TYPES, {"method_signature": F.when(F.size("segments") > 1, _rest(1)).otherwise(_seg(0, "<unknown>")), **_source()}),
        (S.SYSTEM_MODE_TYPES, {"mode": _seg(0, "UNKNOWN")}),
        (("VALIDATION_RULE",), {"rule_id": _seg(0, ""), "rule_name": _seg(1, "")}),
        (("VALIDATION_FORMULA",), {"formula": _seg(0, ""), "field_values": F.when(F.size("segments") > 1, _rest(1))}),
        (("FLOW_VALUE_ASSIGNMENT",), {"interview_id": _seg(0, ""), "variable_name": _seg(1, ""), "raw_value": _rest(2)}),
        (S.FLOW_DETAIL_TYPES, {"interview_id": _seg(0, ""), "detail": _rest(1)}),
        (S.WORKFLOW_TYPES, {"detail": F.when(F.size("segments") > 0, joined)}),
        (S.CODE_UNIT_TYPES, _code_unit()),
    ]


def typed_events(tokens: DataFrame, fixed: bool = True) -> DataFrame:
    """log_id, id, type, timestamp, line_number and the wide fields of every token of a handled type.

    Ids count a log's kept events from 1 in line order. With `fixed`, events of asynchronous jobs are kept and a source line before a limit
    is not taken for its name; without, the former are dropped and the latter is."""
    kept = S.KNOWN_TYPES if fixed else S.HANDLED_TYPES
    src = tokens.where(F.col("event_type").isin(*kept))
    projections = _projections(fixed)
    if fixed:
        projections.append((S.ASYNC_TYPES, {"class_name": F.coalesce(_first(r"^([A-Za-z_][\w.]*)$", 1), F.lit("Unknown")), "detail": F.array_join("segments", "|")}))
    fields = {}
    for name, kind in S.EVENT_FIELDS.items():
        value = None
        for types, cols in projections:
            if name in cols:
                hit = F.col("event_type").isin(*types)
                value = F.when(hit, cols[name].cast(kind)) if value is None else value.when(hit, cols[name].cast(kind))
        fields[name] = F.lit(None).cast(kind) if value is None else value
    number_in_log = F.row_number().over(Window.partitionBy("log_id").orderBy("line_number"))
    return src.select("log_id", number_in_log.cast("long").alias("id"), F.col("event_type").alias("type"), "timestamp", "line_number", *[c.alias(n) for n, c in fields.items()])


def log_stats(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per log: total lines, events, failed lines (lines that gave no event), events by type."""
    total = lines.groupBy("log_id").agg(F.count("*").alias("total_lines"))
    by_type = events.groupBy("log_id", "type").agg(F.count("*").alias("n"))
    per_log = by_type.groupBy("log_id").agg(F.sum("n").alias("n_events"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("events_by_type"))
    out = total.join(per_log, "log_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return out.withColumn("failed_lines", F.col("total_lines") - F.col("n_events"))
