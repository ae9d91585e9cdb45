"""What an exception's type tells, and the frames that follow it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: exception type -> category, whether code can mend it, usual cause
EXCEPTIONS = {
    "System.NullPointerException": ("NULL_REFERENCE", True, "Accessing property or method on null variable"),
    "System.LimitException": ("GOVERNOR_LIMIT", True, "Governor limit exceeded (SOQL, DML, CPU, Heap)"),
    "System.QueryException": ("QUERY", True, "Query returned no rows with limit or list index out of bounds"),
    "System.DmlException": ("DML", True, "DML operation failed (validation, trigger, required field)"),
    "System.CalloutException": ("CALLOUT", True, "HTTP callout failed (timeout, endpoint, auth)"),
    "System.TypeException": ("TYPE", True, "Invalid type conversion or cast"),
    "System.ListException": ("COLLECTION", True, "List index out of bounds"),
    "System.MathException": ("MATH", True, "Division by zero or overflow"),
    "System.AsyncException": ("ASYNC", True, "Async operation limit or chaining issue"),
    "System.SecurityException": ("SECURITY", True, "CRUD/FLS violation or sharing issue"),
    "System.SObjectException": ("SOBJECT", True, "Field not queryable or accessible"),
}
_UNKNOWN = ("UNKNOWN", True, "Unknown exception type")


def exception_info(kind: Column) -> Column:
    """struct(category, can_fix, cause) of an exception type: of its full name, else of the first whose last part it ends with."""
    fact = lambda v: F.struct(F.lit(v[0]).alias("category"), F.lit(v[1]).alias("can_fix"), F.lit(v[2]).alias("cause"))
    exact = F.element_at(F.create_map(*[x for k, v in EXCEPTIONS.items() for x in (F.lit(k), fact(v))]), kind)
    by_end = [F.when(F.endswith(kind, F.lit(k.rsplit(".", 1)[-1])), fact(v)) for k, v in EXCEPTIONS.items()]
    return F.coalesce(exact, *by_end, fact(_UNKNOWN))


def stack_frames(lines: Column) -> Column:
    """The lines of an array that are frames, trimmed: of a class or trigger, after `at`, or of a line number."""
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(r"^(Class|Trigger)\.\w+|^at\s+|(?i:^line\s+\d+)"))
