"""Text expressions: tokenizing log lines, normalizing queries and messages, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KNOWN_TYPES, MAX_LINE

#: White space at the ends of a string, including non-breaking and zero-width spaces.
_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def trim_all(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^{_SPACE}", ""), f"{_SPACE}$", "")


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null (not an empty string) where nothing matches."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def number(x: Column, pattern: str, group: int = 1, kind: str = "long") -> Column:
    return found(x, pattern, group).cast(kind)


def split_segments(rest: Column) -> Column:
    """Parts between pipes, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(rest, r"\|"), trim_all), lambda s: s != "")


def event_name(raw: Column) -> Column:
    """Without a suffix in brackets; UNKNOWN for names outside the format."""
    bare = trim_all(F.regexp_replace(raw, r"\[.*$", ""))
    return F.when(bare.isin(*KNOWN_TYPES), bare).otherwise("UNKNOWN")


def tokenize_line(line: Column) -> Column:
    """struct(wall_time, timestamp, event_type, segments), null where the line is no event.

    The time stamp in parentheses must start within the first 16 characters; a line that starts like a header
    (version, space, capital letter) is none."""
    safe = F.substring(F.regexp_replace(line, r"\r$", ""), 1, MAX_LINE)
    head = F.regexp_extract(safe, r"^([0-9][^(]{0,14})\(\s*(-?[0-9]+)[^)]*\)[^|]*\|([^|]*)\|?", 2)
    header = safe.rlike(r"^[0-9][^ ]{0,4} [A-Z]")
    shape = r"^([0-9][^(]{0,14})\(\s*(-?[0-9]+)[^)]*\)[^|]*\|([^|]*)(?:\|([\s\S]*))?$"
    token = F.struct(
        F.trim(F.regexp_extract(safe, shape, 1)).alias("wall_time"),
        head.cast("long").alias("timestamp"),
        event_name(F.regexp_extract(safe, shape, 3)).alias("event_type"),
        split_segments(F.regexp_extract(safe, shape, 4)).alias("segments"),
    )
    # the cheap test of the first character comes first
    return F.when(F.substring(line, 1, 1).between("0", "9") & ~header & (head != ""), token)


def is_continuation(line: Column) -> Column:
    return tokenize_line(line).isNull() & ~line.rlike(r"^\d+\.\d+\s+[A-Z_,;]+") & (trim_all(line) != "")


def ascii_words(pattern: str) -> str:
    """pattern with \\b standing between ASCII letters, digits and _ on one side alone, as \\w has them; Java's own takes other letters for parts of words up to version 18."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def normalize_query(query: Column) -> Column:
    """Literals become ?, white space one space, letters upper case."""
    out = F.regexp_replace(query, r"'[^']*'", "'?'")
    out = F.regexp_replace(out, ascii_words(r"\b[0-9]+\b"), "?")
    return F.upper(F.trim(F.regexp_replace(out, r"\s+", " ")))


def query_object(query: Column) -> Column:
    return found(query, r"(?i)FROM\s+(\w+)")


def normalize_error(text: Column) -> Column:
    """Record ids become ID, other digit runs N."""
    return F.regexp_replace(F.regexp_replace(text, ascii_words(r"\b[a-zA-Z0-9]{15,18}\b"), "ID"), r"[0-9]+", "N")


def hash31(text: Column) -> Column:
    """31-hash of the characters as a signed 32-bit number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))


def keywords(text: Column) -> Column:
    """Distinct words of more than two characters, in lower case, first seen first."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty arrays are alike, an empty and a full one are not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def format_duration(ns: Column) -> Column:
    """Microseconds, milliseconds or seconds with up to two places."""
    return (
        F.when(ns.isNull(), F.lit(None).cast("string"))
        .when(ns < 1_000_000, F.format_string("%.0fµs", ns / 1000.0))
        .when(ns < 1_000_000_000, F.format_string("%.2fms", ns / 1e6))
        .otherwise(F.format_string("%.2fs", ns / 1e9))
    )


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5).cast("long")
