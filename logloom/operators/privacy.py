"""Personal data: finding, classifying and redacting it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_words, hash31
from ..schema import SENSITIVITIES, ordinal

# fixed values: kind -> (sensitivity, placeholder, pattern, cheap test that must hold before the pattern is tried)
PATTERNS = {
    "email": ("HIGH", "EMAIL", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@"),
    "phone": ("HIGH", "PHONE", r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", r"\d{3}"),
    "ssn": ("CRITICAL", "SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", r"\d[-\s]\d"),
    "credit_card": ("CRITICAL", "CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"\d{4}"),
    "ip_address": ("MEDIUM", "IP", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", r"\d\.\d"),
    "record_id": ("LOW", "SF_ID", r"\b[a-zA-Z0-9]{15}(?:[a-zA-Z0-9]{3})?\b", ""),
    "session_token": ("CRITICAL", "SESSION", r"""(?i)\b(?:session[_-]?id|sid|token)[=:]\s*['"]?[\w-]{20,}['"]?""", r"(?i)session|sid|token"),
    "api_key": ("CRITICAL", "API_KEY", r"""(?i)\b(?:api[_-]?key|apikey|access[_-]?token|bearer)[=:\s]+['"]?[\w-]{20,}['"]?""", r"(?i)api|key|bearer|access"),
    "password": ("CRITICAL", "PASSWORD", r"""(?i)\b(?:password|passwd|pwd|secret)[=:\s]+['"]?[^\s'"]{4,}['"]?""", r"(?i)password|passwd|pwd|secret"),
}
PATTERNS = {name: (level, mark, ascii_words(pattern), guard) for name, (level, mark, pattern, guard) in PATTERNS.items()}
# fixed values: field names (letters in either case) by sensitivity and what they tell, the first that fits decides
FIELD_RULES = (
    (r"password|passwd|pwd|secret", "CRITICAL", "Password field"),
    (r"ssn|social.?security", "CRITICAL", "SSN field"),
    (r"credit.?card|card.?number|ccn", "CRITICAL", "Credit card field"),
    (r"api.?key|access.?token|bearer", "CRITICAL", "API key/token field"),
    (r"session.?id|session.?token", "CRITICAL", "Session field"),
    (r"email|e-mail", "HIGH", "Email field"),
    (r"phone|mobile|cell|fax", "HIGH", "Phone field"),
    (r"address|street|city|zip|postal", "HIGH", "Address field"),
    (r"birth.?date|dob|date.?of.?birth", "HIGH", "Date of birth field"),
    (r"name|first.?name|last.?name|full.?name", "MEDIUM", "Name field"),
    (r"user.?name|username", "MEDIUM", "Username field"),
    (r"ip.?address|client.?ip", "MEDIUM", "IP address field"),
    (r"id$|_id$|Id$", "LOW", "ID field"),
)


@dataclass
class Policy:
    """What to redact: patterns of at least min_sensitivity, or those named; plus own patterns (name -> regex)."""

    min_sensitivity: str | None = "MEDIUM"
    names: tuple[str, ...] | None = None
    never: tuple[str, ...] = ()
    own: dict[str, str] = field(default_factory=dict)

    def chosen(self) -> list[tuple[str, str, str]]:
        """(placeholder, pattern, cheap test) in the order they are applied."""
        out = []
        for name, (level, mark, pattern, guard) in PATTERNS.items():
            fits = name in self.names if self.names is not None else self.min_sensitivity is not None and SENSITIVITIES.index(level) >= SENSITIVITIES.index(self.min_sensitivity)
            if fits and name not in self.never:
                out.append((mark, pattern, guard))
        return out + [(n.upper(), p, "") for n, p in self.own.items()]


STRICT, MODERATE, MINIMAL, OFF = Policy("LOW"), Policy("MEDIUM"), Policy("CRITICAL"), Policy(None)


def _guarded(text: Column, guard: str) -> Column:
    return F.lit(True) if not guard else F.contains(text, F.lit("@")) if guard == "@" else text.rlike(guard)


def pii_count(text: Column, name: str) -> Column:
    _, _, pattern, guard = PATTERNS[name]
    return F.when(_guarded(text, guard), F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long")


def text_sensitivity(text: Column) -> Column:
    """The highest sensitivity of any match, NONE without one."""
    out = None
    for level in reversed(SENSITIVITIES[1:]):
        hit = F.lit(False)
        for own, _, pattern, guard in PATTERNS.values():
            if own == level:
                hit |= _guarded(text, guard) & text.rlike(pattern)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("NONE")


def _first_rule(name: Column, part: int, other: str) -> Column:
    out = F.lit(other)
    for rule in reversed(FIELD_RULES):
        out = F.when(name.rlike(f"(?i){rule[0]}"), rule[part]).otherwise(out)
    return out


def field_sensitivity(name: Column) -> Column:
    return _first_rule(name, 1, "NONE")


def field_reason(name: Column) -> Column:
    return _first_rule(name, 2, "No sensitive pattern detected in name")


def classify_field(name: Column, value: Column) -> Column:
    """struct(inferred, actual, combined): by the field's name, by its value, and the higher one."""
    inferred, actual = field_sensitivity(name), text_sensitivity(value)
    return F.struct(inferred.alias("inferred"), actual.alias("actual"), max_sensitivity(inferred, actual).alias("combined"))


def max_sensitivity(a: Column, b: Column) -> Column:
    return F.when(ordinal(a, SENSITIVITIES) >= ordinal(b, SENSITIVITIES), a).otherwise(b)


def likely_pii(text: Column) -> Column:
    """A cheap test: an address, a number grouped like a phone's or a card's, or a word for credentials."""
    return (F.contains(text, F.lit("@")) & text.rlike(r"\.\w{2,}")) | text.rlike(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}|\d{4}[-\s]?\d{4}|(?i:password|secret|token|api.?key)")


def redact(text: Column, policy: Policy = MODERATE) -> Column:
    """Every match replaced by its placeholder in brackets, pattern after pattern; all in the JVM."""
    for mark, pattern, guard in policy.chosen():
        text = F.when(_guarded(text, guard), F.regexp_replace(text, pattern, f"[{mark}]")).otherwise(text)
    return text


def redact_map(values: Column, policy: Policy = MODERATE) -> Column:
    return F.transform_values(values, lambda k, v: redact(v, policy))


def redact_numbered(policy: Policy = MODERATE):
    """An Arrow function of texts: the last match of a pattern gets [X], those before it [X_1], [X_2] ... from the left's far end."""
    import re

    chosen = [(mark, re.compile(pattern.replace("[A-Z|a-z]", "[A-Za-z|]"), re.ASCII)) for mark, pattern, _ in policy.chosen()]

    def one(text):
        if text is None:
            return None
        for mark, pattern in chosen:
            hits = list(pattern.finditer(text))
            for i, m in enumerate(reversed(hits)):
                text = text[: m.start()] + (f"[{mark}]" if i == 0 else f"[{mark}_{i}]") + text[m.end() :]
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def pii_positions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, start, end) of every match, in code points."""
    import re

    compiled = [(name, re.compile(p[2], re.ASCII)) for name, p in PATTERNS.items()]

    def run(frames):
        for f in frames:
            rows = [(i, name, m.start(), m.end()) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1]) if t for name, p in compiled for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=["id", "kind", "start", "end"])

    return texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col)).mapInPandas(run, "id string, kind string, start int, end int")


def pseudonym(text: Column) -> Column:
    """Eight hex digits of the text's 31-hash."""
    return F.lpad(F.lower(F.hex(F.abs(hash31(text)))), 8, "0")


# fixed values: what written output never shows, in order
OUTPUT_PATTERNS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b[a-zA-Z0-9]{15}([a-zA-Z0-9]{3})?\b",
    r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    r"""(?i)\bsessionId[=:]\s*['"]?[\w-]+['"]?""",
    r"""(?i)\b(access_?token|bearer|api_?key)[=:]\s*['"]?[\w-]+['"]?""",
)

OUTPUT_PATTERNS = tuple(map(ascii_words, OUTPUT_PATTERNS))


def deep(value: Column, kind: T.DataType, clean: Callable[[Column], Column]) -> Column:
    """value with every string in it cleaned, at any depth of structs, arrays and maps; keys of maps, other types and nulls stay."""
    if isinstance(kind, T.StringType):
        return clean(value)
    if isinstance(kind, T.ArrayType) and holds_text(kind):
        return F.transform(value, lambda x: deep(x, kind.elementType, clean))
    if isinstance(kind, T.MapType) and holds_text(kind):
        return F.transform_values(value, lambda k, v: deep(v, kind.valueType, clean))
    if isinstance(kind, T.StructType) and holds_text(kind):
        return F.when(value.isNotNull(), F.struct(*[deep(value.getField(f.name), f.dataType, clean).alias(f.name) for f in kind.fields]))
    return value


def holds_text(kind: T.DataType) -> bool:
    """Whether a type has strings that `deep` would clean."""
    if isinstance(kind, T.StructType):
        return any(holds_text(f.dataType) for f in kind.fields)
    return holds_text(kind.elementType) if isinstance(kind, T.ArrayType) else holds_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def redact_deep(df: DataFrame, columns: list[str] | None = None, policy: Policy = MODERATE) -> DataFrame:
    """df with every match of the policy replaced by its placeholder, in strings at any depth."""
    chosen = [f for f in df.schema.fields if (columns is None or f.name in columns) and holds_text(f.dataType)]
    return df.withColumns({f.name: deep(F.col(f.name), f.dataType, lambda c: redact(c, policy)) for f in chosen})


def redact_output(df: DataFrame, columns: list[str] | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """df with every match in its strings, at any depth, replaced by [REDACTED]; the schema stays."""

    def clean(c: Column) -> Column:
        for pattern in (*OUTPUT_PATTERNS, *own):
            c = F.regexp_replace(c, pattern, "[REDACTED]")
        return c

    chosen = [f for f in df.schema.fields if (columns is None or f.name in columns) and holds_text(f.dataType)]
    return df.withColumns({f.name: deep(F.col(f.name), f.dataType, clean) for f in chosen})
