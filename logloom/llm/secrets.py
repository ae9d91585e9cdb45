"""Secret scans: three base rules, and a likelihood ratio of two character Markov models.

One model is of random strings (hex, base 64 and alphanumeric forms of digests, labelled 1), the other of
ordinary identifiers (names made of code words, and tokens of a bounded sample of documents outside base matches, labelled 0). Both
are first-order chains over ASCII; a token of 16 characters or more whose log-likelihood ratio passes the
threshold, in total and per character, is a span of the kind `random`. Base spans stay as they are; a random span that
would overlap a base span is not added.

All of it is DataFrame expressions: a match is marked on both sides with a character that is not in the text, the text is
split there, and positions (code points, end exclusive) are the running lengths of the pieces. Running sums go by runs of elements and
overlaps are counted in sorted arrays, so the work on a text grows with its length and (but for sorting) with its matches.

Defined cases: null text counts as empty; whole texts of any length are scanned; repeated rows are scanned as
often as they come; an empty table gives no rows; extra columns are ignored; without documents
to learn identifiers from, their model is uniform.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

_MARK, _STAND_IN = "\ue000", "\ue001"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Nats in total and per transition over which a token counts as random.
TOTAL, PER_CHARACTER = 12.0, 0.8
SAMPLE_DOCUMENTS = 4000
RANDOM_STRINGS = 6000
_SPAN = "array<struct<s:int,k:int,e:int>>"
#: Elements of a run in running sums.
_RUN = 64


def _ends(lengths: Column) -> Column:
    """Running sums of an array of lengths, in about _RUN times as many steps as it has elements: sums of runs of _RUN elements are
    added up one after the other, and an element adds what its run holds up to it."""
    n_runs = F.ceil(F.size(lengths) / _RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n_runs - 1), lambda i: F.aggregate(F.slice(lengths, i * _RUN + 1, F.lit(_RUN)), F.lit(0), lambda x, y: x + y))
    before = lambda r: F.aggregate(r, F.array(F.lit(0)), lambda x, y: F.concat(x, F.array(F.element_at(x, -1) + y)))

    def ends(b: Column) -> Column:
        place = lambda i: (i / _RUN).cast("int")
        return F.transform(lengths, lambda x, i: F.get(b, place(i)) + F.aggregate(F.slice(lengths, place(i) * _RUN + 1, i - place(i) * _RUN + 1), F.lit(0), lambda x, y: x + y))

    return let(runs, lambda r: let(before(r), ends))


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches that are ok."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast(_SPAN)

    def placed(p: Column) -> Column:
        # every second piece is a match
        hit = lambda x, i: i % 2 == 1 if ok is None else F.when(i % 2 == 1, ok(x)).otherwise(False)

        def spans(e: Column) -> Column:
            span = lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), F.lit(kind).alias("k"), F.get(e, i).alias("e"), hit(x, i).alias("ok"))
            return F.transform(F.filter(F.transform(p, span), lambda x: x["ok"]), lambda x: F.struct(x["s"], x["k"], x["e"]))

        return F.when(F.size(p) == 1, none).otherwise(let(F.transform(p, lambda x: F.length(x)), lambda n: let(_ends(n), spans)))

    return let(pieces, placed)


def _below(values: Column, bounds: Column, strictly: bool) -> Column:
    """For each bound, in order, how many values are below it (or at it, unless strictly): places in one sorted array of both."""
    first, then = (bounds, values) if strictly else (values, bounds)
    both = F.sort_array(F.concat(F.transform(first, lambda x: F.struct(x.alias("at"), F.lit(0).alias("then"))), F.transform(then, lambda x: F.struct(x.alias("at"), F.lit(1).alias("then")))))
    asked = 0 if strictly else 1
    places = F.transform(F.filter(F.transform(both, lambda x, i: F.struct(x["then"].alias("then"), i.alias("i"))), lambda x: x["then"] == asked), lambda x: x["i"])
    return F.transform(places, lambda x, i: x - i)


def _free(more: Column, base: Column) -> Column:
    """The spans of `more` (in order, none over another) that overlap no span of base: as many base spans start before one's end as end by its start."""
    field = lambda spans, name: F.transform(spans, lambda x: x[name])
    started, ended = _below(field(base, "s"), field(more, "e"), True), _below(field(base, "e"), field(more, "s"), False)
    return let(started, lambda a: let(ended, lambda b: F.filter(more, lambda m, i: F.get(a, i) == F.get(b, i))))


def base_spans(text: Column) -> Column:
    """Array of three arrays of spans: assign, access, hex."""
    long_value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 8
    return F.array(_spans(text, ASSIGN, 0, long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_MARK), F.lit(_STAND_IN))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(token, label 1): digests written in the alphabets that keys are written in, the same every time."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    forms = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, base64).when(F.col("id") % 4 == 2, F.regexp_replace(base64, "[+/=]", "")).otherwise(F.upper(F.regexp_replace(base64, "[+/=]", "")))
    return spark.range(n).select(forms.alias("token"), F.lit(1).alias("label"))


#: Words that identifiers in code and paths are made of.
_CODE_WORDS = (
    "get set add remove update create delete find list map user account name id key value index count total size order item "
    "customer product price amount date time start end first last next file path config data model view service client server "
    "request response error message status type state event handler manager factory builder table column query result page"
).split()


def code_identifiers(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(token, label 0): names of two to four code words in camel, snake, kebab, constant and path style, the same every time."""
    words = F.array(*map(F.lit, _CODE_WORDS))
    word = lambda i: F.get(words, F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(_CODE_WORDS))).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), 2 + (F.col("id") % 3).cast("int")), word)
    camel = F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    style = F.pmod(F.xxhash64(F.col("id")), F.lit(5))
    joined = lambda sep: F.array_join(parts, sep)
    token = F.when(style == 0, camel).when(style == 1, joined("_")).when(style == 2, joined("-")).when(style == 3, F.upper(joined("_"))).otherwise(joined("/"))
    return spark.range(n).select(token.alias("token"), F.lit(0).alias("label"))


def identifier_samples(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(token, label 0): tokens of at most `most` documents, the same for the same documents, outside base matches."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    bare = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for p in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, p, " ")
    return some.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("token"), F.lit(0).alias("label"))


def _transition(token: Column, i: Column) -> Column:
    return F.ascii(F.substring(token, i, F.lit(1))) * 128 + F.ascii(F.substring(token, i + 1, F.lit(1))) + 1


def markov_ratios(samples: DataFrame) -> list[float]:
    """log(p random / p ordinary) of each of the 128 * 128 transitions, from labelled tokens."""
    moves = samples.where(F.length("token") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: _transition(F.col("token"), i))).alias("move"))
    rows = moves.groupBy("label", "move").count().collect()  # at most two rows for each transition
    alphabet = 67  # characters that a token may hold; each gets half a count
    logs = []
    for label in (1, 0):
        n = {r.move - 1: r["count"] for r in rows if r.label == label}
        total = [0] * 128
        for m, c in n.items():
            total[m // 128] += c
        logs.append([math.log((n.get(m, 0) + 0.5) / (total[m // 128] + 0.5 * alphabet)) for m in range(128 * 128)])
    return [a - b for a, b in zip(*logs)]


def _ratio(token: Column, table: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.element_at(table, _transition(token, i)))


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, total: float = TOTAL, per_character: float = PER_CHARACTER) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    samples: (token, label), label 1 for random strings; made from docs where not given."""
    if samples is None:
        samples = random_strings(docs.sparkSession).unionByName(code_identifiers(docs.sparkSession)).unionByName(identifier_samples(docs))
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in markov_ratios(samples))), ",").cast("array<double>")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _clean(F.col("text")).alias("text"))

    def random(x: Column) -> Column:
        enough = lambda r: (r >= total) & (r >= per_character * (F.length(x) - 1))
        return F.when(x.rlike("[A-Za-z]"), let(_ratio(x, table), enough)).otherwise(F.lit(False))

    found = src.select("doc_id", base_spans(F.col("text")).alias("base"), _spans(F.col("text"), CANDIDATE, 3, random).alias("more"))
    flat = found.select("doc_id", "base", F.flatten("base").alias("all"), "more")
    free = _free(F.col("more"), F.col("all"))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = flat.select("doc_id", "base", "all", free.alias("added"))
    count = lambda i: F.size(F.col("base")[i]).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("added").cast("long").alias("n_random"), F.sha2(joined(F.col("all")), 256).alias("base_sha256"), joined(F.concat("all", "added")).alias("spans"))
