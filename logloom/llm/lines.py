"""Line dedup: repeated runs of lines, from a suffix array over line ids and its longest common prefixes.

The lines of all documents form sequences of ids (128-bit hashes, which also order them). Prefix doubling: round 0 ranks
single lines; each later round ranks runs of twice the length by the pair (rank of the first half, rank of the
second half), sorted by range partitioning. A suffix's path is the list of its ranks, so paths sort like the suffixes and two paths that
share c ranks share 2 ** (c - 1) lines at least. A suffix whose class has no second member is placed for good and leaves the rounds, which end
when all are placed; lines without a copy, like a document's end, differ from everything. Sorted paths are the suffix array (of the suffixes
that start with a repeated line; no other has a common prefix). Prefix lengths of neighbours follow from their paths: the highest
power of two is in the shared ranks, the rest from the paths of the two places behind it, at most one look a binary digit
(deleting needs no more than `min_lines`). An interval of
the array whose neighbours share `min_lines` lines holds all copies of a run; `repeated_runs` gives the maximal ones. Every line
of a run that also starts earlier (smaller id; in one document, earlier line) is deleted, so first copies stay
whole. With `single_words`, later copies of single lines of more words are deleted too, whatever their neighbours are.

Classes are counted with partial aggregation and joined back with skew handling; a line in a third of
all documents is one row of the class table. Texts are shuffled only if the answers are too many to broadcast.

Defined cases: null, empty and blank texts have no lines; lines without a word are in no sequence and are never
deleted; rows with the same id and text are one document, neither is a copy of the other; a null
id sorts after all others; texts of any length are processed whole; an empty table gives no rows;
extra columns are kept by `dedup_lines` and ignored by `line_runs`. Lines are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, give_back, materialize, scratch, words

MIN_LINES = 2
BROADCAST_BYTES = 48 << 20
_ROW = ["rk", "rk2"]


def _key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"rk": F.xxhash64("doc_id", text), "rk2": F.xxhash64(F.lit("row"), "doc_id", text)})


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("rk").alias("a"), F.col("rk2").alias("b"), F.col("pos").alias("p"))


def _element(rank: Column) -> Column:
    """A rank as eight bytes that sort like it, above all elements without a rank."""
    return F.unhex(F.hex(rank + F.lit(-(1 << 63))))


def _ranked(classes: DataFrame, by: list[str], name: str) -> DataFrame:
    """Ranks in the order of `by`: range partitions are in order, and so are ids in and across them."""
    return materialize(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")


def _line_classes(docs: DataFrame, single_words: int | None) -> DataFrame:
    """Round 0: doc_id, rk, rk2, pos, rank, path, later, long of every line that stands twice or more."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # a line of so many words has twice as many characters, less one
    long = lambda x: F.lit(False) if single_words is None else F.when(F.length(x) > 2 * single_words, F.size(words(x)) > single_words).otherwise(False)
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), long(x).alias("long")))
    items = _key(docs).select("doc_id", *_ROW, F.posexplode(hashes)).select("doc_id", *_ROW, "pos", "col.h1", "col.h2", "col.long")
    classes = items.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).where("n > 1").drop("n")
    ranked = _ranked(classes, ["h1", "h2"], "lines-0")
    found = items.join(ranked, ["h1", "h2"]).dropDuplicates([*_ROW, "pos"])
    return materialize(found.select("doc_id", *_ROW, "pos", "rank", _element(F.col("rank")).alias("path"), (F.col("first") != _order()).alias("later"), "long"), "lines-0")


def _suffix_paths(lines: DataFrame) -> DataFrame:
    """doc_id, rk, rk2, pos, path of every suffix in `lines`; paths are unique and sort like the suffixes.
    A round reads documents that have an unplaced suffix, no others."""
    columns = ["doc_id", *_ROW, "pos", "path"]
    known, length = lines.select(*columns, "rank", F.lit(2).cast("long").alias("n")), 1
    placed, scratch = [], []
    while True:
        active = known.where("n > 1")
        if active.isEmpty():
            break
        behind = known.select(*_ROW, (F.col("pos") - length).alias("pos"), F.col("path").alias("half"))
        pairs = materialize(active.drop("n").withColumnRenamed("rank", "r1").join(behind, [*_ROW, "pos"], "left"), "lines-pairs")
        ranked = _ranked(pairs.where("half is not null").groupBy("r1", "half").agg(F.count("*").alias("n")), ["r1", "half"], "lines")
        # without a second half a suffix is like no other; it sorts before those that go on
        own = F.unhex(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64("doc_id", *_ROW, "pos"), 1)), 16, "0"))
        path = F.concat("path", F.coalesce(_element(F.col("rank")), own))
        judged = materialize(pairs.join(ranked, ["r1", "half"], "left").withColumns({"path": path, "n": F.coalesce("n", F.lit(1))}).select(*columns, "rank", "n"), "lines-judged")
        open_docs = judged.where("n > 1").select(*_ROW).distinct()
        before, known = known, materialize(known.where("n = 1").unionByName(judged).join(open_docs, _ROW, "left_semi"), "lines-known")
        placed.append(judged.where("n = 1").select(*columns))
        scratch.append(judged)
        for used in (pairs, ranked, before):
            discard(used)
        length *= 2
    out = lines.limit(0).select(*columns)
    for part in placed:
        out = out.unionByName(part)
    out = materialize(out, "lines-paths")
    for used in (known, *scratch):
        discard(used)
    return out


def _shared(a: str, b: str, most: int) -> Column:
    """Ranks that two paths share from their start, of `most` at most."""
    out = F.lit(0)
    for n in range(most, 0, -1):
        both = (F.length(a) >= 8 * n) & (F.length(b) >= 8 * n) & (F.substring(a, 1, 8 * n) == F.substring(b, 1, 8 * n))
        out = out + F.when(both, 1).otherwise(0)
    return out


def suffix_array(lines: DataFrame, enough: int | None = None) -> DataFrame:
    """sa (order), part, doc_id, rk, rk2, pos, lcp: lines that a suffix has in common with the one before it in the array.
    From `enough` lines on, lcp may stay at the power of two below: no further places are looked up."""
    paths = _suffix_paths(lines)
    most = (paths.agg(F.max(F.length("path"))).first()[0] or 0) // 8
    order = paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("sa", F.monotonically_increasing_id())
    order = materialize(order.withColumn("part", F.shiftright("sa", 33)), "lines-order")
    # the last suffix of each part, one row a part, stands before the first of the next part that has one
    lasts = order.groupBy("part").agg(F.max_by(F.struct(*_ROW, "pos", "path"), "sa").alias("before"))
    carried = lasts.select(F.lead("part").over(Window.orderBy("part")).alias("part"), F.col("before").alias("carried"))
    before = F.coalesce(F.lag(F.struct(*_ROW, "pos", "path")).over(Window.partitionBy("part").orderBy("sa")), "carried")
    pairs = order.join(F.broadcast(carried), "part", "left").withColumn("before", before)
    pairs = pairs.withColumn("shared", F.coalesce(_shared("path", "before.path", most), F.lit(0)))
    lcp = F.when(F.col("shared") > 0, F.expr("shiftleft(1L, shared - 1)")).otherwise(F.lit(0).cast("long"))
    pairs = materialize(pairs.select("sa", "part", "doc_id", *_ROW, "pos", *[F.col(f"before.{c}").alias(f"b_{c}") for c in [*_ROW, "pos"]], "shared", lcp.alias("lcp")), "lines-pairs")
    # two ranks or more: the lines behind the shared power of two may agree as well
    more = F.col("shared") >= 2 if enough is None else (F.col("shared") >= 2) & (F.col("lcp") < enough)
    done, open_ = [pairs.where(~more)], pairs.where(more)
    while most > 1 and not open_.isEmpty():
        here = paths.select(*_ROW, F.col("pos").alias("at"), F.col("path").alias("pa"))
        there = paths.select(*[F.col(c).alias(f"b_{c}") for c in _ROW], F.col("pos").alias("b_at"), F.col("path").alias("pb"))
        looked = open_.withColumns({"at": (F.col("pos") + F.col("lcp")).cast("int"), "b_at": (F.col("b_pos") + F.col("lcp")).cast("int")})
        looked = looked.join(here, [*_ROW, "at"], "left").join(there, ["b_rk", "b_rk2", "b_at"], "left")
        looked = looked.withColumn("shared", F.coalesce(_shared("pa", "pb", most), F.lit(0)))
        looked = materialize(looked.withColumn("lcp", F.col("lcp") + F.when(F.col("shared") > 0, F.expr("shiftleft(1L, shared - 1)")).otherwise(0)).select(*pairs.columns), "lines-lcp")
        done.append(looked.where(~more))
        open_, most = looked.where(more), most - 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("sa", "part", "doc_id", *_ROW, "pos", "lcp")


def _intervals(array: DataFrame, least: int) -> DataFrame:
    """array with interval: the sa at which the stretch of neighbours with lcp >= least starts."""
    starts = F.when(F.col("lcp") < least, F.col("sa"))
    by_part = array.groupBy("part").agg(F.max(starts).alias("last"))
    carried = by_part.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.max(starts).over(Window.partitionBy("part").orderBy("sa").rowsBetween(Window.unboundedPreceding, 0))
    return array.join(F.broadcast(carried), "part", "left").withColumn("interval", F.coalesce(inside, "carried"))


def _later(array: DataFrame, least: int) -> DataFrame:
    """Suffixes whose first `least` lines also start earlier."""
    marked = materialize(_intervals(array, least), "lines-intervals")
    first = marked.groupBy("interval").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marked.join(first, "interval").where(F.col("first") != _order())


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, start (lines with a word before it), n_lines of every maximal repeated run: some other place has the same lines, and no longer
    repeated run of the document holds it. Rows with the same id and text give their runs once."""
    array = materialize(suffix_array(_line_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None)), "lines-array")
    # the longest run that starts at a suffix is shared with one of its neighbours in the array
    heads = array.groupBy("part").agg(F.min_by("lcp", "sa").alias("head"))
    carried = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("carried"))
    after = F.coalesce(F.lead("lcp").over(Window.partitionBy("part").orderBy("sa")), "carried", F.lit(0))
    longest = array.join(F.broadcast(carried), "part", "left").withColumn("n_lines", F.greatest("lcp", after))
    reach = F.max(F.col("pos") + F.col("n_lines")).over(Window.partitionBy(*_ROW).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    runs = longest.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("pos") + F.col("n_lines") > F.col("reach")))
    return runs.where(F.col("n_lines") >= min_lines).select("doc_id", F.col("pos").alias("start"), "n_lines")


def repeated_windows(docs: DataFrame, min_lines: int, single_words: int | None = None) -> DataFrame:
    """rk, rk2, pos of every place whose next min_lines lines also start earlier; -1 - pos of every line
    of more than single_words words that also stands earlier."""
    lines = _line_classes(docs, single_words)
    found = _later(materialize(suffix_array(lines, min_lines), "lines-array"), min_lines).select(*_ROW, "pos")
    if single_words is None:
        return found
    return found.unionByName(lines.where("later and long").select(*_ROW, (-1 - F.col("pos")).alias("pos")))


def _kept(text: bytes | None, starts, k: int):
    """(lines with a word, deleted, runs, longest run, kept text)."""
    if not text:
        return 0, 0, 0, 0, text
    lines = text.split(b"\n")
    worded = [i for i, x in enumerate(lines) if x.split()]
    if starts is None or not len(starts):
        return len(worded), 0, 0, 0, text
    gone = sorted({p for s in starts for p in (range(s, s + k) if s >= 0 else (-1 - s,))})
    runs = longest = size = 0
    before = None
    for p in gone:
        size = size + 1 if before == p - 1 else 1
        runs += size == 1
        longest, before = max(longest, size), p
    drop = {worded[p] for p in gone}
    return len(worded), len(gone), runs, longest, b"\n".join(x for i, x in enumerate(lines) if i not in drop)


def _slices(batches, rows: int = 1000):
    """Batches in pieces, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()


def _with_windows(docs: DataFrame, min_lines: int, single_words: int | None = None) -> DataFrame:
    """row (a struct of the columns of docs but text), text, and `starts`: where later copies start in it."""
    rest = [F.col(c) for c in docs.columns if c != "text"]
    src = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch() as keep:
        found = repeated_windows(src.select("doc_id", "text"), min_lines, single_words)
        per_row = keep(materialize(found.groupBy(*_ROW).agg(F.collect_list("pos").alias("starts")), "lines-starts"))
    size = per_row.agg(F.sum(F.size("starts") * 4 + 48)).first()[0] or 0
    out = _key(src).join(F.broadcast(per_row) if size <= BROADCAST_BYTES else per_row, _ROW, "left")
    return out.select("row", "text", "starts")


def line_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per row of docs: doc_id, n_lines (with a word), n_removed, n_runs, longest_run, kept_sha256."""

    def run(batches):
        for b in _slices(batches):
            rows = []
            for t, s in zip(b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                *counts, kept = _kept(t.as_py(), s, min_lines)
                rows.append((*counts, hashlib.sha256(kept or b"").hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=["doc_id", "n_lines", "n_removed", "n_runs", "longest_run", "kept_sha256"])

    src = _with_windows(docs.select("doc_id", "text"), min_lines).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "starts")
    return src.mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, single_words: int | None = None) -> DataFrame:
    """docs with later copies of line runs deleted from text; n_chars, if there, follows."""
    src = _with_windows(docs, min_lines, single_words)
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType())])

    def run(batches):
        for b in _slices(batches):
            texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
            kept = [_kept(t, s, min_lines)[4] if s else t for t, s in zip(texts, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if k is None else k.decode() for k in kept], pa.string())], names=["row", "text"])

    out = src.mapInArrow(run, schema)
    columns = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])
