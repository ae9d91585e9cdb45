"""SimHash near-duplicates, candidates verified through pivot distance tables.

`fingerprints` hashes word shingles (Arrow batches, whole texts). `link_components` finds
all pairs of fingerprints that differ in at most four bits: a fingerprint is filed under every
choice of blocks that four differing bits can leave intact, so each such pair shares a file. Within a
file each member's Hamming distances to the reference fingerprints are computed once (the
pivot table); a pair whose distances to any reference differ by more than the threshold cannot
link (triangle inequality) and is discarded, survivors are verified bit by bit. Members of a file
that is too large for one pivot table are filed again by further intact blocks of the bits
that its key leaves open, until every file fits; files are counted before they are dealt.

Defined cases: null or blank text has fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle; exact copies share a fingerprint and are compared
once; repeated rows are returned as often as they came; a null id gets its class's
component (null if the class has no other id); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, scratch, tasks_for
from .components import connected_components

SEED = 42
PIVOTS = 24
#: Members of a file with more members than this are dealt to files of longer keys: the bound of a pivot table's size.
MAX_FILE = 2048
#: Keys of overfull files up to this number are broadcast; more are joined by shuffle.
HOT_KEYS = 1_000_000
_SHIFT_RUN = 12


def _doc_hashes(text: bytes | None, k: int, lower: bool) -> np.ndarray:
    ws = (text.lower() if lower else text).split() if text else []
    n = len(ws)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lens = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    h = xxhash.xxh64_intdigest
    got = [h(joined[a:b], SEED) for a, b in zip((ends - lens)[: n - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.array(got, np.uint64)


#: Hashes that are unpacked into bits at once.
_AT_ONCE = 1 << 15


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per document: bit i is set where more than half of its hashes set it."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    ends = np.cumsum(sizes[full])
    ones = np.zeros((len(full), 64), np.int64)
    for at in range(0, len(flat), _AT_ONCE):
        part = flat[at : at + _AT_ONCE]
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        starts = np.maximum(ends[first : last + 1] - sizes[full][first : last + 1] - at, 0)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    maj = (2 * ones > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(maj, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_texts(texts, k: int = 4, lower: bool = True) -> np.ndarray:
    """Unsigned fingerprints of byte strings, in pieces of bounded size."""
    out, part, held = [], [], 0
    for t in texts:
        h = _doc_hashes(t, k, lower)
        part.append(h)
        held += len(h)
        if held > 200_000:
            out.append(_majority(part))
            part, held = [], 0
    out.append(_majority(part))
    return np.concatenate(out)


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart; null is like empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 4, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): h is a hash of the text, fp the unsigned fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            step = 512
            fps = [fingerprint_texts(texts.slice(i, step).to_pylist(), shingle, lower) for i in range(0, len(texts), step)]
            fp = np.concatenate(fps).view(np.int64) if fps else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(fp, pa.int64())], names=["doc_id", "h", "fp"])
        give_back()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.select("doc_id", "text", text_hash(F.col("text")).alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def pivot_references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so every task has the same."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)], np.uint64)


def blocks_for(n: int, distance: int) -> tuple[int, int]:
    """(blocks, blocks kept intact): a file's key has about as many bits as n, so files stay small."""
    bits = max(16, int(n).bit_length())
    for m in range(distance + 1, distance + 6):
        if 64 * (m - distance) // m >= bits:
            break
    return m, m - distance


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def file_masks(blocks: int, intact: int, kept: int = 0) -> list[int]:
    """Masks of the bits that a file's members agree in: those of `kept`, and every choice of `intact` among `blocks` blocks of the others."""
    free = [bit for bit in range(64) if not kept >> bit & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [kept | sum(chosen) for chosen in combinations(parts, intact)]


def longer_masks(kept: int, distance: int) -> list[int]:
    """Masks with more bits than `kept`, one of which any two members within `distance` that agree in `kept` agree in."""
    blocks = min(64 - kept.bit_count(), distance + 2)
    return file_masks(blocks, blocks - distance, kept)


def _links_of_run(fp: np.ndarray, table: np.ndarray, limit: int):
    """Spanning links of one file by breadth-first search over what is not yet reached."""
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.flatnonzero(np.abs(table[rest, 0] - table[x, 0]) <= limit)
            for p in range(1, table.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(table[rest[near], p] - table[x, p]) <= limit]
            near = near[np.bitwise_count(fp[rest[near]] ^ fp[x]) <= limit]
            if len(near):
                found = rest[near]
                yield np.full(len(found), x), found
                queue.extend(found.tolist())
                rest = np.delete(rest, near)


def _links_of_sorted(key: np.ndarray, fp: np.ndarray, limit: int):
    """Links inside the files of an array sorted by key: pairs of positions."""
    if len(key) < 2:
        return
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    many = size > 1
    first, size = first[many], size[many]
    if not len(first):
        return
    refs = pivot_references()
    inside = np.repeat(size, size)
    rows = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(inside))
    table = np.zeros((len(key), len(refs)), np.int8)
    table[rows] = np.bitwise_count(fp[rows][:, None] ^ refs[None, :]).astype(np.int8)
    small = rows[inside <= _SHIFT_RUN]
    for k in range(1, _SHIFT_RUN):
        a = small[small + k < len(key)]
        a = a[key[a] == key[a + k]]
        if not len(a):
            break
        for p in range(table.shape[1]):
            a = a[np.abs(table[a, p] - table[a + k, p]) <= limit]
        a = a[np.bitwise_count(fp[a] ^ fp[a + k]) <= limit]
        if len(a):
            yield a, a + k
    for f, s in zip(first[size > _SHIFT_RUN], size[size > _SHIFT_RUN]):
        for a, b in _links_of_run(fp[f : f + s], table[f : f + s], limit):
            yield f + a, f + b


def _verify_files(batches, limit: int):
    """Sorted (key, fp) in, links (a, b) out; a file is held as a whole, its size is bounded by the filing."""

    def out(key, fp):
        for a, b in _links_of_sorted(key, fp.view(np.uint64), limit):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[b], pa.int64())], names=["a", "b"])

    hold_k, hold_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key, fp = np.concatenate((hold_k, batch.column(0).to_numpy())), np.concatenate((hold_f, batch.column(1).to_numpy()))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last file may go on
        yield from out(key[:cut], fp[:cut])
        hold_k, hold_f = key[cut:], fp[cut:]
    yield from out(hold_k, hold_f)


def _filed(members: DataFrame, masks: list[int]) -> DataFrame:
    """(key, mask, fp): every member under each of the masks."""
    each = members.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    return each.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def _filed_again(members: DataFrame, distance: int) -> DataFrame:
    """(key, mask, fp) of members (mask, fp) of overfull files, under every longer mask; files of the same members are one."""

    def run(batches):
        for b in batches:
            mask, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for m in np.unique(mask):
                longer = np.array([_signed(x) for x in longer_masks(int(m) & ((1 << 64) - 1), distance)], np.int64)
                mine = fp[mask == m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(longer, len(mine))), pa.array(np.tile(mine, len(longer)))], names=["mask", "fp"])

    longer = members.select("mask", "fp").distinct().mapInArrow(run, "mask long, fp long").distinct()
    return longer.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def _verified(filed: DataFrame, distance: int, name: str) -> DataFrame:
    # what a file costs is not what it weighs: small tasks aren't joined
    dealt = filed.select("key", "fp").repartition(tasks_for(filed.sparkSession), "key").sortWithinPartitions("key", "fp")
    return materialize(dealt.mapInArrow(lambda it: _verify_files(it, distance), "a long, b long").distinct(), name)


def links(distinct_fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that differ in at most
    `distance` bits; not every linked pair is a row, but every linked pair is connected.

    A file is counted by a pre-aggregated pass before it is dealt, so an overfull one never goes through a task: its members move on under longer
    keys, beyond all bits that they agree in. Bits left open shrink with every level, and a file with r open bits has at most 2^r members, so levels end."""
    most = max(MAX_FILE, 1 << (distance + 1))
    filed = _filed(distinct_fps, file_masks(*blocks_for(distinct_fps.count(), distance)))
    found = None
    while True:
        common = F.bitwise_not(F.bit_and("fp").bitwiseXOR(F.bit_or("fp")))
        overfull = materialize(filed.groupBy("key").agg(F.count("*").alias("n"), common.alias("common")).where(F.col("n") > most).select("key", "common"), "simhash-overfull")
        n_over = overfull.count()
        over = F.broadcast(overfull) if n_over <= HOT_KEYS else overfull
        part = _verified(filed.join(over, "key", "left_anti") if n_over else filed, distance, "simhash-links")
        found = part if found is None else found.unionByName(part)
        if not n_over:
            return found
        again = _filed_again(filed.join(over, "key").select(F.col("common").alias("mask"), "fp"), distance)
        filed = materialize(again, "simhash-filed")


def _placed(docs: DataFrame, distance: int, shingle: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, fp, component, component_id) for every row of docs: component is never null."""
    fps = materialize(fingerprints(docs, shingle, lower, id_col, text_col), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = connected_components(links(classes.select("fp"), distance))
    placed = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps.join(placed.join(smallest, "component").select("fp", "component", "component_id"), "fp")


def simhash_components(docs: DataFrame, distance: int = 4, shingle: int = 4, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; see the module text."""
    placed = _placed(docs, distance, shingle, lower, id_col, text_col)
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Rows to drop up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def keep_firsts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row of docs for each component of placed (doc_id, h, component): that of the smallest id, then the smallest hash of its
    text; a repeat of that row goes too. Rows with a null id stay."""
    named = placed.where("doc_id is not null")
    with scratch() as keep:
        rows = materialize(named.groupBy("component", "doc_id", "h").agg(F.count("*").alias("n")), "kept-rows")
        # a component may hold a third of all rows: its first row is pre-aggregated, and goes to the others without dealing them by component
        first = materialize(rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.sum("n").alias("m")).where("m > 1").drop("m"), "kept-firsts")
        few = first.count() <= BROADCAST_ROWS
        judged = rows.join(F.broadcast(first) if few else first, "component").select("doc_id", "h", "n", (F.struct("doc_id", "h") == F.col("first")).alias("is_first"))
        changed = keep(materialize(judged.where("not is_first or n > 1").select(F.col("doc_id").alias("_k"), F.col("h").alias("_h"), "is_first"), "kept-changed"))
    few = changed.count() <= BROADCAST_ROWS

    def of(is_first: bool | None, how: str) -> DataFrame:
        keys = (changed if is_first is None else changed.where("is_first")).select("_k", "_h")
        return docs.join(F.broadcast(keys) if few else keys, (docs["doc_id"].cast("long") == keys["_k"]) & (text_hash(docs["text"]) == keys["_h"]), how)

    out = of(None, "left_anti")
    if not changed.where("is_first").isEmpty():
        key = _free(docs.columns, "_key")
        again = of(True, "left_semi").withColumn(key, text_hash(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
        out = out.unionByName(again)
    return out


def _free(columns: list[str], name: str) -> str:
    while name in columns:
        name = "_" + name
    return name


def keep_one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each group, see `keep_firsts`; columns stay."""
    placed = materialize(_placed(docs.select("doc_id", "text"), distance, shingle, True, "doc_id", "text").select("doc_id", "h", "component"), "simhash-placed")
    return keep_firsts(docs, placed)
