"""SimHash near copies at a wide radius: word shingles with a Jaccard similarity of at least 0.8, verified exactly.

The operator of `simhash` at a similarity and not at four bits. At 0.8 some 15 % of a fingerprint's bits differ (the angle of two
sets), so a fingerprint has 64 * WORDS bits of one hash a shingle, mixed anew for each word, and a file's key is a block of few of them: some
FILE members share a file, and tables of blocks are laid until a pair at the least similarity agrees in none with a probability of MISSED.
Within a file each member's distances to reference members are computed once (the pivot table); what is further from one than RADIUS more or less
than a run of members can't link (triangle inequality) and is discarded, survivors are compared bit by bit. Files are counted
before they are dealt: members of one over MAX_FILE are first compared with its smallest, and those which that leaves apart go on as tiles, against each
other and against the largest class.

What fingerprints link is a group; near copies lie within one. A group's members are compared by their whole shingle sets, first with its smallest. Groups
that this doesn't connect are dealt out as tiles of about TILE_BYTES of shingles and TILE_ROWS members a side: members outside the group's
largest class against each other and against that class. A tile returns links that span its classes, never pairs, and holds no more than its two
sides, so a group of copies of any size is a row or a few a member. Work in a group or file grows with (members outside the largest class) x (members).

Defined cases: null and blank texts have no shingles and are copies of each other; a text with fewer words than a shingle is
one shingle; rows with a null id stay, but tie others; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, scratch, tasks_for
from .components import connected_components
from .pivots import spanning
from .simhash import HOT_KEYS, _doc_hashes, _majority, keep_firsts, text_hash
from .texthash import mix

WORDS = 3
BITS = 64 * WORDS
FP = [f"f{w}" for w in range(WORDS)]
#: Bits in which the fingerprints of near copies differ at most: more with a probability under 0.00001 at 0.8.
RADIUS = 60
#: Members of a file, about; of a larger one than MAX_FILE the members are dealt as tiles of FILE.
FILE, MAX_FILE = 4096, 8192
#: Probability with which a pair at the least similarity shares no file, at most.
MISSED = 0.0001
#: References of a pivot table, and members compared with a file at once.
PIVOTS, RUN = 8, 64
BROADCAST_BYTES = 48 << 20
#: Shingle hashes (8 bytes each) and members on one side of a tile, about.
TILE_BYTES, TILE_ROWS = 4 << 20, 1024
#: Sets of up to this number of shingles have more bits on the edge and lie in more tables.
SHORT = 5
_SEEDS = np.array([0, *(xxhash.xxh64_intdigest(str(w).encode(), 11) for w in range(1, WORDS))], np.uint64)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(_doc_hashes(text, k, True))


def _node(hashes: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(hashes.tobytes())
    return x - (1 << 64) if x >> 63 else x


def fingerprint_words(sets: list[np.ndarray]) -> list[np.ndarray]:
    """WORDS columns of fingerprints: a bit is set where more than half of a set's hashes set it."""
    return [_majority(sets if not w else [mix(h ^ seed) for h in sets]) for w, seed in enumerate(_SEEDS)]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, node, size, f0, ...) of each row (doc_id, text, h): the number of distinct shingles and their fingerprint."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingles(t.as_py(), k) for t in part.column(1).cast(pa.binary())]
                columns = [part.column(0), part.column(2), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), *(pa.array(f.view(np.int64)) for f in fingerprint_words(sets))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "size", *FP])
        give_back()

    return docs.mapInArrow(run, "doc_id long, h long, node long, size long, " + ", ".join(f"{f} long" for f in FP))


@functools.cache
def tables_for(bits: int, rate: float) -> int:
    """How many tables of keys of `bits` bits leave a pair whose bits differ with probability `rate` apart with one of MISSED at most."""
    chance = [math.comb(BITS, d) * rate**d * (1 - rate) ** (BITS - d) for d in range(BITS + 1)]
    agree = [math.comb(BITS - d, bits) / math.comb(BITS, bits) for d in range(BITS + 1)]
    n = 1
    while sum(c * (1 - p) ** n for c, p in zip(chance, agree)) > MISSED:
        n += 1
    return n


def differing(least: float) -> tuple[float, float]:
    """Share of bits in which sets at the least similarity differ: of SHORT shingles or fewer, and of more. The angle's share, and by
    exact counts over all sizes up to 79 as much as 1.238 times that for 4 and 5 shingles and 1.064 times for more."""
    angle = math.acos(2 * least / (1 + least)) / math.pi
    return 1.238 * angle, 1.064 * angle


def block_masks(bits: int, n: int) -> list[list[int]]:
    """n masks of `bits` bits: blocks of a fingerprint's bits in one random order, then in the next."""
    rng, order, out = np.random.default_rng(9), [], []
    while len(out) < n:
        if len(order) < bits:
            order = rng.permutation(BITS).tolist()
        block, order = order[:bits], order[bits:]
        out.append([_signed(sum(1 << (b % 64) for b in block if b // 64 == w)) for w in range(WORDS)])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(nodes: DataFrame, n: int, least: float) -> DataFrame:
    """(key, node, f0, ...) of nodes (node, size, f0, ...): each under the intact block of every table."""
    bits = max(0, n.bit_length() - FILE.bit_length() + 1)
    short, other = (tables_for(bits, rate) for rate in differing(least))
    masks = nodes.sparkSession.createDataFrame([(t, *m) for t, m in enumerate(block_masks(bits, short))], "t int, " + ", ".join(f"m{w} long" for w in range(WORDS)))
    each = nodes.join(F.broadcast(masks), (F.col("t") < other) | (F.col("size") <= SHORT))
    return each.select(F.xxhash64("t", *[F.col(f).bitwiseAND(F.col(f"m{w}")) for w, f in enumerate(FP)]).alias("key"), "node", *FP)


def _words(t) -> np.ndarray:
    return np.stack([t.column(f).to_numpy() for f in FP]).view(np.uint64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of all fingerprints x with all y (WORDS rows each)."""
    out = np.bitwise_count(x[0][:, None] ^ y[0][None, :])
    for w in range(1, WORDS):
        out += np.bitwise_count(x[w][:, None] ^ y[w][None, :])
    return out


def near_pairs(x: np.ndarray, y: np.ndarray | None = None):
    """Pairs of positions of fingerprints within RADIUS, a run of x at a time; without y those of x, each once."""
    refs = x[:, :: max(1, x.shape[1] // PIVOTS)][:, :PIVOTS]
    table = _distances(x, refs)
    order = np.lexsort((table.min(axis=1), table.argmin(axis=1)))  # members of one reference side by side
    x, table, same = x[:, order], table[order].astype(np.int16), y is None
    y, table2, order2 = (x, table, order) if same else (y, _distances(y, refs).astype(np.int16), np.arange(y.shape[1]))
    for at in range(0, len(order), RUN):
        part, since = table[at : at + RUN], at if same else 0
        rest = table2[since:]
        keep = since + np.flatnonzero(((rest >= part.min(axis=0) - RADIUS) & (rest <= part.max(axis=0) + RADIUS)).all(axis=1))
        i, j = np.nonzero(_distances(x[:, at : at + RUN], y[:, keep]) <= RADIUS)
        i, j = i + at, keep[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield order[i], order2[j]


def _spanned(n: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect n positions as all pairs in runs do, of which only some are held."""
    a = b = np.empty(0, np.int64)
    held, size = [], 0

    def joined():
        label = spanning(n, np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
        moved = np.flatnonzero(label != np.arange(n))
        return moved, label[moved]

    for run in runs:
        held.append(run)
        size += len(run[0])
        if size > 1 << 18:
            (a, b), held, size = joined(), [], 0
    return joined() if held else (a, b)


def _links_of_files(batches):
    """Files of rows sorted by key (key, node, f0, ...) in, links (a, b) out; a file is held as a whole, its size is bounded."""

    def of(t: pa.Table):
        key, node, fp = t.column("key").to_numpy(), t.column("node").to_numpy(), _words(t)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for lo, hi in zip(first, np.append(first[1:], len(key))):
            if hi - lo > 1:
                a, b = _spanned(hi - lo, near_pairs(fp[:, lo:hi]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo + a]), pa.array(node[lo + b])], names=["a", "b"])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))  # the last file may go on
        if held and (cut or key[-1] != last):
            yield from of(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from of(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        last = key[-1]
    if held:
        yield from of(pa.Table.from_batches(held))
    give_back()


def _fp_tile(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
    c, c2 = left.column("c").to_numpy(), right.column("c").to_numpy()
    ids = left.column("node").to_numpy()
    every, off = (ids, 0) if same else (np.concatenate((ids, right.column("node").to_numpy())), len(ids))
    pairs = near_pairs(_words(left), None if same else _words(right))
    a, b = _spanned(len(every), ((i[m], j[m] + off) for i, j in pairs if (m := c[i] != c2[j]).any()))
    return pa.table({"a": pa.array(every[a], pa.int64()), "b": pa.array(every[b], pa.int64())})


def links(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (a, b) of nodes (node, size, f0, ...) that connect all whose fingerprints share a file and differ in at most RADIUS bits."""
    filed = _filed(nodes, nodes.count(), least)
    overfull = materialize(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_FILE).select("key"), "near-overfull")
    n_over = overfull.count()
    over = F.broadcast(overfull) if n_over <= HOT_KEYS else overfull
    dealt = filed.join(over, "key", "left_anti") if n_over else filed
    # what a file costs is not what it weighs: small tasks aren't joined
    dealt = dealt.repartition(tasks_for(filed.sparkSession), "key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_links_of_files, "a long, b long").distinct(), "near-found")
    if not n_over:
        return found
    hot = materialize(filed.join(over, "key").withColumnRenamed("key", "band"), "near-hot")
    heads = hot.groupBy("band").agg(F.min(F.struct("node", *FP)).alias("head"))
    stars = hot.join(heads, "band").where((F.col("node") != F.col("head.node")) & ~_apart("head.")).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    found = materialize(found.unionByName(stars).distinct(), "near-found")
    first = materialize(connected_components(found), "near-first")
    split = _open(hot, first)
    more = _tiled(split.withColumn("bytes", F.lit(1)), FILE, ["node", "c", *FP], _fp_tile)
    for t in (hot, first, split):
        discard(t)
    return found.unionByName(more)


def _sets(docs: DataFrame, roles: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """(node, band, parts, near, hashes) of the nodes asked for (node, band, parts, near), made again from their texts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [shingles(t.as_py(), k) for t in b.column(1).slice(at, 500).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])
        give_back()

    held = sketches.join(roles.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = materialize(held.select("doc_id").distinct(), "near-ids")
    named = ids.where("doc_id is not null")
    texts = docs.join(_small(named), "doc_id", "left_semi")
    if not ids.where("doc_id is null").isEmpty():
        texts = texts.unionByName(docs.where("doc_id is null"))
    found = texts.mapInArrow(run, "node long, hashes binary").join(roles, "node").groupBy("node", "band", "parts", "near").agg(F.min("hashes").alias("hashes"))
    out = materialize(found, "near-sets")
    discard(ids)
    return out


def _small(ids: DataFrame) -> DataFrame:
    """A table of one or two longs a row, marked for broadcast when that is under the bound."""
    return F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids


def _apart(other: str) -> Column:
    """Whether the fingerprint of a row and the one whose columns begin with `other` are further apart than RADIUS."""
    return sum((F.bit_count(F.col(f).bitwiseXOR(F.col(other + f))) for f in FP[1:]), F.bit_count(F.col(FP[0]).bitwiseXOR(F.col(other + FP[0])))) > RADIUS


def _verified(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of groups' smallest members with what is near them, verified. A set is shuffled once: a group's members are dealt to its
    parts of about TILE_ROWS, and its smallest goes to each of them, in front."""

    def run(batches):
        head = x = None
        for b in batches:
            a, c, ok = b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, bool)
            for i, y in enumerate(b.column(2)):
                y = np.frombuffer(y.as_py(), np.uint64)
                if a[i] == c[i]:
                    head, x = a[i], y
                elif a[i] == head and min(len(x), len(y)) >= least * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = both >= least * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))
        give_back()

    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    part = F.when(F.col("node") == F.col("band"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    dealt = sets.where("near").select(F.col("band").alias("a"), F.col("node").alias("b"), "hashes", F.explode(part).alias("part"))
    dealt = dealt.repartition(tasks_for(sets.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    return materialize(dealt.select("a", "b", "hashes").mapInArrow(run, "a long, b long"), "near-links")


def _common(x: list[np.ndarray], y: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Shared shingles of the pairs marked in near (other entries are of no use)."""
    out = np.zeros(near.shape, np.float32)
    a, b = np.nonzero(near)
    if len(a) <= 4 * (len(x) + len(y)):
        for i, j in zip(a, b):
            out[i, j] = len(np.intersect1d(x[i], y[j], assume_unique=True))
        return out
    left, right = np.concatenate(x), np.concatenate(y)
    known = np.intersect1d(left, right)
    row = [np.repeat(np.arange(len(s)), [len(h) for h in s]) for s in (x, y)]
    found = [np.isin(h, known) for h in (left, right)]
    place = [np.searchsorted(known, h[f]) for h, f in zip((left, right), found)]
    row = [r[f] for r, f in zip(row, found)]
    for at in range(0, len(known), 4096):
        part = []
        for r, p, n in zip(row, place, near.shape):
            m = (p >= at) & (p < at + 4096)
            dense = np.zeros((n, 4096), np.float32)
            dense[r[m], p[m] - at] = 1
            part.append(dense)
        out += part[0] @ part[1].T
    return out


def _tile(left: pa.Table, right: pa.Table, same: bool, least: float) -> pa.Table:
    def load(t: pa.Table):
        return t.column("node").to_numpy(), t.column("c").to_numpy(), _words(t), [np.frombuffer(h.as_py(), np.uint64) for h in t.column("hashes")]

    ids, c, fp, sets = load(left)
    ids2, c2, fp2, sets2 = (ids, c, fp, sets) if same else load(right)
    near = np.zeros((len(ids), len(ids2)), bool)
    for i, j in near_pairs(fp, None if same else fp2):
        near[i, j] = True
    near &= c[:, None] != c2[None, :]
    n, n2 = np.array([len(s) for s in sets], np.float64)[:, None], np.array([len(s) for s in sets2], np.float64)[None, :]
    near &= np.minimum(n, n2) >= least * np.maximum(n, n2)
    both = _common(sets, sets2, near)
    a, b = np.nonzero(near & (both >= least * (n + n2 - both)))
    every = ids if same else np.concatenate((ids, ids2))
    label = spanning(len(every), a, b if same else b + len(ids))
    moved = np.flatnonzero(label != np.arange(len(every)))
    return pa.table({"a": pa.array(every[moved], pa.int64()), "b": pa.array(every[label[moved]], pa.int64())})


def _open(filed: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of filed (band, node, ...) with their class c, of bands that hold more than one; bands with the same members are looked at once."""
    classed = filed.join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    members = classed.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64(F.lit("file"), F.col("node"))).alias("x"))
    open_ = members.where("c1 <> c2").groupBy("n", "s", "x").agg(F.min("band").alias("band")).select("band")
    return materialize(classed.join(open_, "band", "left_semi"), "near-split")


def _tiled(sized: DataFrame, side: int, columns: list[str], tile) -> DataFrame:
    """Links of rows (band, c, bytes, ...) between classes c of a band, found tile by tile of about `side` bytes a side."""
    by_class = sized.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of_band = by_class.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.max_by("bytes", F.struct("n", "c")).alias("large"), F.sum("bytes").alias("all"))
    parts = lambda x: F.ceil(x / side).cast("int")
    plan = materialize(of_band.select("band", "major", parts(F.col("all") - F.col("large")).alias("few"), parts(F.col("large")).alias("many")), "near-plan")
    dealt = sized.join(plan, "band").withColumn("of_major", F.col("c") == F.col("major"))
    own = F.when(F.col("of_major"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    last = F.when(F.col("of_major"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    tiles = dealt.select("band", *columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(key, group):
        _, i, j = (k.as_py() for k in key)
        own = group.column("own").to_numpy()
        if i == j:
            return tile(group, group, True)
        return tile(group.filter(pa.array(own == i)), group.filter(pa.array(own == j)), False)

    found = materialize(tiles.groupBy("band", "i", "j").applyInArrow(run, "a long, b long"), "near-more")
    discard(plan)
    return found


def _placed(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    """(doc_id, h, component, component_id) of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(_sketches(src.withColumn("h", text_hash(F.col("text"))), shingle), "near-sketches")
    # with fewer shingles than that only equal sets are near
    nodes = sketches.where(F.col("size") + 1e-9 >= least * (F.col("size") + 1)).groupBy("node").agg(*[F.min(c).alias(c) for c in ("size", *FP)])
    nodes = materialize(nodes, "near-nodes")
    groups = materialize(connected_components(links(nodes, least)).withColumnRenamed("component", "band"), "near-groups")
    heads = nodes.select(F.col("node").alias("band"), *[F.col(f).alias(f"a_{f}") for f in FP])
    shared = materialize(nodes.select("node", *FP).join(groups, "node").join(heads, "band"), "near-shared")
    parts = groups.groupBy("band").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts"))
    roles = materialize(shared.withColumn("near", ~_apart("a_")).join(parts, "band").select("node", "band", "parts", "near"), "near-roles")
    sets = _sets(src, roles, sketches.select("doc_id", "node"), shingle)
    found = _verified(sets, least)
    first = materialize(connected_components(found), "near-first")
    split = _open(shared.select("band", "node", *FP), first)
    weight = F.greatest(F.length("hashes") + 64, F.lit(TILE_BYTES // TILE_ROWS))
    more = _tiled(split.join(sets.select("node", "hashes"), "node").withColumn("bytes", weight), TILE_BYTES, ["node", "c", *FP, "hashes"], lambda left, right, same: _tile(left, right, same, least))
    labels = connected_components(found.unionByName(more)).withColumnRenamed("node", "n")
    classes = sketches.groupBy("node").agg(F.min("doc_id").alias("rep"))
    placed = materialize(classes.join(labels, F.col("node") == F.col("n"), "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "near-placed")
    for t in (nodes, groups, shared, roles, sets, found, first, split, more):
        discard(t)
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return sketches.select("doc_id", "h", "node").join(placed.join(smallest, "component").select("node", "component", "component_id"), "node").drop("node")


def near_components(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest id among all texts that near copies lead to."""
    return _placed(docs, least, shingle).select("doc_id", "component_id")


def keep_one_near_copy(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near copies: that of the smallest id; rows with a null id stay, columns too."""
    with scratch() as keep:
        rows = keep(materialize(_placed(docs, least, shingle).select("doc_id", "h", "component"), "near-rows"))
    out = keep_firsts(docs, rows)
    discard(rows)
    return out
