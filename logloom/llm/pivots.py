"""Embedding near-duplicates through a pivot-permutation index.

Pivots are reference vectors from a bounded sample, thinned so that no two are close (else a
dense cluster would split its members among its own pivots). Every vector is described by its `depth`
nearest pivots in order. A pair is retrieved when it shares at least `min_shared` of them, by inverted lists: a vector is filed under every two of
its pivots (under each, where `min_shared` is one), so only vectors that share two meet in a list, shared pivots are counted first, and cosines are
taken, in double precision, of the pairs with enough of them. A pair counts only in the list of its two smallest shared pivots. Lists
of two pivots are about as many as neighbouring pivots, so they stay short when the table outgrows the number of pivots.

Equal vectors are one node with a count, so copies are never compared. Short lists share tasks; a list longer than `chunk` is dealt out as tiles of chunk against
chunk, so no task ever holds more than two chunks; a tile returns link counts and links that span its components, never all pairs.
Each length of vectors has pivots of its own; vectors of a length that the sample lacks are all in one list, compared exactly.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing; vectors of different lengths
don't link; a vector is an id with an array: equal rows are one, one id with several arrays is returned once for each; rows with a null id are
returned with no links, a null component and kept false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

VECTORS_PER_PIVOT = 40
MAX_PIVOTS = 1 << 13
APART = 0.5
CHUNK = 512
#: Lists of at most so many vectors are taken together, about FILE_ROWS entries a group.
SHORT, FILE_ROWS = 32, 8192
#: Rows of a table of lists or components that are broadcast.
BROADCAST_ROWS = 200_000


def _choose(sample: list, most: int) -> dict[int, np.ndarray]:
    """Unit pivots of each length, none closer than APART to one before it; `most` over all lengths, shared by their numbers."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        kept, n = np.empty((max(1, min(most * len(x) // len(sample), len(x))), dim)), 0
        for v in x:
            if n < len(kept) and (n == 0 or (kept[:n] @ v).max() < APART):
                kept[n] = v
                n += 1
        out[dim] = kept[:n]
    return out


def _stored(v: np.ndarray) -> bytes:
    """Floats where they hold the components exactly, else doubles."""
    short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in raw):
        x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    else:
        x = np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raw], np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    depth, near = min(depth, len(pivots)), []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ pivots.T
        top = np.argpartition(-s, depth - 1, axis=1)[:, :depth]
        near.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(near).astype(np.int32)


def _describe(batches, pivots: dict[int, np.ndarray], depth: int, min_shared: int):
    """(node, m, dim, v, pivots, lists) of batches (node, m, embedding)."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            vectors = [np.array(v, np.float64) for v in part.column(2).to_pylist()]
            raw = [_stored(v) for v in vectors]
            near, lists = [None] * len(vectors), [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in pivots:
                    for i in rows:
                        near[i], lists[i] = [], [-1]
                    continue
                found = _nearest(_units([raw[i] for i in rows], dim), pivots[dim], depth)
                up = np.sort(found, axis=1).astype(np.int64)
                one = min(min_shared, up.shape[1]) < 2
                keys = up if one else np.stack([up[:, i] << 32 | up[:, j] for i, j in combinations(range(up.shape[1]), 2)], axis=1)
                for i, n, k in zip(rows, found.tolist(), keys.tolist()):
                    near[i], lists[i] = n, k
            columns = [part.column(0), part.column(1), pa.array(map(len, vectors), pa.int32()), pa.array(raw, pa.binary()), pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "m", "dim", "v", "pivots", "lists"])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position each of n positions reaches through links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_TILE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_NONE = np.iinfo(np.int64).max


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Numbers of shared pivots of all rows of p with all of q."""
    known, place = np.unique(np.concatenate((p.ravel(), q.ravel())), return_inverse=True)
    rows = np.zeros((len(p) + len(q), len(known)), np.float32)
    rows[np.repeat(np.arange(len(rows)), p.shape[1]), place.ravel()] = 1
    return rows[: len(p)] @ rows[len(p) :].T


def _owned(key: int, p: np.ndarray, q: np.ndarray, one: bool) -> np.ndarray:
    """Per pair of rows: whether key is the list of their smallest shared pivot, or two pivots."""
    shared = np.sort(np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p.astype(np.int64), _NONE), axis=1)
    return (shared[:, 0] if one else shared[:, 0] << 32 | shared[:, 1]) == key


def _tile(key: int, dim: int, same: bool, left: pa.Table, right: pa.Table, cosine: float, min_shared: int) -> pa.Table:
    def load(t):
        return t.column("node").to_numpy(), t.column("m").to_numpy(), _units(t.column("v").to_pylist(), dim), np.array(t.column("pivots").to_pylist(), np.int32).reshape(t.num_rows, -1)

    ids, m, x, p = load(left)
    ids2, m2, y, q = (ids, m, x, p) if same else load(right)
    min_shared = min(min_shared, p.shape[1])  # fewer pivots than asked for: all vectors share them all
    found = np.ones((len(ids), len(ids2)), bool) if key < 0 else _shared(p, q) >= min_shared
    if same:
        found &= np.arange(len(ids))[:, None] < np.arange(len(ids))[None, :]
    if 8 * found.sum() > found.size:
        a, b = np.nonzero(found & (x @ y.T >= cosine))
    else:
        a, b = np.nonzero(found)
        ok = [np.einsum("ij,ij->i", x[a[i : i + 50_000]], y[b[i : i + 50_000]]) >= cosine for i in range(0, len(a), 50_000)]
        a, b = (a[k], b[k]) if ok and len(k := np.concatenate(ok)) else (a, b)
    if key >= 0:
        ok = [_owned(key, p[a[i : i + 50_000]], q[b[i : i + 50_000]], min_shared < 2) for i in range(0, len(a), 50_000)]
        a, b = (a[k], b[k]) if ok and len(k := np.concatenate(ok)) else (a, b)
    if same:
        return _summary(ids, m, a, b)
    return _summary(np.concatenate((ids, ids2)), np.concatenate((m, m2)), a, b + len(ids))


def _summary(ids: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Link counts of nodes ids with m members each, and links that span their components, from links a-b of positions."""
    links = (np.bincount(a, m[b], minlength=len(ids)) + np.bincount(b, m[a], minlength=len(ids))).astype(np.int64)
    label = spanning(len(ids), a, b)
    counted, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
    return pa.Table.from_arrays([
        pa.array(np.concatenate((ids[counted], ids[moved])), pa.int64()),
        pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ids[label[moved]], pa.int64())]),
        pa.array(np.concatenate((links[counted], np.zeros(len(moved), np.int64))), pa.int64()),
    ], schema=_TILE)


def _short_lists(dim: int, group: pa.Table, cosine: float, min_shared: int) -> pa.Table:
    """The links of many lists of one table: neighbours at every distance within a list, first by shared pivots, then by cosine."""
    group = group.sort_by("list")
    key, ids, m = (group.column(c).to_numpy() for c in ("list", "node", "m"))
    p = np.array(group.column("pivots").to_pylist(), np.int32).reshape(len(key), -1)
    least, one = min(min_shared, p.shape[1]), min(min_shared, p.shape[1]) < 2
    found = []
    for k in range(1, len(key)):
        a = np.flatnonzero(key[k:] == key[:-k])
        if not len(a):
            break
        for i in range(0, len(a), 50_000):
            x = a[i : i + 50_000]
            if key[0] >= 0:
                same = (p[x][:, :, None] == p[x + k][:, None, :]).any(axis=2)
                up = np.sort(np.where(same, p[x].astype(np.int64), _NONE), axis=1)
                x = x[(same.sum(axis=1) >= least) & ((up[:, 0] if one else up[:, 0] << 32 | up[:, 1]) == key[x])]
            found.append(np.stack((x, x + k), axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    used, pairs = np.unique(pairs, return_inverse=True)
    pairs = pairs.reshape(-1, 2)
    x = _units(group.column("v").take(pa.array(used)).to_pylist(), dim)
    ok = [np.einsum("ij,ij->i", x[q[:, 0]], x[q[:, 1]]) >= cosine for q in (pairs[i : i + 20_000] for i in range(0, len(pairs), 20_000))]
    pairs = pairs[np.concatenate(ok)] if ok else pairs
    return _summary(ids[used], m[used], pairs[:, 0], pairs[:, 1])


def pivot_index(nodes: DataFrame, depth: int, min_shared: int, max_pivots: int, vectors_per_pivot: int) -> DataFrame:
    """(node, m, dim, v, pivots, lists) of nodes (node, m, embedding); v holds the components as doubles."""
    n = nodes.count()
    most = int(min(max_pivots, max(4 * depth, n // vectors_per_pivot)))
    # the vectors with the smallest hashes; a bound on the hash leaves each task a few of them and not its own first 2 * most
    place = F.pmod(F.xxhash64("embedding"), F.lit(1 << 31))
    few = nodes.select("embedding", place.alias("place")).where(F.col("place") < int(min(1.0, 8 * most / max(n, 1)) * (1 << 31)))
    sample = [r.embedding for r in few.orderBy("place", "embedding").limit(2 * most).select("embedding").collect()]
    held = nodes.sparkSession.sparkContext.broadcast(_choose(sample, most))
    return nodes.select("node", "m", "embedding").mapInArrow(lambda it: _describe(it, held.value, depth, min_shared), "node long, m long, dim int, v binary, pivots array<int>, lists array<long>")


def links(index: DataFrame, cosine: float, min_shared: int, chunk: int) -> DataFrame:
    """(a, null, n): n links of a; (a, b, 0): spanning links. Counts of one node add up over rows."""
    filed = index.select("dim", F.explode("lists").alias("list"))
    sizes = materialize(filed.groupBy("dim", "list").count().where(F.col("count") > SHORT).select("dim", "list", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "pivot-lists")
    few = sizes.count() <= BROADCAST_ROWS
    files = filed.count() // FILE_ROWS + 1
    dealt = index.select("node", "m", "dim", "v", "pivots", F.explode("lists").alias("list")).join(F.broadcast(sizes) if few else sizes, ["dim", "list"], "left")
    long = F.col("parts").isNotNull()
    dealt = dealt.withColumn("own", F.when(long, F.pmod(F.xxhash64("node", "list"), F.col("parts"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # short lists go by file, numbered under zero; long ones by list and tile
    at = F.when(long, F.col("list")).otherwise(-2 - F.pmod(F.xxhash64("list"), F.lit(files)))
    tiles = dealt.select("node", "m", "dim", "v", "pivots", "list", at.alias("at"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def run(key, group):
        dim, at, i, j = (k.as_py() for k in key)
        if at < -1:
            return _short_lists(dim, group, cosine, min_shared)
        own = group.column("own").to_numpy()
        left = group if i == j else group.filter(pa.array(own == i))
        right = group if i == j else group.filter(pa.array(own == j))
        return _tile(at, dim, i == j, left, right, cosine, min_shared)

    return tiles.groupBy("dim", "at", "i", "j").applyInArrow(run, "a long, b long, n long")


def embedding_components(embeddings: DataFrame, cosine: float = 0.95, depth: int = 6, min_shared: int = 2, max_pivots: int = MAX_PIVOTS, vectors_per_pivot: int = VECTORS_PER_PIVOT, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    src = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    vectors = src.where("vec_id is not null").distinct()
    ok = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("embedding", lambda c: c != 0)
    )
    vectors = materialize(vectors.withColumn("valid", F.coalesce(ok, F.lit(False))), "pivot-vectors")
    classes = vectors.where("valid").groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")  # numbers are fixed by the written table
    index = materialize(pivot_index(nodes, depth, min_shared, max_pivots, vectors_per_pivot), "pivot-index")
    found = materialize(links(index, cosine, min_shared, chunk), "pivot-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("other")).withColumnRenamed("a", "node")
    labels = connected_components(found.where("b is not null"))
    placed = nodes.select("node", "embedding", "m", "rep").join(counts, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.withColumn("n_links", F.col("m") - 1 + F.coalesce("other", F.lit(0))), "pivot-placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    few = materialize(least, "pivot-least")
    joined = placed.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "component", "left").select("embedding", "n_links", F.coalesce("component_id", "rep").alias("component_id"))
    out = vectors.where("valid").join(joined, "embedding").select("vec_id", "n_links", "component_id")
    alone = vectors.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = src.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone).unionByName(nameless)
    discard(index)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
