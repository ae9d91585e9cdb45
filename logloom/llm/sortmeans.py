"""Centroid clustering by sort-means: exact k-means rounds over integer vectors with a pruned search.

A vector's components become integers, floor(scale * x). Each round orders, for each centroid, the other centroids by
their distance from it. A vector scans that order of its previous assignment's centroid and stops at the first centroid
strictly beyond twice its distance from the previous one: by the triangle inequality none behind it is nearer, and one
exactly at twice the distance may tie, so it is still looked at. Ties go to the smaller number. Distances are squared
throughout (beyond four times), in 64-bit integers, so they are exact.

Vectors and assignments go from round to round as a table in the shared folder, written once a round and deleted when
the next one stands. A task adds up its vectors by centroid before anything is shuffled, and its sums are rows of the
same table: what is shuffled and collected is at most k rows a task and k rows a round, whatever a cluster's size.

Defined cases: a vector that is null, has another length, or a null or non-finite component is left out; so is one with
a component whose integer is not within 2 ** 27 of zero, as its squared distances need not fit into a long. A null id is
clustered and sorts after all others among the candidates for a start. Repeated rows count as often as they come, equal
starting hashes go by id and then by components, and of equal centroids the one with the
smaller number takes all. Fewer vectors than k give as many centroids as vectors; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize

LIMIT = 1 << 27
BATCH = 4096
_ROUND = "vec_id long, v binary, cluster int, distance long, sums array<long>, n long"


def integer_vectors(vectors: DataFrame, length: int, scale: int) -> DataFrame:
    """vec_id, v (the integer components, as an array of int) of every vector that can be clustered."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / scale))
    kept = vectors.where(F.coalesce((F.size("embedding") == length) & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("int")).alias("v"))


def starting_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of "<seed>:<id>", in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(h.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def scan_orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, beyond): for each centroid the numbers of the others by distance from it, and these squared distances."""
    between = np.stack([_squared(centroids, c) for c in centroids])
    np.fill_diagonal(between, -1)
    order = np.argsort(between, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(between, order, axis=1)


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, order: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row of x, scanning from centroid was[i]; and how many
    distances were computed."""
    current = _squared(x, centroids[was])
    best, least = was.copy(), current.copy()
    live, looked = np.arange(len(x)), len(x)
    for j in range(order.shape[1]):
        live = live[beyond[was[live], j] <= 4 * current[live]]
        if not len(live):
            break
        c = order[was[live], j]
        d = _squared(x[live], centroids[c])
        looked += len(live)
        nearer = (d < least[live]) | ((d == least[live]) & (c < best[live]))
        at = live[nearer]
        best[at], least[at] = c[nearer], d[nearer]
    return best, least, looked


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector as 16-bit integers where they do, else as 32-bit ones; its length tells which."""
    small = (np.abs(x) < 1 << 15).all(axis=1)
    narrow, wide = x.astype("<i2"), x.astype("<i4")
    return [(narrow if s else wide)[i].tobytes() for i, s in enumerate(small)]


def _unpacked(column: pa.Array, length: int) -> np.ndarray:
    rows = column.to_pylist()
    narrow = np.fromiter((len(b) == 2 * length for b in rows), bool, len(rows))
    out = np.empty((len(rows), length), np.int64)
    for kind, at in (("<i2", np.flatnonzero(narrow)), ("<i4", np.flatnonzero(~narrow))):
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, length)
    return out


def _round(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One assignment: the vectors with cluster and distance, and per task and cluster a row of sums."""
    k, length = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, *scan_orders(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order, beyond = shared.value
        sums, inertia, n = np.zeros((k, length), object), np.zeros(k, object), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                if pa.types.is_list(b.column(1).type):
                    x, was = np.array(b.column(1).flatten().to_numpy(), np.int64).reshape(-1, length), np.zeros(b.num_rows, np.int64)
                    v = pa.array(_packed(x), pa.binary())
                else:
                    x, was, v = _unpacked(b.column(1), length), b.column(2).to_numpy().astype(np.int64), b.column(1)
                found, distance, _ = nearest(x, was, centroids, order, beyond)
                for c in np.unique(found):
                    own = found == c
                    sums[c] += x[own].sum(axis=0)
                    inertia[c] += int(distance[own].sum()) if distance[own].max() < 1 << 50 else sum(map(int, distance[own]))
                    n[c] += own.sum()
                yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(found, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(b.num_rows, pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.int64())], names=["vec_id", "v", "cluster", "distance", "sums", "n"])
        seen = np.flatnonzero(n)
        # the inertia of a task may need more than a long: it goes in two halves behind the sums
        halves = [[*map(int, sums[c]), int(inertia[c]) >> 31, int(inertia[c]) & (1 << 31) - 1] for c in seen]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int32()), pa.nulls(len(seen), pa.int64()), pa.array(halves, pa.list_(pa.int64())), pa.array(n[seen], pa.int64())], names=["vec_id", "v", "cluster", "distance", "sums", "n"])
        give_back()

    return vectors.mapInArrow(run, _ROUND)


def _totals(assigned: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact sums of each cluster: at most k rows."""
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = assigned.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()
    return {r.cluster: (int(r.n), [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, length: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its integers) of every kept vector.

    vectors has vec_id and embedding. An inertia that doesn't fit into a long is null.
    """
    kept = integer_vectors(vectors, length, scale)
    centroids = starting_centroids(kept, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return kept.limit(0).selectExpr("vec_id", "cast(null as int) cluster", "0L distance", "0L cluster_inertia", "0L inertia", "v centroid")
    assigned, state = None, kept
    for r in range(rounds + 1):
        before, assigned = assigned, materialize(_round(state, centroids), f"sortmeans-{r}")
        if before is not None:
            discard(before)
        totals = _totals(assigned, length + 2)
        if r < rounds:
            for c, (n, sums) in totals.items():
                centroids[c] = [s // n for s in sums[:length]]
            state = assigned.where("n is null").select("vec_id", "v", "cluster")
    inertia = {c: (s[length] << 31) + s[length + 1] for c, (_, s) in totals.items()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(inertia[c]), fits(sum(inertia.values())), centroids[c].tolist()) for c in totals]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    # k rows at most
    return assigned.where("n is null").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def cluster_digest(vectors: DataFrame, **options) -> DataFrame:
    """cluster_vectors with centroid_sha256 in place of the centroid."""
    found = cluster_vectors(vectors, **options)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, length: int = 64, scale: int = 256) -> str:
    """The same clusters in DuckDB's SQL, every vector against every centroid."""
    square = f"list_sum(list_transform(range(1, {length + 1}), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(CAST(x AS DOUBLE)) < {LIMIT / scale})) = {length})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, vec_id, v) - 1 AS INTEGER) AS k, v AS c FROM v QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, k := k)) AS a FROM (SELECT rid, k, CAST({square} AS BIGINT) AS d FROM v, c{r} c) GROUP BY rid)")
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT a.k AS k, i, sum(v.v[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {length + 1}) t(i) GROUP BY 1, 2) GROUP BY k) m ON m.k = c{r}.k)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} c ON c.k = a.k"""
