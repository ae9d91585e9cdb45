"""Connected components of a link table by contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the smallest node it can reach.

    Each round every node points at its smallest neighbour or itself, pointers are followed to their
    roots, and edges are replaced by edges between roots; rounds grow with the logarithm of
    the longest path. Only tables in the shared folder carry state between rounds. Null
    ends and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and a < b").distinct()
    e = materialize(e, "cc-edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        parent = materialize(both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("p")), "cc-parent")
        while True:
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("q"))
            jumped = materialize(parent.join(up, "p").select("n", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "cc-parent")
            moving = not jumped.where("moved").isEmpty()
            discard(parent)
            parent = jumped
            if not moving:
                break
        parent = parent.select("n", "p")
        old, old_e = labels, e
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("component"))
            fresh = None
        else:
            labels = labels.join(parent.select(F.col("n").alias("component"), F.col("p")), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = fresh = materialize(labels, "cc-labels")
        ra, rb = parent.select(F.col("n").alias("a"), F.col("p").alias("ra")), parent.select(F.col("n").alias("b"), F.col("p").alias("rb"))
        e = e.join(ra, "a").join(rb, "b").where("ra <> rb")
        e = materialize(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        discard(old_e)
        if fresh is not None:
            discard(jumped)
            if old is not None:
                discard(old)
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
