"""Connected components by alternating large-star and small-star rounds (Kiveris et al.), as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_to_groups, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: the neighbours of each node move to the least of them."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = join_to_groups(both, least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # edges point from the larger to the smaller node
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, class: for every node of the links the least node of its component. Any orderable type will do.

    Ends when a round changes nothing, which the method reaches after a number of rounds of the order of log2(edges) squared.
    The edges of a round are deleted once the next are written.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        after = materialize(_star(_star(edges, large=True), large=False), "edges")
        discard(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    classes = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots.select("node", F.col("node").alias("class"))), "classes")
    discard(edges)
    return classes


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
