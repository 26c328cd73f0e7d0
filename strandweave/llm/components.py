"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import join_groups
from strandweave.session import save_scratch


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, as ``(low, high)``, without loops."""
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    return edges.filter(f"{a} <> {b}").select(low, high).distinct()


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("high").alias("v")), F.struct(F.col("high").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
    around = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    # Only the neighbours above a node are moved.
    upper = edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
    return join_groups(upper, around, "u", "n", n_edges).select("v", "m")


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    lower = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    around = lower.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_groups(lower, around, "u", "n", n_edges).select("v", "m")
    return moved.unionByName(around.select(F.col("u").alias("v"), "m"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum that tells whether they changed."""
    low_bits = F.xxhash64("low", "high").bitwiseAND(F.lit((1 << 40) - 1))
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(low_bits), F.lit(0)).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for the nodes of ``edges``: the smallest node each one can reach.

    Loops, repeated edges and edges with a null end are allowed and mean nothing. Nodes without an
    edge to another node are not returned. The number of rounds grows with the logarithm of a
    component's size; neighbours are never gathered and hubs are joined by broadcast.
    """
    stars = save_scratch(_pairs(edges, a, b))
    state = _mark(stars)
    while state[0]:
        large = save_scratch(_pairs(_large_star(stars, state[0]), "v", "m"))
        stars = save_scratch(_pairs(_small_star(large, state[0]), "v", "m"))
        now = _mark(stars)
        if now == state:
            break
        state = now
    return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
