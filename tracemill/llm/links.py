"""Tiles of rows that must meet, and connected components of links."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage


def tiled(
    rows: DataFrame, cell: str, reach: Sequence[int], block: int, spread_by: Sequence[str], weight: Column | None = None
) -> DataFrame:
    """Deal `rows` out so that every two rows of cells `reach` apart meet in one tile.

    `cell` is a long column; `reach` holds the differences of cells that must meet, 0 and
    negatives of all included. A cell with more than `block` rows is cut into units by a hash
    of `spread_by`; a tile is a pair of units, so it holds about two blocks at most, however
    large a cell is. With `weight`, blocks are measured by its sum instead of by rows. Adds `tile` (long) and `side` (0, 1, or 2 where both units are the same).
    """
    sized = rows.groupBy(cell).agg(F.ceil((F.count("*") if weight is None else F.sum(weight)) / block).alias("_units"))
    held = rows.join(sized, cell).withColumn("_unit", F.pmod(F.xxhash64(*spread_by), F.col("_units")))
    units = sized.select(F.col(cell).alias("_c"), F.explode(F.sequence(F.lit(0), F.col("_units") - 1)).alias("_u"))
    near = units.withColumn("_d", F.explode(F.array(*(F.lit(int(r)).cast("long") for r in reach))))
    other = units.select(F.col("_c").alias("_c2"), F.col("_u").alias("_u2"))
    pairs = near.join(other, F.col("_c") + F.col("_d") == F.col("_c2")).filter(
        (F.col("_c") < F.col("_c2")) | ((F.col("_c") == F.col("_c2")) & (F.col("_u") <= F.col("_u2")))
    )
    same = (F.col("_c") == F.col("_c2")) & (F.col("_u") == F.col("_u2"))
    first = F.struct(F.col("_c").alias(cell), F.col("_u").alias("_unit"), F.when(same, 2).otherwise(0).alias("side"))
    second = F.struct(F.col("_c2").alias(cell), F.col("_u2").alias("_unit"), F.lit(1).alias("side"))
    sides = pairs.select(
        F.xxhash64("_c", "_u", "_c2", "_u2").alias("tile"),
        F.explode(F.when(same, F.array(first)).otherwise(F.array(first, second))).alias("_s"),
    ).select("tile", "_s.*")
    return held.join(sides, [cell, "_unit"]).drop("_unit", "_units")


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest index joined to each of 0..n-1 by the links a[i]-b[i].

    `parent`, the result of other links, is taken up and changed, so links can come in parts.
    """
    parent = np.arange(n) if parent is None else parent
    while True:
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        if not apart.any():
            return parent
        a, b, pa, pb = a[apart], b[apart], pa[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of the links (a, b).

    Alternates large and small stars: each round only takes minima per node and joins them
    back, so no neighbourhood is collected. Nodes without a link to another are left out.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = cut_lineage(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct())
        state, before = _state(edges), state
        if state == before:
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
