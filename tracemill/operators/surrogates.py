"""Surrogates of snippets, drawn by hashes so that any engine can draw the same ones.

A cell's chance is the md5 of `seed:draw:identity:place`, places counting from 0 in the
snippet's order of cells. A lost task draws again what it drew before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chance(seed: int, draw: Column, identity: Sequence[str], place: Column) -> Column:
    names = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in identity]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), *names, place.cast("string")))


def _draws(draws: int) -> Column:
    return F.array(*[F.lit(d) for d in range(draws)])


def shuffled_cells(cells: str, identity: Sequence[str], draws: int, seed: int = 0) -> Column:
    """`draws` permutations of an array of cells, one after the other: cells in order of chance."""

    def one(draw: Column) -> Column:
        marked = F.transform(cells, lambda v, i: F.struct(_chance(seed, draw, identity, i).alias("c"), v.alias("v")))
        return F.array_sort(marked)["v"]

    return F.flatten(F.transform(_draws(draws), one))


def normal_cells(cells: str, identity: Sequence[str], draws: int, seed: int = 0) -> Column:
    """As many standard normal values as cells, per draw, from two halves of each cell's chance."""

    def one(draw: Column) -> Column:
        chances = F.transform(cells, lambda v, i: _chance(seed, draw, identity, i))
        unit = lambda c, at: (F.conv(F.substring(c, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
        return F.transform(chances, lambda c: F.sqrt(-2 * F.log(unit(c, 1))) * F.cos(2 * math.pi * unit(c, 9)))

    return F.flatten(F.transform(_draws(draws), one))
