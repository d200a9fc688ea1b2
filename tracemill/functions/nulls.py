"""Aggregates in which a NULL poisons the result.

Spark aggregates skip NULL; a recording with missing samples must instead yield a
missing value for every window, block or channel set that touches one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complete(aggregate: Column, value: ColumnOrName) -> Column:
    """`aggregate`, or NULL when any row of the group has a NULL `value`."""
    return F.when(F.count(F.lit(1)) == F.count(col(value)), aggregate)


def complete_frame(aggregate: Column, present: Column, k: int) -> Column:
    """`aggregate`, or NULL unless the frame holds exactly `k` non-NULL values."""
    return F.when(present == F.lit(k), aggregate)


def rounded(c: ColumnOrName, digits: int = 6) -> Column:
    """Rounded double with negative zero folded into zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a NULL equals a NULL, so that no row is lost; keys come once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*(f"_right_{k}" for k in keys))
