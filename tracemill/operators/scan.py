"""Ordered running aggregates without putting a whole key into one task.

A plain window over a key sorts every row of that key in one task, which fails when one
key holds a large share of the data. Here the ordered axis is cut into blocks: each block
is scanned on its own, the block totals (one row per block) are scanned across blocks,
and the carried totals are joined back on (key, block). Blocks are expressions of the row
(stretches of a time axis, or of a value's range between approximate quantiles), so that a
scan stays one lazy plan; where the borders lie never changes an answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import join_on

#: Tasks over the samples of all recordings. Given outright, so that few bytes a row put no more rows into a task.
PARTS = 400

Outputs = Mapping[str, tuple[str, Column]]

_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carried)
    return (F.greatest if kind == "max" else F.least)(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    outputs: Outputs,
    inclusive: bool = True,
) -> DataFrame:
    """Add running `sum`, `max`, `min` or `last` (latest non-NULL) columns.

    `block` is an integer column that never decreases along `order`.
    """
    frame = Window.partitionBy(*keys, block).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local, totals, carried = {}, [], {}
    for name, (kind, value) in outputs.items():
        if kind == "last":
            local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(frame)
            rank = F.struct(*order)
            totals.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"_t_{name}"))
        else:
            local[f"_l_{name}"] = _AGGREGATE[kind](value).over(frame)
            totals.append(_AGGREGATE[kind](value).alias(f"_t_{name}"))
        carried[f"_c_{name}"] = (kind, F.col(f"_t_{name}"))
    blocks = df.groupBy(*keys, block).agg(*totals)
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        *keys,
        block,
        *(
            (F.last(v, ignorenulls=True) if kind == "last" else _AGGREGATE[kind](v)).over(across).alias(name)
            for name, (kind, v) in carried.items()
        ),
    )
    joined = join_on(df.withColumns(local), carry, [*keys, block])
    merged = {
        name: _combine(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}"))
        for name, (kind, _) in outputs.items()
    }
    return joined.withColumns(merged).drop(*local, *carried)


def time_blocks(df: DataFrame, at: str, length: float) -> DataFrame:
    """Number stretches of `length` of a time axis as `_block`."""
    return df.withColumn("_block", F.floor(F.col(at) / length))


COARSE, FINE = 32, 32


def value_blocks(df: DataFrame, keys: Sequence[str], value: str, at: str = "_block") -> DataFrame:
    """Number stretches of a numeric column's range as `at`, `COARSE * FINE` per key at most.

    The coarse borders are approximate quantiles, each stretch between two is cut evenly.
    They only place the blocks: any borders give the same running totals.
    """
    v = F.col(value).cast("double")
    shares = F.array(*[F.lit(i / COARSE) for i in range(COARSE + 1)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(v, shares, F.lit(1000)).alias("_cuts"))
    held = join_on(df, cuts, keys) if keys else df.withColumn("_cuts", cuts.scalar())
    coarse = F.greatest(F.size(F.filter("_cuts", lambda c: c < v)), F.lit(1))
    low, high = F.try_element_at("_cuts", coarse), F.try_element_at("_cuts", coarse + 1)
    share = F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * FINE)
    fine = F.least(F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)), F.lit(FINE - 1))
    return held.withColumn(at, (coarse * FINE + fine).cast("bigint")).drop("_cuts")


SPREAD = 1 << 16


def spread(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """One row per whole number from `first` to `last` (none when that is before `first`).

    The range is cut into stretches that go to different tasks before they are filled in,
    so a very long range is neither one array nor one task.
    """
    names = df.columns
    held = df.withColumns({"_first": first.cast("bigint"), "_last": last.cast("bigint")})
    starts = F.sequence("_first", "_last", F.lit(SPREAD).cast("bigint"))
    cut = held.filter("_first <= _last").withColumn("_from", F.explode(starts))
    filled = F.sequence("_from", F.least(F.col("_from") + SPREAD - 1, F.col("_last")))
    return cut.repartition(*names, "_from").select(*names, F.explode(filled).alias(out))
