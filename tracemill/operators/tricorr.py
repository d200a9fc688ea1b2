"""Triple-correlation motif-class contributions of recordings, snippet by snippet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tracemill.functions.nulls import join_on

from tracemill.functions.scalar import motif_name
from tracemill.operators.tricorr_kernel import (
    MEASURES,
    N_CLASSES,
    contributions,
    normal_variance_per_cell,
    pair_lag_sums,
    marginal_sums,
)
from tracemill.operators.signal import snippets
from tracemill.operators.surrogates import normal_cells, shuffled_cells

KEYS = ("patient_num",)
CHUNK_CELLS = 1 << 16
SNIPPET_PARTS = 96


def _chunks(shapes: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of rows with one shape, a bounded number of cells at a time."""
    unique, inverse = np.unique(shapes, axis=0, return_inverse=True)
    for i, (channels, length) in enumerate(unique):
        rows = np.flatnonzero(inverse.ravel() == i)
        step = max(1, CHUNK_CELLS // max(1, int(channels * length)))
        for start in range(0, len(rows), step):
            yield rows[start : start + step]


def _map_snippets(
    rows: DataFrame,
    identity: Sequence[str],
    compute: Callable[[np.ndarray, np.ndarray], np.ndarray],
    width: int,
    surrogates: Column | None = None,
    draws: int = 0,
) -> DataFrame:
    """Replace `cells` by `out`, the flattened result of `compute` on stacks of snippets.

    `surrogates` holds the cells of `draws` surrogates one after the other; `compute` gets
    them as [draws, snippets, channels, times]. Rows with a missing cell get a NULL result.
    """
    fields = [f for f in rows.schema.fields if f.name in identity]
    schema = T.StructType([*fields, T.StructField("out", T.ArrayType(T.DoubleType()))])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells = batch.column("cells")
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.asarray(cells.value_lengths().fill_null(0)))
            noise = batch.column("surrogates").flatten().to_numpy(zero_copy_only=False)
            shapes = np.stack([np.asarray(batch.column(c)) for c in ("n_channels", "length")], axis=1)
            results = np.full((batch.num_rows, width), np.nan)
            missing = np.zeros(batch.num_rows, dtype=bool)
            for rows_at in _chunks(shapes):
                channels, length = shapes[rows_at[0]]
                size = int(channels * length)
                stack = np.stack([flat[ends[r] - size : ends[r]] for r in rows_at]).astype(float)
                gaps = np.isnan(stack).any(axis=1)
                missing[rows_at[gaps]] = True
                kept = rows_at[~gaps]
                if len(kept):
                    x = stack[~gaps].reshape(-1, int(channels), int(length))
                    drawn = [noise[(ends[r] - size) * draws : ends[r] * draws] for r in kept]
                    drawn = np.stack(drawn).astype(float).reshape(len(kept), draws, *x.shape[1:]).swapaxes(0, 1)
                    results[kept] = compute(x, drawn).reshape(len(kept), width)
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()),
                pa.array(results.ravel()),
                mask=pa.array(missing),
            )
            columns = [batch.column(f.name) for f in fields]
            table = pa.Table.from_arrays([*columns, values], names=arrow_schema.names).cast(arrow_schema)
            yield from table.to_batches()

    drawn = F.array().cast("array<double>") if surrogates is None else surrogates
    chosen = rows.select(*identity, "n_channels", "length", "cells", drawn.alias("surrogates"))
    return chosen.mapInArrow(run, schema)


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snippets in a given number of tasks: the work on one is large next to its bytes, by which Spark would pack them."""
    return rows.repartition(SNIPPET_PARTS, *keys, "snippet")


def class_contributions(
    signal: DataFrame,
    length: int,
    lag_extents: tuple[int, int],
    measure: str = "A_znorm",
    boundary: str = "periodic",
    keys: Sequence[str] = KEYS,
    seed: int = 0,
    per_cell: bool = False,
) -> DataFrame:
    """Contributions of the 14 motif classes in each tumbling snippet of `length` samples.

    The result is a signal again: `keys, channel (class 1..14), idx (snippet), value`; a
    snippet with a missing sample has 14 missing values. `per_cell` divides the sums by
    channels x times. The signal may be wide.
    """
    return contributions_of(dealt(snippets(signal, length, keys), keys), lag_extents, measure, boundary, keys, seed, per_cell)


def contributions_of(
    rows: DataFrame,
    lag_extents: tuple[int, int],
    measure: str = "A_znorm",
    boundary: str = "periodic",
    keys: Sequence[str] = KEYS,
    seed: int = 0,
    per_cell: bool = False,
) -> DataFrame:
    """As `class_contributions`, on rows that already hold whole snippets.

    The spread that `A_znorm_std` divides by is that of a periodic snippet, so other
    boundaries are refused, as are lags that a periodic snippet is too small for.
    """
    _, post, draws = MEASURES[measure]
    if post == "over_std" and boundary != "periodic":
        raise ValueError(f"{measure} is defined for a periodic boundary only")
    # computed once here, not in every task
    variance = normal_variance_per_cell(lag_extents) if post == "over_std" else None

    def compute(x: np.ndarray, surrogates: np.ndarray) -> np.ndarray:
        if boundary == "periodic" and any(2 * reach + 1 > size for reach, size in zip(lag_extents, x.shape[1:], strict=True)):
            raise ValueError(f"lags {lag_extents} wrap around a periodic snippet of {x.shape[1:]}")
        out = contributions(x, surrogates, measure, lag_extents, boundary, variance)
        return out / (x.shape[1] * x.shape[2]) if per_cell else out

    identity = [*keys, "snippet"]
    drawn = normal_cells if post == "over_normal" else shuffled_cells
    noise = drawn("cells", identity, draws, seed) if draws else None
    wide = _map_snippets(rows, identity, compute, N_CLASSES, noise, draws)
    classes = F.sequence(F.lit(1), F.lit(N_CLASSES))
    filled = F.coalesce("out", F.array_repeat(F.lit(None).cast("double"), N_CLASSES))
    return wide.select(
        *keys,
        F.col("snippet").alias("idx"),
        F.inline(F.arrays_zip(classes.alias("channel"), filled.alias("value"))),
    )


def named_classes(classes: DataFrame) -> DataFrame:
    return classes.withColumn("motif", motif_name("channel"))


def lag_kernel(
    rows: DataFrame, reach_a: int, reach_b: int, lag_channels: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Correlation per pair of time lags `b1, b2` of each snippet."""
    width = 2 * reach_b + 1

    def compute(x: np.ndarray, surrogates: np.ndarray) -> np.ndarray:
        return pair_lag_sums(x, reach_a, reach_b, lag_channels)

    wide = _map_snippets(rows, [*keys, "snippet"], compute, width * width)
    return wide.select(*keys, "snippet", F.posexplode("out").alias("_at", "value")).select(
        *keys,
        "snippet",
        (F.floor(F.col("_at") / width) - reach_b).alias("b1"),
        (F.col("_at") % width - reach_b).cast("bigint").alias("b2"),
        "value",
    )


def lag_marginals(
    rows: DataFrame,
    lag_extents: tuple[int, int],
    which: str = "time",
    shuffles: int = 2,
    keys: Sequence[str] = KEYS,
    seed: int = 0,
) -> DataFrame:
    """Zero-padded lag marginal of each snippet over the mean of its shuffled versions.

    `shuffles=0` gives the marginal itself.
    """
    reach_n, reach_t = lag_extents
    first = {"time": reach_t, "space": reach_n, "space_time": reach_n}[which]
    second = {"time": reach_t, "space": reach_n, "space_time": reach_t}[which]
    width = (2 * first + 1, 2 * second + 1)

    def compute(x: np.ndarray, surrogates: np.ndarray) -> np.ndarray:
        actual = marginal_sums(x, lag_extents)[which]
        if not shuffles:
            return actual
        noise = sum(marginal_sums(s, lag_extents)[which] for s in surrogates)
        return actual / (noise / shuffles)

    identity = [*keys, "snippet"]
    noise = shuffled_cells("cells", identity, shuffles, seed) if shuffles else None
    wide = _map_snippets(rows, identity, compute, width[0] * width[1], noise, shuffles)
    return wide.select(*keys, "snippet", F.posexplode("out").alias("_at", "value")).select(
        *keys,
        "snippet",
        (F.floor(F.col("_at") / width[1]) - first).alias("lag1"),
        (F.col("_at") % width[1] - second).cast("bigint").alias("lag2"),
        "value",
    )


def unit_range(signal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Map each snippet (or other group) onto [0, 1] by its extremes."""
    ends = signal.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return join_on(signal, ends, keys).withColumn("value", scaled).drop("_lo", "_hi")


def class_contributions_windowed(
    cells: DataFrame, lag_extents: tuple[int, int], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Zero-padded class sums by window functions alone.

    `cells` has `keys, snippet, row, idx, value` with `row` and `idx` counting channels and
    time steps from 0. Frames end at the edge of the snippet, which is zero padding. Every
    window is inside one snippet and all share one exchange.
    """
    reach_n, reach_t = lag_extents
    unit = [*keys, "snippet"]
    along = Window.partitionBy(*unit, "row").orderBy("idx")
    across = Window.partitionBy(*unit, "idx").orderBy("row")
    past_frame = along.rangeBetween(-reach_t, -1)
    next_frame = along.rangeBetween(1, reach_t)
    every = across.rangeBetween(-reach_n, reach_n)

    def past(v: Column) -> Column:
        return F.coalesce(F.sum(v).over(past_frame), F.lit(0.0))

    def after(v: Column) -> Column:
        return F.coalesce(F.sum(v).over(next_frame), F.lit(0.0))

    def others(v: Column) -> Column:
        return F.sum(v).over(every) - v

    c = F.col
    x = c("value")
    base = cells.repartition(*[F.col(k) for k in unit])
    own = base.withColumns(
        {"ap": past(x), "an": after(x), "qp": past(x * x), "qn": after(x * x)}
    )
    a_both = c("ap") + c("an")
    shared = own.withColumns(
        {
            "b": others(x),
            "oq": others(x * x),
            "oqp": others(c("qp")),
            "oqn": others(c("qn")),
            "zn": others(x * c("an")),
            "zp": others(x * c("ap")),
            "pn": others(c("an") ** 2 - c("qn")),
            "pp": others(c("ap") ** 2 - c("qp")),
            "ps": others(c("ap") * c("an")),
        }
    )
    b = c("b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    timed = shared.withColumns(
        {
            "bp": past(b),
            "bn": after(b),
            "bbp": past(b * b),
            "bbn": after(b * b),
            "abp": past(x * b),
            "abn": after(x * b),
            "cum": F.coalesce(F.sum(b).over(before), F.lit(0.0)),
        }
    )
    nested = timed.withColumns(
        {
            "np": past(x * c("cum")) - F.coalesce(F.lag("cum", reach_t).over(along), F.lit(0.0)) * c("ap"),
            "nn": after(x * c("cum")) - (c("cum") + b) * c("an"),
        }
    )
    b_both = c("bp") + c("bn")
    terms = [
        x * x,
        2 * x * a_both + c("qp") + c("qn"),
        a_both**2 - c("qp") - c("qn"),
        2 * x * b + c("oq"),
        2 * x * b_both + c("oqp") + c("oqn"),
        2 * (c("abp") + b * c("an") + c("zn")),
        2 * (b * c("ap") + c("abn") + c("zp")),
        2 * (c("np") + c("an") * c("bp")) + c("pn"),
        2 * (c("ap") * c("bp") - c("abp") - c("np") + c("nn") + c("ps")),
        2 * (c("ap") * c("bn") + c("an") * c("bn") - c("abn") - c("nn")) + c("pp"),
        b * b - c("oq"),
        2 * (b * c("bn") - c("zn")) + c("bbp") - c("oqp"),
        2 * (b * c("bp") - c("zp")) + c("bbn") - c("oqn"),
        b_both**2 - c("bbp") - c("bbn") - (c("pn") + c("pp") + 2 * c("ps")),
    ]
    sums = nested.groupBy(*unit).agg(*[F.sum(x * term).alias(f"c{i}") for i, term in enumerate(terms)])
    pairs = F.array(
        *[F.struct(F.lit(i + 1).alias("channel"), F.col(f"c{i}").alias("value")) for i in range(len(terms))]
    )
    return sums.select(*keys, F.col("snippet").alias("idx"), F.inline(pairs))
