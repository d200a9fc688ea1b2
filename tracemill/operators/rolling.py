"""Trailing windows over long recordings.

Rows are cut into blocks of the time axis, each with a copy of the last `k - 1` rows
before it, so every window lies inside one block and no key is confined to one task.
Windows use prefix and suffix aggregates of tiles of `k` steps: a window is the tail of one
tile and the head of the next, which costs the same per row whatever `k` is and cancels
nothing. A plain sliding frame (`method="sliding"`) is there to compare with. Steps must not
repeat within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import complete_frame
from tracemill.functions.wide import by_channel, is_wide
from tracemill.operators.scan import PARTS

KEYS = ("patient_num", "channel")
MIN_BLOCK = 8192

_AGGREGATE = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}


def _with_halo(df: DataFrame, keys: Sequence[str], idx: str, size: int, reach: int) -> DataFrame:
    i = F.col(idx)
    blocks = F.sequence(F.floor(i / size), F.floor((i + reach) / size))
    # one exchange that serves the windows over blocks and over their tiles alike
    return df.withColumn("_block", F.explode(blocks)).repartition(PARTS, *keys, "_block")


def _block_size(k: int, block_len: int | None) -> int:
    wanted = block_len or max(MIN_BLOCK, 64 * k)
    return max(1, -(-wanted // k)) * k


def rolling(
    df: DataFrame,
    k: int,
    stat: str = "mean",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    value: str = "value",
    out: str = "value",
    block_len: int | None = None,
    method: str = "tiled",
) -> DataFrame:
    """Trailing `stat` over `k` steps; NULL unless all `k` steps are there and non-NULL."""
    if stat not in _AGGREGATE:
        raise KeyError(stat)
    size = _block_size(k, block_len)
    halo = _with_halo(df, keys, idx, size, k - 1)
    if method == "sliding":
        rolled = _sliding(halo, k, stat, keys, idx, value)
    else:
        rolled = _tiled(halo, k, stat, keys, idx, value)
    kept = rolled.filter(F.col("_block") == F.floor(F.col(idx) / size))
    columns = [c for c in df.columns if c != out]
    return kept.select(*columns, F.col("_rolled").alias(out))


def rolling_by(
    df: DataFrame,
    k: int,
    window_fn: Callable[[Column], Column],
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    value: str = "value",
    out: str = "value",
    block_len: int | None = None,
) -> DataFrame:
    """Trailing windows of `k` steps by any function of the array of their values, in order of time.

    NULL unless all `k` steps are there and non-NULL. Every row gathers its window, so the work is
    `k` per row; the statistics of `rolling` don't need that. The signal may be wide, with the keys of
    a recording; the result is long.
    """
    size = _block_size(k, block_len)
    frame = Window.partitionBy(*keys, "_block").orderBy(idx).rangeBetween(-(k - 1), 0)
    gathered = _with_halo(df, keys, idx, size, k - 1).withColumn("_values", F.collect_list(value).over(frame))
    kept = gathered.filter(F.col("_block") == F.floor(F.col(idx) / size))
    columns = [c for c in df.columns if c != out]
    if is_wide(df, value):
        columns = [c for c in columns if c != value]
        kept = kept.select(*columns, F.posexplode(by_channel(F.col("_values"), F.size(value))).alias("channel", "_values"))
        kept = kept.withColumn("_values", F.filter("_values", lambda v: v.isNotNull()))
        columns.append("channel")
    return kept.select(*columns, F.when(F.size("_values") == k, window_fn(F.col("_values"))).alias(out))


def quantile_of(share: float) -> Callable[[Column], Column]:
    """The quantile of a window, for `rolling_by`, with linear interpolation between neighbours."""

    def pick(values: Column) -> Column:
        ordered = F.sort_array(values)
        at = (F.size(values) - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        a, b = (F.element_at(ordered, (p + 1).cast("int")) for p in (low, high))
        return a + (at - low) * (b - a)

    return pick


median = quantile_of(0.5)


def window_steps(window_s: float, step_s: float) -> int:
    """Whole steps of `step_s` seconds in a window; one that holds none is refused."""
    k = int(window_s // step_s)
    if k < 1:
        raise ValueError(f"a window of {window_s} s holds no step of {step_s} s")
    return k


def rolling_seconds(
    df: DataFrame, window_s: float, step_s: float, stat: str | Callable[[Column], Column] = "mean", **options
) -> DataFrame:
    """Trailing windows given in seconds, by a named statistic or a function of the window's values."""
    k = window_steps(window_s, step_s)
    return rolling(df, k, stat, **options) if isinstance(stat, str) else rolling_by(df, k, stat, **options)


def _sliding(halo: DataFrame, k: int, stat: str, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    frame = Window.partitionBy(*keys, "_block").orderBy(idx).rangeBetween(-(k - 1), 0)
    v = F.col(value)
    return halo.withColumn(
        "_rolled", complete_frame(_AGGREGATE[stat](v).over(frame), F.count(v).over(frame), k)
    )


def _tiled(halo: DataFrame, k: int, stat: str, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    tiled = halo.withColumn("_tile", F.floor(F.col(idx) / k))
    tile = Window.partitionBy(*keys, "_block", "_tile")
    head = tile.orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    tail = tile.orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(*keys, "_block").orderBy("_tile", idx)  # sorted as the heads are
    v = F.col(value)
    parts = {"n": F.count(v)}
    if stat == "std":
        parts |= {"a": F.avg(v), "q": F.var_pop(v)}
    elif stat == "mean":
        parts |= {"a": F.sum(v)}
    else:
        parts |= {"a": _AGGREGATE[stat](v)}
    tails = tiled.withColumns({f"_t{p}": agg.over(tail) for p, agg in parts.items()})
    heads = tails.withColumns({f"_h{p}": agg.over(head) for p, agg in parts.items()})
    back = {f"_b{p}": F.lag(f"_t{p}", k - 1).over(block) for p in parts}
    both = heads.withColumns(back | {"_from": F.lag(idx, k - 1).over(block)})
    whole = (F.col(idx) + 1) % k == 0
    gapless = F.col("_from") == F.col(idx) - (k - 1)
    full = gapless & (F.when(whole, F.col("_hn")).otherwise(F.col("_bn") + F.col("_hn")) == k)
    return both.withColumn("_rolled", F.when(full, _merged(stat, k, whole)))


def _merged(stat: str, k: int, whole: Column) -> Column:
    a, b = F.col("_ha"), F.col("_ba")
    if stat == "mean":
        return F.when(whole, a).otherwise(a + b) / k
    if stat == "sum":
        return F.when(whole, a).otherwise(a + b)
    if stat in ("max", "min"):
        pick = F.greatest if stat == "max" else F.least
        return F.when(whole, a).otherwise(pick(a, b))
    # pooled sum of squared deviations of two parts
    n, m = F.col("_hn"), F.col("_bn")
    gap = a - b
    pooled = F.col("_hq") * n + F.col("_bq") * m + gap * gap * n * m / (n + m)
    return F.sqrt(F.when(whole, F.col("_hq") * k).otherwise(pooled) / (k - 1))


def moving_average(df: DataFrame, k: int, skip_missing: bool = False, **options) -> DataFrame:
    """Backward moving average that starts at step `k - 1`.

    A NULL in the window poisons it; with `skip_missing` the mean is over what is present.
    """
    idx = options.get("idx", "idx")
    if not skip_missing:
        return rolling(df, k, "mean", **options).filter(F.col(idx) >= k - 1)
    keys, value, out = options.get("keys", KEYS), options.get("value", "value"), options.get("out", "value")
    size = _block_size(k, options.get("block_len"))
    halo = _with_halo(df, keys, idx, size, k - 1)
    frame = Window.partitionBy(*keys, "_block").orderBy(idx).rangeBetween(-(k - 1), 0)
    rolled = halo.withColumn(out, F.avg(value).over(frame))
    kept = (F.col("_block") == F.floor(F.col(idx) / size)) & (F.col(idx) >= k - 1)
    return rolled.filter(kept).drop("_block")
