"""Standardisation and channel reductions.

Moments are grouped aggregates joined back, not windows: partial aggregation keeps a
recording with a third of all rows from landing in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import complete, join_on
from tracemill.operators.rolling import rolling

KEYS = ("patient_num",)
CHANNEL = "channel"


def standardize(
    signal: DataFrame,
    standardization: str,
    keys: Sequence[str] = KEYS,
    strict: bool = False,
    value: str = "value",
    pool: Sequence[str] = (),
) -> DataFrame:
    """Z-score each channel "within" its recording or "across" all recordings.

    With `pool`, a part of `keys`, "across" means all recordings that agree in these columns.

    The moments are taken over the time steps at which the first channel is present; a
    channel that is missing at one of those becomes missing altogether. `strict=True`
    uses each channel's own present steps instead.
    """
    if standardization == "within":
        groups = [*keys, CHANNEL]
    elif standardization == "across":
        groups = [*pool, CHANNEL]
    else:
        raise ValueError(f"unknown standardization {standardization!r}")
    v = F.col(value)
    if strict:
        used = signal
        moments = used.groupBy(*groups).agg(F.avg(v).alias("_mu"), F.stddev_samp(v).alias("_sd"))
    else:
        step = Window.partitionBy(*keys, "idx")
        first = F.min_by(F.struct(v), F.col(CHANNEL)).over(step)[value]
        used = signal.withColumn("_first", first).filter(F.col("_first").isNotNull())
        moments = used.groupBy(*groups).agg(
            complete(F.avg(v), v).alias("_mu"), complete(F.stddev_samp(v), v).alias("_sd")
        )
    z = (v - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return join_on(signal, moments, groups, "left").withColumn(value, z).drop("_mu", "_sd")


def standardize_one(signal: DataFrame, standardization: str, **options) -> DataFrame:
    """Standardise a single recording, for which pooling across recordings is refused."""
    if standardization == "across":
        raise ValueError("cannot standardize across a single recording")
    return standardize(signal, standardization, **options)


def standardize_with(signal: DataFrame, mean: Column | None, std: Column | None, **options) -> DataFrame:
    """Standardise by given moments, or within the recording when both are absent."""
    if (mean is None) != (std is None):
        raise ValueError("give both moments or neither")
    if mean is None:
        return standardize(signal, "within", **options)
    return signal.withColumn("value", (F.col("value") - mean) / std)


def rolling_deviation(
    signal: DataFrame, k: int, stat: str = "mean", keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    """Rolling statistic, z-scored per channel over its present windows."""
    rolled = rolling(signal, k, stat, keys=(*keys, CHANNEL), **options)
    return standardize(rolled, "within", keys, strict=True)


def deviation_detections(
    signal: DataFrame, k: int, criterion: Callable[[Column], Column], stat: str = "mean", keys: Sequence[str] = KEYS
) -> DataFrame:
    return rolling_deviation(signal, k, stat, keys).withColumn("detected", criterion(F.col("value")))


def _reduction(aggregate: Callable[[Column], Column], absolute: bool) -> Callable[..., DataFrame]:
    def reduce(signal: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
        v = F.abs(value) if absolute else F.col(value)
        return signal.groupBy(*keys, "idx").agg(complete(aggregate(v), v).alias(value))

    return reduce


def reduce_distance(signal: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Euclidean distance of each step's channel vector from the recording's mean vector.

    The mean divides each channel's sum by the number of steps at which *all* channels
    are present.
    """
    v = F.col(value)
    steps = signal.groupBy(*keys, "idx").agg((F.count(F.lit(1)) == F.count(v)).alias("_all"))
    present = steps.groupBy(*keys).agg(F.count_if("_all").alias("_steps"))
    sums = signal.groupBy(*keys, CHANNEL).agg(F.sum(F.coalesce(v, F.lit(0.0))).alias("_sum"))
    means = join_on(sums, present, keys).select(
        *keys, CHANNEL, (F.col("_sum") / F.nullif(F.col("_steps"), F.lit(0))).alias("_mean")
    )
    gap = v - F.col("_mean")
    far = join_on(signal, means, [*keys, CHANNEL]).groupBy(*keys, "idx")
    return far.agg(complete(F.sqrt(F.sum(gap * gap)), v).alias(value))


REDUCTIONS: dict[str, Callable[..., DataFrame]] = {
    "maxany": _reduction(F.max, False),
    "meanall": _reduction(F.avg, False),
    "maxanyabs": _reduction(F.max, True),
    "meanallabs": _reduction(F.avg, True),
    "distance": reduce_distance,
}


def reduce_channels(signal: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Collapse channels to one value per step by a registered reduction."""
    return REDUCTIONS[name](signal, keys)


def rms(signal: DataFrame, keys: Sequence[str] = KEYS, classes: tuple[int, int] | None = None, by: str = CHANNEL) -> DataFrame:
    """Root mean square over channels (or motif classes `classes`, both ends included)."""
    v = F.col("value")
    used = signal if classes is None else signal.filter(F.col(by).between(*classes))
    return used.groupBy(*keys, "idx").agg(complete(F.sqrt(F.avg(v * v)), v).alias("value"))


def variability(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spread and level of one series per recording."""
    return series.groupBy(*keys).agg(
        F.stddev_samp("value").alias("variability"), F.avg("value").alias("average_amp")
    )
