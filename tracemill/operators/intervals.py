"""Interval algebra on annotation tables with `keys..., on_s, off_s` (half-open seconds).

Neighbouring intervals meet through block scans (see `scan`), so a recording with very
many annotations is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import join_on
from tracemill.operators.scan import running, spread, time_blocks

KEYS = ("patient_num",)
BLOCK_S = 300.0  # seconds of a recording per join key
SCAN_S = 86_400.0  # seconds of a recording per scanned block


def runs(
    flags: DataFrame,
    flag: str = "flag",
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    one_based: bool = True,
    block_len: int = 65536,
) -> DataFrame:
    """Maximal runs of true flags as intervals.

    `one_based` numbers samples from 1 and gives `off` as one past the last sample,
    except that a run reaching the last sample of the key ends at that sample.
    With `one_based=False` the runs are plain half-open 0-based intervals.
    """
    i = F.col(idx)
    up = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    base = flags.select(*keys, i.cast("bigint").alias("_i"), up.alias("_up"))
    ends = base.groupBy(*keys).agg(F.max("_i").alias("_n"))
    near = F.sequence(F.floor((F.col("_i") - 1) / block_len), F.floor((F.col("_i") + 1) / block_len))
    halo = base.filter("_up").withColumn("_block", F.explode(near))
    order = Window.partitionBy(*keys, "_block").orderBy("_i")
    edges = (
        halo.withColumn("_first", F.coalesce(F.lag("_i").over(order) != F.col("_i") - 1, F.lit(True)))
        .withColumn("_last", F.coalesce(F.lead("_i").over(order) != F.col("_i") + 1, F.lit(True)))
        .filter((F.col("_block") == F.floor(F.col("_i") / block_len)) & (F.col("_first") | F.col("_last")))
    )
    edges = time_blocks(edges.select(*keys, "_i", "_first", "_last"), "_i", block_len)
    opened = running(edges, keys, "_block", ["_i"], {"_on": ("max", F.when(F.col("_first"), F.col("_i")))})
    closed = join_on(opened.filter("_last"), ends, keys)
    if not one_based:
        return closed.select(
            *keys, F.col("_on").cast("double").alias("on_s"), (F.col("_i") + 1).cast("double").alias("off_s")
        )
    stop = F.when(F.col("_i") == F.col("_n"), F.col("_i") + 1).otherwise(F.col("_i") + 2)
    return closed.select(*keys, (F.col("_on") + 1).cast("double").alias("on_s"), stop.cast("double").alias("off_s"))


def buffered(start: Column, duration: Column, buffer: float = 1.0) -> Column:
    """Interval around a note: widened by `buffer`, a note without duration as a point."""
    length = F.when(duration > 0, duration).otherwise(F.lit(0))
    return F.struct((start - buffer).alias("on_s"), (start + length + buffer).alias("off_s"))


def event_bounds(onset: Column, duration: Column) -> Column:
    """Interval of an annotated event; without a duration, one second to each side."""
    lasting = duration.isNotNull() & (duration > 0)
    return F.when(
        lasting, F.struct(onset.alias("on_s"), (onset + duration).alias("off_s"))
    ).otherwise(F.struct((onset - 1).alias("on_s"), (onset + 1).alias("off_s")))


def overlaps(first_off: Column, second_on: Column) -> Column:
    """Overlap of two intervals sorted by onset; touching counts."""
    return second_on <= first_off


def _joined(df: DataFrame, keys: Sequence[str], nested: bool) -> DataFrame:
    base = df.groupBy(*keys, "on_s").agg(F.max("off_s").alias("off_s"))
    base = time_blocks(base, "on_s", SCAN_S)
    kind = "max" if nested else "last"
    seen = running(base, keys, "_block", ["on_s"], {"_seen": (kind, F.col("off_s"))}, inclusive=False)
    opens = F.col("_seen").isNull() | ~overlaps(F.col("_seen"), F.col("on_s"))
    island = {"_island": ("max", F.when(opens, F.col("on_s")))}
    islands = running(seen, keys, "_block", ["on_s"], island)
    off = F.max("off_s") if nested else F.max_by("off_s", "on_s")
    merged = islands.groupBy(*keys, "_island").agg(off.alias("off_s"))
    return merged.select(*keys, F.col("_island").alias("on_s"), "off_s")


def collapse(df: DataFrame, keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    """Join overlapping or touching intervals, ending each at the *latest starting* member.

    An interval nested in another therefore shortens the result. The running end is
    always the end of the previous interval in order, so comparing neighbours suffices.
    `strict=True` takes the furthest end instead, as `merge` does.
    """
    if strict:
        return merge(df, keys)
    sentinel = (F.col("on_s") == -1.0) & (F.col("off_s") == -1.0)
    return _joined(df, keys, nested=False).filter(~sentinel)


def merge(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of the intervals of each key as disjoint intervals; touching ones join."""
    return _joined(df, keys, nested=True)


def merge_sets(first: DataFrame, second: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    cols = [*keys, "on_s", "off_s"]
    return merge(first.select(*cols).unionByName(second.select(*cols)), keys)


def invert(df: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaps of ordered, disjoint intervals inside each key's [start_s, stop_s].

    The two ends enter as rows of their own, before and after all others.
    """

    def rows(df: DataFrame, rank: int, on: Column, off: Column) -> DataFrame:
        return df.select(
            *keys, F.lit(rank).alias("_rank"), on.cast("double").alias("on_s"), off.cast("double").alias("off_s")
        )

    start = rows(bounds, 0, F.lit(None), F.col("start_s"))
    body = rows(df, 1, F.col("on_s"), F.col("off_s"))
    stop = rows(bounds, 2, F.col("stop_s"), F.lit(None))
    order = ["_rank", "on_s"]
    far = F.lit(1 << 62)
    block = F.when(F.col("_rank") == 0, -far).when(F.col("_rank") == 2, far).otherwise(F.floor(F.col("on_s") / SCAN_S))
    blocked = start.unionByName(body).unionByName(stop).withColumn("_block", block)
    seen = running(blocked, keys, "_block", order, {"_seen": ("last", F.col("off_s"))}, inclusive=False)
    return seen.filter(F.col("on_s") - F.col("_seen") > 0).select(
        *keys, F.col("_seen").alias("on_s"), F.col("on_s").alias("off_s")
    )


def restrict(df: DataFrame, start: Column, stop: Column, strict: bool = False) -> DataFrame:
    """Clip intervals to [start, stop].

    An interval is kept only if one of its ends lies inside, so one that covers the whole
    range is dropped; `strict=True` keeps everything that overlaps.
    """
    inside = F.col("on_s").between(start, stop) | F.col("off_s").between(start, stop)
    if strict:
        inside = (F.col("on_s") <= stop) & (F.col("off_s") >= start)
    return df.filter(inside).withColumns(
        {"on_s": F.greatest("on_s", start), "off_s": F.least("off_s", stop)}
    )


def discretize(
    df: DataFrame, step: float, min_bound: Column | None = None, max_bound: Column | None = None
) -> DataFrame:
    """Widen each interval outward to multiples of `step`, inside the given bounds."""
    on = F.floor(F.col("on_s") / step) * float(step)
    off = F.ceil(F.col("off_s") / step) * float(step)
    if min_bound is not None:
        on = F.greatest(min_bound, on)
    if max_bound is not None:
        off = F.least(max_bound, off)
    return df.withColumns({"on_s": on.cast("double"), "off_s": off.cast("double")})


def epoch_pieces(df: DataFrame, bounds: DataFrame, epoch_s: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Widen by one epoch to each side, clip to the key's bounds, snap outward to epochs."""
    framed = join_on(df, bounds.select(*keys, "start_s", "stop_s"), keys)
    framed = framed.withColumns(
        {
            "on_s": F.greatest(F.col("on_s") - epoch_s, F.col("start_s")),
            "off_s": F.least(F.col("off_s") + epoch_s, F.col("stop_s")),
        }
    )
    snapped = discretize(framed, epoch_s, F.col("start_s"), F.col("stop_s"))
    return snapped.select(*keys, "on_s", "off_s")


def epochize(df: DataFrame, bounds: DataFrame, epoch_s: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Disjoint epoch-aligned intervals around the given ones."""
    return merge(epoch_pieces(df, bounds, epoch_s, keys), keys)


def containing_bins(
    df: DataFrame, bounds: DataFrame, bin_s: float, keys: Sequence[str] = KEYS, on_empty: str = "raise"
) -> DataFrame:
    """First and last bin (0-based) of a regular grid touched by each interval.

    `bounds` has the first bin's start `first_s` and the number of bins `n_bins` per key.
    An interval that starts in the last bin gets no bins at all. One whose last bin
    would precede its first is an error, or is dropped with `on_empty="drop"`.
    """
    framed = join_on(df, bounds.select(*keys, "first_s", "n_bins"), keys)
    lo = F.floor((F.col("on_s") - F.col("first_s")) / bin_s)
    lo = F.least(F.greatest(lo, F.lit(0)), F.col("n_bins") - 1).cast("bigint")
    # first bin that starts at or after the end
    after = F.greatest(F.ceil((F.col("off_s") - F.col("first_s")) / bin_s), F.lit(0))
    hi = (F.when(after >= F.col("n_bins"), F.col("n_bins")).otherwise(after) - 1).cast("bigint")
    out = framed.withColumns({"first_bin": lo, "last_bin": hi})
    out = out.filter(F.col("first_bin") != F.col("n_bins") - 1)
    if on_empty == "raise":
        failure = F.raise_error(F.lit("interval ends before its first bin")).cast("bigint")
        checked = F.when(F.col("last_bin") >= F.col("first_bin"), F.col("last_bin")).otherwise(failure)
        out = out.withColumn("last_bin", checked)
    else:
        out = out.filter(F.col("last_bin") >= F.col("first_bin"))
    return out.drop("first_s", "n_bins")


def bin_rows(bins: DataFrame, out: str = "bin") -> DataFrame:
    return spread(bins, F.col("first_bin"), F.col("last_bin"), out).drop("first_bin", "last_bin")


def cover(df: DataFrame, keys: Sequence[str] = KEYS, block_s: float = BLOCK_S) -> DataFrame:
    """One row per interval and time bucket it reaches, for equi-joins on (key, bucket)."""
    return spread(df, F.floor(F.col("on_s") / block_s), F.floor(F.col("off_s") / block_s), "bucket")


def snippet_starts(df: DataFrame, step: float) -> DataFrame:
    """Snippet starts `on, on+step, ...` of each interval, its end included."""
    count = F.floor((F.col("off_s") - F.col("on_s")) / step + F.lit(1e-9))
    steps = spread(df, F.lit(0), count, "_step")
    return steps.withColumn("start_s", F.col("on_s") + F.col("_step") * float(step)).drop("_step")


def control_bounds(
    seizures: DataFrame,
    artifacts: DataFrame,
    recordings: DataFrame,
    min_dist_s: float,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Stretches of [0, duration] free of artifacts and `min_dist_s` away from seizures."""
    edge = recordings.select(*keys, F.lit(0.0).alias("start_s"), F.col("duration_s").alias("stop_s"))
    wide = seizures.select(
        *keys, (F.col("on_s") - min_dist_s).alias("on_s"), (F.col("off_s") + min_dist_s).alias("off_s")
    )
    busy = wide.unionByName(artifacts.select(*keys, "on_s", "off_s"))
    busy = join_on(busy, edge, keys)
    busy = busy.filter((F.col("off_s") > F.col("start_s")) & (F.col("on_s") < F.col("stop_s")))
    busy = busy.select(
        *keys,
        F.greatest("on_s", "start_s").alias("on_s"),
        F.least("off_s", "stop_s").alias("off_s"),
    )
    return invert(merge(busy, keys), edge, keys)


def control_bounds_with_artifacts(
    seizures: DataFrame, recordings: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Stretches between seizures, pairing the sorted ends with the sorted starts by rank."""

    def ranked(points: DataFrame) -> DataFrame:
        # equal points share a row until they are spread over tasks
        counted = points.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))
        summed = running(time_blocks(counted, "p", SCAN_S), keys, "_block", ["p"], {"_upto": ("sum", F.col("n"))})
        ranks = spread(summed.select(*keys, "p", "n", "_upto"), F.col("_upto") - F.col("n") + 1, F.col("_upto"), "_rank")
        return ranks.select(*keys, "p", "_rank")

    zero = recordings.select(*keys, F.lit(0.0).alias("p"))
    end = recordings.select(*keys, F.col("duration_s").cast("double").alias("p"))
    starts = zero.unionByName(seizures.select(*keys, F.col("off_s").cast("double").alias("p")))
    stops = seizures.select(*keys, F.col("on_s").cast("double").alias("p")).unionByName(end)
    left = ranked(starts).withColumnRenamed("p", "on_s")
    return join_on(left, ranked(stops).withColumnRenamed("p", "off_s"), [*keys, "_rank"]).drop("_rank")


def shifted(df: DataFrame, shrink_s: float = 0.0) -> DataFrame:
    """Intervals for the mask `on + d <= t + 1 < off - d`, restated as `on <= t < off`."""
    on, off = F.col("on_s") + shrink_s - 1, F.col("off_s") - shrink_s - 1
    return df.withColumns({"on_s": on, "off_s": off}).filter("on_s < off_s")


def summary(recordings: DataFrame, seizures: DataFrame, artifacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cohort statistics over recordings: counts, total durations and their spread."""

    def per_recording(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.col("off_s") - F.col("on_s")).alias(f"s_{name}")
        )

    each = join_on(recordings, per_recording(artifacts, "a"), keys, "left")
    each = join_on(each, per_recording(seizures, "z"), keys, "left")
    each = each.fillna({"n_a": 0, "n_z": 0, "s_a": 0.0, "s_z": 0.0})
    seizing = F.col("n_z") > 0
    return each.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(F.col("n_a") > 0).alias("n_artifact_patients"),
        F.sum("n_a").alias("n_artifacts"),
        F.stddev_samp("n_a").alias("std_n_artifacts"),
        F.sum("s_a").alias("artifacts_duration"),
        F.stddev_samp("s_a").alias("std_artifacts_duration"),
        F.count_if(seizing).alias("n_seizing_patients"),
        F.sum("n_z").alias("n_seizures"),
        F.stddev_samp(F.when(seizing, F.col("n_z"))).alias("std_n_seizures"),
        F.sum("s_z").alias("seizures_duration"),
        F.stddev_samp(F.when(seizing, F.col("s_z"))).alias("std_seizures_duration"),
        F.sum("duration_s").alias("total_duration"),
        F.stddev_samp("duration_s").alias("std_total_duration"),
    )
