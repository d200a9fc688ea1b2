"""Long-form recordings: time axis, masking of missing stretches, tumbling bins, snippets.

A signal has the columns `patient_num, channel, idx, value`; `keys` may name other or
further columns, so that several recordings or configurations run in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import complete, join_on
from tracemill.functions.scalar import clean_label, contains_any
from tracemill.functions.wide import by_channel, is_wide
from tracemill.operators.intervals import BLOCK_S, cover, merge, restrict
from tracemill.operators.scan import spread

KEYS = ("patient_num",)
CHANNEL = "channel"
STRETCH = 4096  # steps of a signal that meet starts under one key


def channel_names(signal: DataFrame) -> DataFrame:
    return signal.select(CHANNEL).distinct()


def with_time(signal: DataFrame, recordings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `t`, the second at which each sample starts."""
    axis = recordings.select(*keys, "sample_rate", "start_s")
    t = F.col("start_s") + F.col("idx") / F.col("sample_rate")
    return join_on(signal, axis, keys).withColumn("t", t).drop("sample_rate", "start_s")


def densify(cells: DataFrame, length: Column, keys: Sequence[str] = (*KEYS, CHANNEL)) -> DataFrame:
    """Fill absent cells with NULL so that every key has idx 0..length-1."""
    axis = cells.select(*keys).distinct().withColumn("_length", length)
    axis = spread(axis, F.lit(0), F.col("_length") - 1, "idx").drop("_length")
    return join_on(axis, cells, [*keys, "idx"], "left")


def drop_channels(signal: DataFrame, words: Sequence[str]) -> DataFrame:
    """Remove channels whose label contains any of `words`, ignoring case."""
    return signal.filter(~contains_any(CHANNEL, words))


def drop_listed_channels(
    signal: DataFrame, listed: DataFrame, default: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Remove channels by a per-recording list `words`, or `default` where none is listed."""
    fallback = F.array(*[F.lit(w) for w in default]) if default else F.expr("array()").cast("array<string>")
    joined = join_on(signal, listed.select(*keys, "words"), keys, "left")
    words = F.coalesce("words", fallback)
    hit = F.exists(words, lambda w: F.lower(F.col(CHANNEL)).contains(F.lower(w)))
    return joined.filter(~hit).drop("words")


def rename_channels(signal: DataFrame) -> DataFrame:
    return signal.withColumn(CHANNEL, clean_label(CHANNEL))


def mark_covered(
    signal: DataFrame,
    intervals: DataFrame,
    out: str,
    keys: Sequence[str] = KEYS,
    t: str = "t",
    block_s: float = BLOCK_S,
    disjoint: bool = False,
) -> DataFrame:
    """Boolean column telling whether `on <= t < off` holds for any interval of the key.

    The intervals are first merged, unless known to be `disjoint`, so a sample meets at
    most one piece and the left join on (key, time bucket) adds no rows.
    """
    pieces = cover(intervals if disjoint else merge(intervals, keys), keys, block_s)
    pieces = pieces.select(*keys, "bucket", "on_s", "off_s")
    left = signal.withColumn("bucket", F.floor(F.col(t) / block_s))
    match = [left[k].eqNullSafe(pieces[k]) for k in keys]
    match += [
        left["bucket"] == pieces["bucket"],
        pieces["on_s"] <= left[t],
        left[t] < pieces["off_s"],
    ]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    joined = left.join(pieces, condition, "left")
    return joined.select(*[left[c] for c in signal.columns], pieces["on_s"].isNotNull().alias(out))


def mask_covered(
    signal: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str] = KEYS,
    t: str = "t",
    block_s: float = BLOCK_S,
    disjoint: bool = False,
) -> DataFrame:
    """Set `value` to NULL inside the intervals (all channels of the key). The signal may be wide."""
    marked = mark_covered(signal, intervals, "_hit", keys, t, block_s, disjoint)
    free = F.when(~F.col("_hit"), F.col("value"))
    if is_wide(signal):
        free = F.coalesce(free, F.transform("value", lambda v: F.nullif(v, v)))
    return marked.withColumn("value", free).drop("_hit")


def poison_blocks(signal: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Make a whole block of `k` time steps NULL when any channel has a NULL in it."""
    block = Window.partitionBy(*keys, F.floor(F.col("idx") / k))
    bad = F.max(F.col("value").isNull()).over(block)
    return signal.withColumn("value", F.when(~bad, F.col("value")))


def coarse_grain(
    signal: DataFrame,
    k: int,
    reduce: Callable[[Column], Column] = F.max,
    keys: Sequence[str] = (*KEYS, CHANNEL),
    value: str = "value",
    full_only: bool = False,
) -> DataFrame:
    """Tumbling bins of `k` steps; a bin with a NULL is NULL, the last may be shorter.

    `full_only` drops a shorter last bin.
    """
    binned = signal.groupBy(*keys, F.floor(F.col("idx") / k).alias("bin")).agg(
        complete(reduce(F.col(value)), value).alias(value), F.count(F.lit(1)).alias("_rows")
    )
    if full_only:
        binned = binned.filter(F.col("_rows") == k)
    return binned.drop("_rows")


def coarse_grain_flags(
    flags: DataFrame, k: int, keys: Sequence[str] = (*KEYS, CHANNEL), flag: str = "flag"
) -> DataFrame:
    return coarse_grain(flags, k, F.bool_or, keys, flag)


def block_mean(signal: DataFrame, k: int, keys: Sequence[str] = (*KEYS, CHANNEL)) -> DataFrame:
    """Downsample by averaging full blocks of `k` samples."""
    return coarse_grain(signal, k, F.avg, keys, full_only=True)


def downsample(signal: DataFrame, k: int) -> DataFrame:
    """Keep every k-th sample, for trace plots."""
    return signal.filter(F.col("idx") % k == 0)


def snippets(
    signal: DataFrame,
    length: int,
    keys: Sequence[str] = KEYS,
    offset: int = 0,
    full_only: bool = True,
) -> DataFrame:
    """Gather each tumbling snippet of `length` steps into one row.

    The row holds `n_channels`, `length` and `cells`: the values in channel-major order, over
    all channels of the recording and all steps of the snippet, with NULL where a sample is
    NULL or absent. With `full_only` a last snippet that the recording does not fill is left
    out. A snippet is bounded by channels x length. The signal may be wide.
    """
    at = F.col("idx") - offset
    used = signal.filter(at >= 0)
    outline = _outline(used, keys, at)
    step = (at % length).cast("bigint")
    count = F.floor((F.col("_top") + 1) / length) if full_only else F.floor(F.col("_top") / length) + 1
    every = spread(outline, F.lit(0), count - 1, "snippet")
    filled = used.groupBy(*keys, F.floor(at / length).alias("snippet")).agg(_collected(used, step))
    rows = join_on(every, filled, [*keys, "snippet"], "left").withColumn(
        "length", F.least(F.lit(length).cast("bigint"), F.col("_top") + 1 - F.col("snippet") * length)
    )
    return _placed(rows).select(*keys, "snippet", "n_channels", "cells", "length")


def _outline(signal: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Channels and last step of each recording, from one row per channel."""
    if is_wide(signal):
        return signal.groupBy(*keys).agg(F.max(F.size("value")).alias("_width"), F.max(at).cast("bigint").alias("_top"))
    each = signal.groupBy(*keys, CHANNEL).agg(F.max(at).cast("bigint").alias("_top"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_set(CHANNEL)).alias("_channels"), F.max("_top").alias("_top"))


def _collected(signal: DataFrame, step: Column) -> Column:
    """Samples, or whole steps of a wide signal, in the order of a snippet's cells."""
    order = [step.alias("step")] if is_wide(signal) else [F.col(CHANNEL), step.alias("step")]
    return F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("_cells")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds `n_channels` and `cells`, the values of `_cells` at their places, NULL at all others."""
    if "_width" in rows.columns:
        held = F.map_from_entries(F.coalesce("_cells", F.array().cast(rows.schema["_cells"].dataType)))
        every = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1), lambda s: F.try_element_at(held, s))
        steps = F.when(F.size("_cells") == F.col("length"), F.col("_cells.value")).otherwise(every)
        cells = F.flatten(by_channel(steps, F.col("_width")))
        return rows.withColumns({"n_channels": F.col("_width").cast("bigint"), "cells": cells}).drop("_cells", "_width")
    rows = rows.withColumns(
        {
            "n_channels": F.size("_channels").cast("bigint"),
            "_cells": F.coalesce("_cells", F.array().cast(rows.schema["_cells"].dataType)),
        }
    )
    size = (F.col("n_channels") * F.col("length")).cast("bigint")
    place = lambda c: (F.array_position("_channels", c[CHANNEL]) - 1) * F.col("length") + c["step"]
    present = F.transform("_cells", lambda c: F.struct(place(c).cast("bigint").alias("p"), c["value"].alias("v")))
    absent = F.array_except(F.sequence(F.lit(0).cast("bigint"), size - 1), F.transform("_cells", lambda c: place(c).cast("bigint")))
    nothing = F.lit(None).cast(rows.schema["_cells"].dataType.elementType["value"].dataType)
    holes = F.transform(absent, lambda p: F.struct(p.alias("p"), nothing.alias("v")))
    placed = F.transform(F.sort_array(F.concat(present, holes)), lambda x: x["v"])
    cells = F.when(F.size("_cells") == size, F.col("_cells.value")).otherwise(placed)
    return rows.withColumn("cells", cells).drop("_cells", "_channels")


def snippets_at(
    signal: DataFrame, starts: DataFrame, length: int, keys: Sequence[str] = KEYS, identity: Sequence[str] = ()
) -> DataFrame:
    """Gather the `length` steps from each start on; snippets may overlap and begin anywhere.

    `starts` has `keys`, `first` (the step of the first sample) and the columns `identity`. Rows are
    as those of `snippets`, with `first` and `identity`, and `snippet`, the same as `first`. A start
    whose snippet begins before step 0 or goes past the recording's last step has no row; equal rows
    of `starts` count once. The signal and the starts meet by stretches of the time axis: a start
    is in the one or two stretches that its snippet touches, so no sample is read for starts far off.
    The signal may be wide.
    """
    stretch = max(length, STRETCH)
    outline = _outline(signal, keys, F.col("idx"))
    wanted = join_on(starts.select(*keys, F.col("first").cast("bigint").alias("first"), *identity).distinct(), outline, keys)
    wanted = wanted.filter((F.col("first") >= 0) & (F.col("first") + length - 1 <= F.col("_top")))
    places = wanted.select(*keys, "first").distinct()
    touched = F.sequence(F.floor(F.col("first") / stretch), F.floor((F.col("first") + length - 1) / stretch))
    near = places.withColumn("_stretch", F.explode(touched))
    held = join_on(signal.withColumn("_stretch", F.floor(F.col("idx") / stretch)), near, [*keys, "_stretch"])
    step = (F.col("idx") - F.col("first")).cast("bigint")
    inside = held.filter((step >= 0) & (step < length))
    filled = inside.groupBy(*keys, "first").agg(_collected(signal, step))
    rows = join_on(wanted, filled, [*keys, "first"], "left").withColumn("length", F.lit(length).cast("bigint"))
    placed = _placed(rows).withColumn("snippet", F.col("first"))
    return placed.select(*keys, "snippet", "first", *identity, "n_channels", "cells", "length")


def snip(
    samples: DataFrame,
    intervals: DataFrame,
    reviewer_counts: DataFrame,
    recordings: DataFrame,
    start_s: int,
    stop_s: float,
    keys: Sequence[str] = KEYS,
) -> dict[str, DataFrame]:
    """Cut all four tables of a recording down to [start_s, stop_s).

    A stop past the end of a recording is pulled back to its end.
    """
    if int(start_s) != start_s:
        raise ValueError("a snip must start on a whole second")
    end = F.least(F.lit(float(stop_s)), F.col("start_s") + F.col("duration_s"))
    bounds = recordings.select(*keys, "sample_rate", "start_s", end.alias("_stop"))
    first = F.round((F.lit(start_s) - F.col("start_s")) * F.col("sample_rate")).cast("bigint")
    last = F.floor((F.col("_stop") - F.col("start_s")) * F.col("sample_rate")).cast("bigint")
    cut = join_on(samples, bounds, keys).filter((F.col("idx") >= first) & (F.col("idx") < last))
    cut = cut.withColumn("idx", F.col("idx") - first).select(*samples.columns)
    seconds = join_on(reviewer_counts, bounds, keys)
    seconds = seconds.filter((F.col("sec") >= start_s) & (F.col("sec") < F.floor("_stop")))
    held = restrict(
        join_on(intervals, bounds.select(*keys, "_stop"), keys), F.lit(float(start_s)), F.col("_stop")
    )
    outline = recordings.withColumn("_stop", end)
    outline = outline.withColumn("start_s", F.lit(float(start_s)))
    outline = outline.withColumn("duration_s", F.col("_stop") - start_s)
    return {
        "samples": cut,
        "intervals": held.select(*intervals.columns),
        "reviewer_counts": seconds.select(*reviewer_counts.columns),
        "recordings": outline.select(*recordings.columns),
    }


def widen_and_snip(
    signal: DataFrame, intervals: DataFrame, min_len: float, keys: Sequence[str] = KEYS, t: str = "t"
) -> DataFrame:
    """Samples of each interval widened to about `min_len` seconds.

    The right edge is `off + (min_len - (off - wide_on))`, which is what the figures used:
    the widening on the right starts from the already widened left edge.
    """
    grow = F.lit(float(min_len)) - (F.col("off_s") - F.col("on_s"))
    wide = intervals.withColumn("wide_on", F.greatest(F.lit(0.0), F.col("on_s") - grow / 2))
    edge = F.col("off_s") + (F.lit(float(min_len)) - (F.col("off_s") - F.col("wide_on")))
    wide = wide.withColumn("wide_off", edge)
    pieces = spread(wide, F.floor(F.col("wide_on") / BLOCK_S), F.floor(F.col("wide_off") / BLOCK_S), "bucket")
    left = signal.withColumn("bucket", F.floor(F.col(t) / BLOCK_S))
    hit = (F.col("wide_on") <= F.col(t)) & (F.col(t) <= F.col("wide_off"))
    return join_on(left, pieces, [*keys, "bucket"]).filter(hit).drop("bucket")
