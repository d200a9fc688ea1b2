"""Detector evaluation: targets and non-targets, ROC curves, areas and operating points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.intervals import bin_rows, containing_bins, epochize, invert
from tracemill.functions.nulls import join_on
from tracemill.operators.scan import running, value_blocks
from tracemill.operators.signal import coarse_grain
from tracemill.session import cut_lineage

KEYS = ("patient_num",)
ROOT_EPSILON = 2.0**-26  # square root of double precision


def snippets_per_epoch(epoch_s: int, snippet_s: int) -> int:
    per = epoch_s // snippet_s
    if per * snippet_s != epoch_s:
        raise ValueError("an epoch must be a whole number of snippets")
    return per


def epoch_grid(epochs: DataFrame, recordings: DataFrame, epoch_s: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: start of the first and last epoch and their number."""
    count = epochs.groupBy(*keys).agg((F.max("bin") + 1).alias("n_bins"))
    grid = join_on(recordings.select(*keys, F.col("start_s").cast("double")), count, keys)
    return grid.select(
        *keys,
        F.col("start_s").alias("first_s"),
        "n_bins",
        "start_s",
        (F.col("start_s") + (F.col("n_bins") - 1) * float(epoch_s)).alias("stop_s"),
    )


def negative_hours(
    intervals: DataFrame, grid: DataFrame, epoch_s: int, keys: Sequence[str] = KEYS, on_empty: str = "raise"
) -> DataFrame:
    """Hours of epochs outside the intervals; epochs under two intervals count twice."""
    bins = containing_bins(intervals, grid, epoch_s, keys, on_empty)
    used = bins.groupBy(*keys).agg(F.sum(F.col("last_bin") - F.col("first_bin") + 1).alias("_used"))
    hours = (F.col("n_bins") - F.coalesce("_used", F.lit(0))) * float(epoch_s) / 3600.0
    return join_on(grid, used, keys, "left").select(*keys, hours.alias("non_seizure_hours"))


def _epochs_of(intervals: DataFrame, grid: DataFrame, epoch_s: int, keys: Sequence[str]) -> DataFrame:
    return bin_rows(containing_bins(intervals, grid, epoch_s, keys))


def seizure_targets(
    signal: DataFrame,
    seizures: DataFrame,
    recordings: DataFrame,
    epoch_s: int,
    snippet_s: int,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Scores with `is_target`: one per epochised seizure, one per epoch outside them.

    A seizure scores the highest present epoch it touches and is skipped when it has none.
    The last epoch is never a non-target, since the bins of an interval that starts
    there are empty.
    """
    # one row per epoch, read by five branches below: written once instead of planned five times
    epochs = cut_lineage(coarse_grain(signal, snippets_per_epoch(epoch_s, snippet_s), F.max, keys))
    grid = epoch_grid(epochs, recordings, epoch_s, keys)
    epochs = epochs.filter(F.col("value").isNotNull())
    truth = cut_lineage(epochize(seizures, grid, epoch_s, keys))
    rest = invert(truth, grid, keys)
    hits = join_on(_epochs_of(truth, grid, epoch_s, keys), epochs, [*keys, "bin"])
    targets = hits.groupBy(*keys, "on_s").agg(F.max("value").alias("score"))
    quiet = join_on(_epochs_of(rest, grid, epoch_s, keys), epochs, [*keys, "bin"])
    return targets.select(*keys, "score", F.lit(True).alias("is_target")).unionByName(
        quiet.select(*keys, F.col("value").alias("score"), F.lit(False).alias("is_target"))
    )


def patient_targets(*args, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """As `seizure_targets`, with one target per recording: its best seizure."""
    scores = seizure_targets(*args, keys=keys, **options)
    best = scores.filter("is_target").groupBy(*keys).agg(F.max("score").alias("score"))
    best = best.select(*keys, "score", F.lit(True).alias("is_target"))
    return best.unionByName(scores.filter(~F.col("is_target")).select(*best.columns))


TARGETS: dict[str, Callable[..., DataFrame]] = {"seizure": seizure_targets, "patient": patient_targets}


def counts_below(counted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add to `n_tar, n_non` per distinct score the numbers of both below it."""
    blocked = value_blocks(counted, keys, "score")
    below = {"tar_below": ("sum", F.col("n_tar")), "non_below": ("sum", F.col("n_non"))}
    return running(blocked, keys, "_block", ["score"], below, inclusive=False).drop("_block")


def score_counts(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Targets and non-targets per distinct score, with the counts below it.

    A score shared by very many rows becomes one row before any ordering.
    """
    counted = scores.groupBy(*keys, "score").agg(
        F.count_if("is_target").alias("n_tar"), F.count_if(~F.col("is_target")).alias("n_non")
    )
    return counts_below(cut_lineage(counted), keys)


def _with_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n_tar").alias("tar_all"), F.sum("n_non").alias("non_all"))
    if keys:
        return join_on(counts, totals, keys)
    both = totals.select(F.struct("tar_all", "non_all").alias("s")).scalar()
    return counts.withColumn("_s", both).select("*", "_s.tar_all", "_s.non_all").drop("_s")


def curve_of(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    full = _with_totals(counts, keys)
    pfa = 1 - (F.col("non_below") + F.col("n_non")) / F.nullif("non_all", F.lit(0))
    pmiss = (F.col("tar_below") + F.col("n_tar")) / F.nullif("tar_all", F.lit(0))
    points = full.select(*keys, F.col("score").alias("theta"), pfa.alias("pfa"), pmiss.alias("pmiss"))
    first = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    first = first.select(
        *keys, F.lit(None).cast("double").alias("theta"), F.lit(1.0).alias("pfa"), F.lit(0.0).alias("pmiss")
    )
    return first.unionByName(points)


def roc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False-alarm and miss rates after rejecting scores up to each `theta`.

    The first point, with theta NULL, rejects nothing.
    """
    return curve_of(score_counts(scores, keys), keys)


def area_of(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    wins = F.sum(F.col("n_tar") * (F.col("non_below") + F.col("n_non") / 2.0))
    pairs = F.sum("n_tar").cast("double") * F.sum("n_non")
    return counts.groupBy(*keys).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def auc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of (target, non-target) pairs in the right order, ties counting half."""
    return area_of(score_counts(scores, keys), keys)


def tpr_at_fphr(curve: DataFrame, fphr: float, keys: Sequence[str] = (), epochs_per_hour: float = 60.0) -> DataFrame:
    """Hit rate at the lowest threshold with at most `fphr` false alarms an hour.

    `epochs_per_hour` is 60 as published, which suits epochs of 60 s only.
    """
    held = curve.filter(F.col("pfa") * epochs_per_hour <= fphr)
    rank = F.coalesce("theta", F.lit(float("-inf")))
    return held.groupBy(*keys).agg((1 - F.min_by("pmiss", rank)).alias("tpr"))


def fphr_at_tpr(curve: DataFrame, tpr: float, keys: Sequence[str] = (), epochs_per_hour: float = 60.0) -> DataFrame:
    """False alarms an hour at the lowest threshold that misses at least `1 - tpr`."""
    held = curve.filter(F.col("pmiss") >= 1 - tpr)
    rank = F.coalesce("theta", F.lit(float("-inf")))
    return held.groupBy(*keys).agg((F.min_by("pfa", rank) * epochs_per_hour).alias("fphr"))


def threshold_range(signal: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Lowest and highest present value, opened up by the square root of epsilon."""
    return signal.groupBy(*keys).agg(
        (F.min(value) - ROOT_EPSILON).alias("theta_min"), (F.max(value) + ROOT_EPSILON).alias("theta_max")
    )


def roc_sweep(
    scores: DataFrame, n_thetas: int = 100, keys: Sequence[str] = KEYS, signal: DataFrame | None = None
) -> DataFrame:
    """ROC counts at `n_thetas` evenly spaced thresholds per key.

    The thresholds span the values of `signal`, or of the scores where none is given.

    Every score is placed once, at the last threshold it reaches, and the counts are
    summed from the top; nothing is compared with all thresholds.
    """
    edges = threshold_range(scores, keys, "score") if signal is None else threshold_range(signal, keys)
    edges = edges.withColumn("_step", (F.col("theta_max") - F.col("theta_min")) / (n_thetas - 1))
    placed = join_on(scores.filter(F.col("score").isNotNull()), edges, keys)

    def theta(i: Column) -> Column:
        return F.col("theta_min") + i * F.col("_step")

    guess = F.floor((F.col("score") - F.col("theta_min")) / F.col("_step"))
    guess = F.greatest(F.lit(0), F.least(guess, F.lit(n_thetas - 1)))
    placed = placed.withColumn("_at", guess.cast("bigint"))
    # the division may be off by one step against the thresholds as computed
    at = F.when(theta(F.col("_at")) > F.col("score"), F.col("_at") - 1)
    at = at.when(theta(F.col("_at") + 1) <= F.col("score"), F.col("_at") + 1).otherwise(F.col("_at"))
    placed = placed.withColumn("_at", F.greatest(F.lit(0), F.least(at, F.lit(n_thetas - 1))).cast("bigint"))
    cells = placed.groupBy(*keys, "_at").agg(
        F.count_if("is_target").alias("tp"), F.count_if(~F.col("is_target")).alias("fp")
    )
    grid = edges.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_thetas - 1).cast("bigint"))))
    down = Window.partitionBy(*keys).orderBy(F.col("_at").desc())
    every = Window.partitionBy(*keys)
    return (
        join_on(grid, cells, [*keys, "_at"], "left")
        .fillna({"tp": 0, "fp": 0})
        .select(
            *keys,
            theta(F.col("_at")).alias("theta"),
            F.sum("tp").over(down).alias("true_positives"),
            F.sum("tp").over(every).alias("gt_positive"),
            F.sum("fp").over(down).alias("false_positives"),
            F.sum("fp").over(every).alias("gt_negative"),
        )
    )


def auc_trapezoid(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area under a threshold sweep, from (0, 0), by rectangles and triangles.

    A sweep has a fixed number of thresholds per key, so its window is bounded.
    """
    down = Window.partitionBy(*keys).orderBy(F.col("theta").desc())
    tpr = F.col("true_positives") / F.nullif("gt_positive", F.lit(0))
    fpr = F.col("false_positives") / F.nullif("gt_negative", F.lit(0))
    steps = curve.withColumns({"_tpr": tpr, "_fpr": fpr})
    before = {
        "_t0": F.coalesce(F.lag("_tpr").over(down), F.lit(0.0)),
        "_f0": F.coalesce(F.lag("_fpr").over(down), F.lit(0.0)),
    }
    steps = steps.withColumns(before)
    area = (F.col("_t0") + 0.5 * (F.col("_tpr") - F.col("_t0"))) * (F.col("_fpr") - F.col("_f0"))
    return steps.groupBy(*keys).agg(F.sum(area).alias("auc"))


def rates(curve: DataFrame, epoch_s: float) -> DataFrame:
    """Plot axes of a sweep: hit rate, false-alarm rate and false alarms an hour."""
    negative = F.nullif("gt_negative", F.lit(0))
    return curve.withColumns(
        {
            "tpr": F.col("true_positives") / F.nullif("gt_positive", F.lit(0)),
            "fpr": F.col("false_positives") / negative,
            "fphr": F.col("false_positives") / (negative * epoch_s / 3600.0),
        }
    )
