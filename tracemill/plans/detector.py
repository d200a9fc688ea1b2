"""The detection and comparison runs, put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tracemill.functions.nulls import join_on

from tracemill.operators import detection, intervals, statistics
from tracemill.operators.rolling import rolling
from tracemill.operators.signal import drop_channels, mark_covered, poison_blocks
from tracemill.operators.standardize import reduce_channels, standardize
from tracemill.operators.tables import union_all
from tracemill.session import cut_lineage

KEYS = ("patient_num",)


def detector_signal(
    signal: DataFrame,
    window: int,
    standardization: str,
    reduction: str,
    stat: str = "mean",
    exclude: Sequence[str] = (),
    poison: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Signal to detector trace: mask, roll, standardise, reduce."""
    used = drop_channels(signal, exclude) if exclude else signal
    if poison:
        used = poison_blocks(used, poison, keys)
    rolled = rolling(used, window, stat, keys=(*keys, "channel"))
    return reduce_channels(standardize(rolled, standardization, keys), reduction, keys)


def mu_sigma_sweeps(
    signal: DataFrame,
    seizures: DataFrame,
    recordings: DataFrame,
    window: int,
    reduction: str,
    epoch_s: int,
    snippet_s: int = 1,
    n_thetas: int = 100,
    exclude: Sequence[str] = (),
    poison: int | None = None,
) -> DataFrame:
    """Threshold sweeps of each recording's rolled mean and of its rolled spread."""
    traces = []
    for stat in ("mean", "std"):
        trace = detector_signal(signal, window, "within", reduction, stat, exclude, poison)
        traces.append(trace.withColumn("rolling", F.lit(stat)))
    both = traces[0].unionByName(traces[1])
    kinds = F.explode(F.array(F.lit("mean"), F.lit("std")))
    keys = ("rolling", "patient_num")
    scores = detection.seizure_targets(
        both, seizures.withColumn("rolling", kinds), recordings.withColumn("rolling", kinds), epoch_s, snippet_s, keys
    )
    return detection.roc_sweep(scores, n_thetas, keys, both)


def sensitivity(
    traces: DataFrame,
    counts: DataFrame,
    recordings: DataFrame,
    epoch_s: int,
    reviewers: Sequence[int] = (3, 2, 1),
    snippet_s: int = 1,
    discretization_s: float | None = None,
    by: Sequence[str] = ("signal", "standardization"),
) -> DataFrame:
    """Area and operating points of every analysis setting in one pass.

    `traces` are detector traces with the columns `by` that tell the settings apart; each is
    scored against the seizures of each consensus level, per seizure and per patient. The
    settings are keys of the same tables, not separate runs.
    """
    settings = (*by, "min_reviewers_per_seizure")
    keys = (*settings, "patient_num")
    level = F.explode(F.array(*[F.lit(r) for r in reviewers]))
    configured = traces.select(*by).distinct()
    bounds = recordings.select(
        "patient_num", F.col("start_s").cast("double"), (F.col("start_s") + F.col("duration_s")).alias("stop_s")
    )
    marked = counts.withColumn("min_reviewers_per_seizure", level)
    flags = marked.select(
        "min_reviewers_per_seizure", "patient_num", F.col("sec").alias("idx"),
        (F.col("n") >= F.col("min_reviewers_per_seizure")).alias("flag"),
    )
    found = intervals.runs(flags, keys=("min_reviewers_per_seizure", "patient_num"))
    if discretization_s is not None:
        framed = join_on(found, bounds, ["patient_num"])
        found = intervals.discretize(framed, discretization_s, F.col("start_s"), F.col("stop_s"))
        found = intervals.merge(found, ("min_reviewers_per_seizure", "patient_num"))
    # the settings are few by construction, so they are carried as an array on each row
    kinds = configured.agg(F.collect_set(F.struct(*by))).scalar()

    def for_each_setting(df: DataFrame) -> DataFrame:
        spread = df.withColumn("_k", F.explode(kinds))
        return spread.select("*", *[f"_k.{c}" for c in by]).drop("_k")

    outlines = for_each_setting(recordings.withColumn("min_reviewers_per_seizure", level))
    scores = detection.seizure_targets(
        traces.withColumn("min_reviewers_per_seizure", level), for_each_setting(found), outlines, epoch_s, snippet_s, keys
    )
    scores = cut_lineage(scores)
    best = scores.filter("is_target").groupBy(*keys).agg(F.max("score").alias("score"), F.lit(True).alias("is_target"))
    by_seizure = scores.withColumn("target", F.lit("seizure"))
    by_patient = best.unionByName(scores.filter(~F.col("is_target"))).withColumn("target", F.lit("patient"))
    return evaluate(by_seizure.unionByName(by_patient), ("target", *settings))


def mask_grades(
    signal: DataFrame,
    artifacts: DataFrame,
    grade_sets: Sequence[Sequence[int]],
    step_s: float = 1.0,
    keys: Sequence[str] = KEYS,
    block_s: float = intervals.BLOCK_S,
) -> DataFrame:
    """The signal once per set of excluded grades, with the samples under such artifacts missing.

    `artifacts` are intervals with a `grade`. Every sample learns once which grades cover it, as
    the bits of a number; the sets are masks on that number. The new column
    `excluded_artifact_grades` is the set as text, such as "1,2".
    """
    grades = sorted({g for grade_set in grade_sets for g in grade_set})
    marked = signal.withColumns({"_t": F.col("idx") * float(step_s), "_bits": F.lit(0).cast("bigint")})
    for at, grade in enumerate(grades):
        of_grade = artifacts.filter(F.col("grade") == grade)
        marked = mark_covered(marked, of_grade, "_hit", keys, "_t", block_s)
        bit = F.when(F.col("_hit"), F.lit(1 << at)).otherwise(0)
        marked = marked.withColumn("_bits", F.col("_bits").bitwiseOR(bit.cast("bigint"))).drop("_hit")
    sets = [
        F.struct(
            F.lit(",".join(map(str, sorted(grade_set)))).alias("name"),
            F.lit(sum(1 << grades.index(g) for g in set(grade_set))).cast("bigint").alias("mask"),
        )
        for grade_set in grade_sets
    ]
    spread = marked.withColumn("_set", F.explode(F.array(*sets)))
    free = F.col("_bits").bitwiseAND(F.col("_set.mask")) == 0
    return spread.withColumns({"value": F.when(free, F.col("value")), "excluded_artifact_grades": F.col("_set.name")}).drop(
        "_t", "_bits", "_set"
    )


SETTINGS = ("signal", "excluded_artifact_grades", "patient_set")


def setting_traces(
    signal: DataFrame,
    members: DataFrame,
    reductions: Mapping[str, str],
    window: int,
    stat: str = "mean",
    standardizations: Sequence[str] = ("within", "across"),
) -> DataFrame:
    """Detector traces of every signal, set of grades, set of recordings and standardisation.

    `signal` has `signal, excluded_artifact_grades` besides the usual columns, `members` a row
    (`patient_num, patient_set`) for each recording of each set, and `reductions` the channel
    reduction of each kind of signal. Windows don't depend on the set of recordings, so they
    are taken once, before the sets are joined; "across" pools the recordings of one set.
    """
    rolled = rolling(signal, window, stat, keys=("signal", "excluded_artifact_grades", "patient_num", "channel"))
    # one value per window and channel, read by each standardisation and reduction below
    rolled = join_on(cut_lineage(rolled), members.select("patient_num", "patient_set"), ["patient_num"])
    keys = (*SETTINGS, "patient_num")
    traces = []
    for standardization in standardizations:
        scaled = standardize(rolled, standardization, keys, pool=SETTINGS)
        for reduction in sorted(set(reductions.values())):
            kinds = [name for name, used in reductions.items() if used == reduction]
            trace = reduce_channels(scaled.filter(F.col("signal").isin(kinds)), reduction, keys)
            traces.append(trace.withColumns({"standardization": F.lit(standardization), "reduction": F.lit(reduction)}))
    return union_all(traces)


def evaluate(
    scores: DataFrame, keys: Sequence[str] = (), fphr: float = 5.7, tpr: float = 0.8, epochs_per_hour: float = 60.0
) -> DataFrame:
    """Area under the curve and the two operating points, per group of `keys`."""
    counts = detection.score_counts(scores, keys)
    curve = detection.curve_of(counts, keys)
    area = detection.area_of(counts, keys)
    hits = detection.tpr_at_fphr(curve, fphr, keys, epochs_per_hour).withColumnRenamed("tpr", "tpr57")
    alarms = detection.fphr_at_tpr(curve, tpr, keys, epochs_per_hour).withColumnRenamed("fphr", "fphr80")
    if keys:
        return join_on(join_on(area, hits, keys, "left"), alarms, keys, "left")
    return area.withColumns({"tpr57": hits.scalar(), "fphr80": alarms.scalar()})


def clinician_scores(
    counts: DataFrame,
    seizures: DataFrame,
    recordings: DataFrame,
    epoch_s: int,
    target: str = "seizure",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Scores of the human baseline: 1 where any reviewer marks a second.

    The truth is widened to epochs here and once more when the targets are taken.
    """
    marked = counts.select(
        *keys, F.col("sec").alias("idx"), F.when(F.col("n") > 0, F.lit(1.0)).otherwise(0.0).alias("value")
    )
    last = recordings.select(
        *keys, F.col("start_s").cast("double"), (F.col("start_s") + F.col("duration_s") - 1).alias("stop_s")
    )
    truth = intervals.epochize(seizures, last, epoch_s, keys)
    return detection.TARGETS[target](marked, truth, recordings, epoch_s, 1, keys=keys)


def epoch_samples(
    signal: DataFrame,
    seizures: DataFrame,
    artifacts: DataFrame,
    recordings: DataFrame,
    epoch_s: int,
    min_snippets: int,
    snippet_s: int = 1,
    keys: Sequence[str] = KEYS,
    block_s: float = intervals.BLOCK_S,
) -> DataFrame:
    """Signal values inside seizures against those in the control stretches.

    Controls lie outside the *epochised* seizures and artifacts, the seizure mask uses the
    raw intervals, which must be disjoint. Recordings without enough present seizure values are left out.
    """
    ends = recordings.select(
        *keys,
        F.col("start_s").cast("double"),
        (F.col("start_s") + F.col("duration_s") - snippet_s).alias("stop_s"),
    )
    pieces = (intervals.epoch_pieces(seizures, ends, epoch_s, keys), intervals.epoch_pieces(artifacts, ends, epoch_s, keys))
    busy = cut_lineage(intervals.merge_sets(*pieces, keys))
    whole = recordings.select(*keys, F.lit(0.0).alias("start_s"), F.col("duration_s").alias("stop_s"))
    seizing = seizures.select(*keys).distinct()
    free = intervals.invert(busy, join_on(whole, seizing, keys, "left_semi"), keys)
    timed = join_on(signal, recordings.select(*keys, "start_s"), keys)
    timed = timed.withColumn("t", F.col("start_s") + F.col("idx") * float(snippet_s)).drop("start_s")
    marked = mark_covered(timed, intervals.shifted(free), "_control", keys, "t", block_s, disjoint=True)
    marked = mark_covered(marked, intervals.shifted(seizures), "is_seizure", keys, "t", block_s, disjoint=True)
    used = marked.filter(F.col("_control") | F.col("is_seizure")).drop("t")
    # a sample in both stretches would belong to both sides
    both = used.filter(F.col("_control") & F.col("is_seizure")).withColumn("is_seizure", F.lit(False))
    samples = cut_lineage(used.unionByName(both).drop("_control").filter(F.col("value").isNotNull()))
    channels = signal.groupBy(*keys).agg(F.count_distinct("channel").alias("_channels"))
    support = samples.groupBy(*keys).agg(
        F.count_if("is_seizure").alias("_present"), F.count_if(~F.col("is_seizure")).alias("_controls")
    )
    enough = join_on(support, channels, keys).filter(
        (F.col("_present") >= F.col("_channels") * min_snippets) & (F.col("_controls") > 0)
    )
    return join_on(samples, enough.select(*keys), keys, "left_semi")


def epoch_differences(samples: DataFrame, keys: Sequence[str] = KEYS, points: int = statistics.GRID_POINTS) -> DataFrame:
    """JS distance, KS p-value and shifts of mean and spread per recording and channel."""
    groups = [*keys, "channel"]
    js = statistics.js_distance(samples, groups, points=points)
    ks = statistics.kolmogorov_smirnov(samples, groups).select(*groups, "p")
    shifts = statistics.deltas(samples, groups)
    return join_on(join_on(js, ks, groups), shifts, groups)
