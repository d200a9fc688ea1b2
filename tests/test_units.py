"""Hand-computed cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import scalar
from tracemill.operators import annotations, detection, intervals, signal, standardize, statistics, tables
from tracemill.operators.dsp import margins
from tracemill.operators.rolling import rolling


def series(spark, values, patient=0, channel="a"):
    data = [(patient, channel, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "patient_num int, channel string, idx bigint, value double")


def spans(spark, pairs, patient=0):
    data = [(patient, float(a), float(b)) for a, b in pairs]
    return spark.createDataFrame(data, "patient_num int, on_s double, off_s double")


def ends(spark, start, stop):
    return spark.createDataFrame([(0, float(start), float(stop))], "patient_num int, start_s double, stop_s double")


def pairs(df):
    return sorted((r.on_s, r.off_s) for r in df.collect())


def values(df, column="value", by="idx"):
    return [r[column] for r in df.orderBy(by).collect()]


def test_runs(spark):
    flags = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate([0, 1, 1, 0, 1])], "patient_num int, idx int, flag boolean")
    assert pairs(intervals.runs(flags)) == [(2, 4), (5, 5)]
    assert pairs(intervals.runs(flags, one_based=False)) == [(1, 3), (4, 5)]


def test_collapse_ends_at_latest_start(spark):
    nested = spans(spark, [(1, 10), (2, 5), (7, 9)])
    assert pairs(intervals.collapse(nested)) == [(1, 5), (7, 9)]
    assert pairs(intervals.collapse(nested, strict=True)) == [(1, 10)]
    assert pairs(intervals.merge(nested)) == [(1, 10)]
    assert pairs(intervals.collapse(spans(spark, [(0, 2), (2, 4)]))) == [(0, 4)]


def test_buffer(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 5.0)], "s double, d double")
    found = df.select(intervals.buffered(F.col("s"), F.col("d")).alias("b")).select("b.*")
    assert pairs(found) == [(9, 11), (9, 16)]


def test_invert(spark):
    two = spans(spark, [(2, 4), (6, 8)])
    assert pairs(intervals.invert(two, ends(spark, 0, 10))) == [(0, 2), (4, 6), (8, 10)]
    assert pairs(intervals.invert(two, ends(spark, 2, 10))) == [(4, 6), (8, 10)]
    assert pairs(intervals.invert(spans(spark, []), ends(spark, 0, 10))) == [(0, 10)]


def test_restrict(spark):
    lo, hi = F.lit(10.0), F.lit(20.0)
    assert pairs(intervals.restrict(spans(spark, [(0, 100)]), lo, hi)) == []
    assert pairs(intervals.restrict(spans(spark, [(5, 15)]), lo, hi)) == [(10, 15)]
    assert pairs(intervals.restrict(spans(spark, [(0, 100)]), lo, hi, strict=True)) == [(10, 20)]


def grid(spark, n, bin_s=60):
    return spark.createDataFrame([(0, 0.0, n)], "patient_num int, first_s double, n_bins bigint")


def test_containing_bins(spark):
    def bins(on, off):
        found = intervals.containing_bins(spans(spark, [(on, off)]), grid(spark, 4), 60)
        return [r.bin for r in intervals.bin_rows(found).orderBy("bin").collect()]

    assert bins(60, 120) == [1]
    assert bins(180, 200) == []
    assert bins(-5, 30) == [0]
    assert bins(70, 500) == [1, 2, 3]
    with pytest.raises(PySparkException):
        bins(60, 60)


def test_negative_hours(spark):
    hours = detection.negative_hours(spans(spark, [(60, 120)]), grid(spark, 10), 60)
    assert hours.first().non_seizure_hours == pytest.approx(0.15)


def test_snippet_starts_include_the_end(spark):
    assert [r.start_s for r in intervals.snippet_starts(spans(spark, [(0, 3)]), 1.5).orderBy("start_s").collect()] == [0, 1.5, 3]


def test_coarse_grain_and_poison(spark):
    assert values(signal.coarse_grain(series(spark, [1.0, 2.0, None, 4.0, 5.0]), 2), by="bin") == [2, None, 5]
    poisoned = signal.poison_blocks(series(spark, [1.0, None, 3.0, 4.0, 5.0]), 2)
    assert values(poisoned) == [None, None, 3, 4, 5]
    assert values(signal.block_mean(series(spark, [1.0, 3.0, 5.0]), 2), by="bin") == [2]


def test_rolling_mean(spark):
    assert values(rolling(series(spark, [1.0, 2.0, 3.0, None, 5.0]), 2)) == [None, 1.5, 2.5, None, None]


def test_standardize(spark):
    assert values(standardize.standardize(series(spark, [1.0, 2.0, 3.0]), "within")) == [-1, 0, 1]
    with pytest.raises(ValueError):
        standardize.standardize(series(spark, [1.0]), "sideways")
    with pytest.raises(ValueError):
        standardize.standardize_one(series(spark, [1.0]), "across")
    with pytest.raises(ValueError):
        standardize.standardize_with(series(spark, [1.0]), F.lit(1.0), None)
    with pytest.raises(KeyError):
        standardize.reduce_channels(series(spark, [1.0]), "sum")


def test_parse_grade(spark):
    df = spark.createDataFrame([("Grade II",), ("grade 2",), ("grade 1",)], "text string")
    assert [r[0] for r in df.select(scalar.parse_grade("text")).collect()] == [1, 2, 1]
    assert [r[0] for r in df.select(scalar.parse_grade("text", strict=True)).collect()] == [2, 2, 1]
    bad = spark.createDataFrame([("worst",)], "text string")
    with pytest.raises(PySparkException):
        bad.select(scalar.parse_grade("text")).collect()


def test_note_times(spark):
    df = spark.createDataFrame([("d1 10:00:30", "5 sec"), ("d2 10:00:30", "5 min")], "t string, d string")
    good = df.limit(1).select(scalar.parse_start("t", F.lit("09:59:00")), scalar.parse_duration("d")).first()
    assert tuple(good) == (90.0, 5)
    for column in (scalar.parse_start("t", F.lit("09:59:00")), scalar.parse_duration("d")):
        with pytest.raises(PySparkException):
            df.select(column).collect()


def test_numerals_and_digits(spark):
    names = spark.createDataFrame([(1,), (2,), (5,), (14,)], "n int").select(scalar.motif_name("n").alias("m"))
    assert [r.m for r in names.collect()] == ["0", "I", "IV", "XIII"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(5000,)], "n int").select(scalar.roman("n")).collect()
    with pytest.raises(PySparkException):
        spark.createDataFrame([(0,)], "n int").select(scalar.roman("n", zero=None)).collect()
    df = spark.createDataFrame([(0.12345,), (1234.0,), (0.0,), (-9.96,)], "v double")
    assert [r[0] for r in df.select(scalar.sigdigits("v")).collect()] == [0.12, 1200.0, 0.0, -10.0]


def test_significance(spark):
    df = spark.createDataFrame([(0.02,), (0.2,), (0.005,), (0.0005,), (0.00005,)], "p double")
    got = [r[0] for r in df.select(scalar.significance("p", 1)).collect()]
    assert got == ["* 0.05/1", "NS", "** 0.01/1", "*** 0.001/1", "**** 0.0001/1"]


def test_trapezoid_area(spark):
    data = [(0, 3.0, 1, 2, 0, 2), (0, 2.0, 2, 2, 1, 2), (0, 1.0, 2, 2, 2, 2)]
    names = "patient_num int, theta double, true_positives bigint, gt_positive bigint, false_positives bigint, gt_negative bigint"
    assert detection.auc_trapezoid(spark.createDataFrame(data, names)).first().auc == pytest.approx(0.875)


def test_margins(spark):
    found = margins(series(spark, [float(v) for v in range(100, 0, -1)]), 100).first()
    assert (found.lower, found.upper) == (9, 93)
    assert margins(series(spark, [1.0, 2.0]), 2).first().lower is None


def test_keywords(spark):
    data = [(0, 10.0, 5.0, ["EPIleptic"]), (0, 30.0, None, ["Seizure?"]), (0, 50.0, 1.0, ["eye"]), (0, 60.0, 0.0, [""])]
    events = spark.createDataFrame(data, "patient_num int, onset_s double, duration_s double, annotations array<string>")
    assert annotations.relevant(events).count() == 3
    assert pairs(annotations.keyword_intervals(events)) == [(10, 15), (29, 31)]
    assert pairs(annotations.keyword_intervals(events, ())) == []


def test_kde_identical_samples_have_no_distance(spark):
    data = [(0, float(v), case) for v in range(50) for case in (True, False)]
    samples = spark.createDataFrame(data, "patient_num int, value double, is_seizure boolean")
    assert statistics.js_distance(samples, ["patient_num"]).first().js == pytest.approx(0, abs=1e-6)
    dens = statistics.kernel_densities(samples, ["patient_num"]).toPandas()
    one = dens[dens.is_seizure]
    assert (one.density.sum() * (one.x.max() - one.x.min()) / (len(one) - 1)) == pytest.approx(1, abs=1e-6)


def test_weights(spark):
    data = [(1, 0.5, -1.0), (2, 0.01, 2.0), (3, 0.02, -3.0)]
    effects = spark.createDataFrame(data, "class int, p double, d_mu double")
    got = values(statistics.class_weights(effects, 2), "weight", "class")
    assert got == pytest.approx([0, 2**-0.5, -(2**-0.5)])
    assert values(statistics.first_class_weights(effects), "weight", "class") == [-1, 0, 0]


def test_union_of_nothing(spark):
    with pytest.raises(ValueError):
        tables.union_all([None])


def test_snip(spark):
    samples = series(spark, [float(i) for i in range(20)])
    recordings = spark.createDataFrame([(0, 2, 0.0, 10.0)], "patient_num int, sample_rate int, start_s double, duration_s double")
    counts = spark.createDataFrame([(0, i, 0) for i in range(10)], "patient_num int, sec int, n int")
    cut = signal.snip(samples, spans(spark, [(1, 4), (6, 9)]), counts, recordings, 3, 50)
    assert values(cut["samples"]) == [float(i) for i in range(6, 20)]
    assert pairs(cut["intervals"]) == [(3, 4), (6, 9)]
    assert cut["reviewer_counts"].count() == 7
    assert tuple(cut["recordings"].select("start_s", "duration_s").first()) == (3.0, 7.0)
    with pytest.raises(ValueError):
        signal.snip(samples, spans(spark, []), counts, recordings, 3.5, 5)


def test_widened_snip_keeps_published_right_edge(spark):
    timed = series(spark, [float(i) for i in range(40)]).withColumn("t", F.col("idx").cast("double"))
    found = signal.widen_and_snip(timed, spans(spark, [(10, 14)]), 10).agg(F.min("t"), F.max("t")).first()
    # left edge 10 - 3; right edge 14 + (10 - (14 - 7))
    assert tuple(found) == (7.0, 17.0)


def test_distance_reduction(spark):
    data = [(0, "a", 0, 1.0), (0, "b", 0, 0.0), (0, "a", 1, 3.0), (0, "b", 1, None), (0, "a", 2, 2.0), (0, "b", 2, 4.0)]
    both = spark.createDataFrame(data, "patient_num int, channel string, idx bigint, value double")
    # sums 6 and 4 over two complete steps
    got = values(standardize.reduce_channels(both, "distance"))
    assert got[1] is None
    assert got[0] == pytest.approx((4 + 4) ** 0.5) and got[2] == pytest.approx((1 + 4) ** 0.5)
