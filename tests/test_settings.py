"""Settings as keys of one table: excluded grades, sets of recordings, pooled moments."""

from __future__ import annotations

import statistics as stats

import pytest
from pyspark.sql import functions as F

from tracemill.operators.standardize import standardize
from tracemill.plans.detector import mask_grades, setting_traces

SIGNAL = "signal string, patient_num int, channel string, idx bigint, value double"


def cells(patients, steps=8, signal="s"):
    return [(signal, p, c, i, float((7 * i + 3 * (p or 0) + ord(c)) % 11)) for p in patients for c in "ab" for i in range(steps)]


def test_grades_are_masked_per_set(spark):
    signal = spark.createDataFrame(cells([1, None]), SIGNAL)
    artifacts = spark.createDataFrame(
        [(1, 1, 2.0, 4.0), (2, 1, 3.0, 6.0), (2, None, 0.0, 1.0), (3, 1, 0.0, 9.0)], "grade int, patient_num int, on_s double, off_s double"
    )
    found = mask_grades(signal, artifacts, [(), (1,), (2, 1)])
    missing = {}
    for r in found.collect():
        missing.setdefault((r.excluded_artifact_grades, r.patient_num), set())
        if r.value is None:
            missing[r.excluded_artifact_grades, r.patient_num].add(r.idx)
    # grade 3 is in no set, so nobody loses anything to it
    assert missing == {
        ("", 1): set(), ("", None): set(), ("1", 1): {2, 3}, ("1", None): set(), ("1,2", 1): {2, 3, 4, 5}, ("1,2", None): {0},
    }
    assert found.count() == 3 * signal.count()


def test_no_grades_and_no_artifacts_change_nothing(spark):
    signal = spark.createDataFrame(cells([1]), SIGNAL)
    none = spark.createDataFrame([], "grade int, patient_num int, on_s double, off_s double")
    for sets in ([()], [(1,)]):
        found = mask_grades(signal, none, sets).select(*signal.columns)
        assert sorted(found.collect()) == sorted(signal.collect())


def test_pooled_moments_stay_inside_the_pool(spark):
    rows = [("x", 1, "a", 0, 1.0), ("x", 2, "a", 0, 3.0), ("y", 1, "a", 0, 10.0), ("y", 2, "a", 0, 30.0)]
    signal = spark.createDataFrame(rows, SIGNAL)
    found = {(r.signal, r.patient_num): r.value for r in standardize(signal, "across", ("signal", "patient_num"), pool=("signal",)).collect()}
    for name, low, high in (("x", 1.0, 3.0), ("y", 10.0, 30.0)):
        spread = stats.stdev([low, high])
        assert found[name, 1] == pytest.approx((low - (low + high) / 2) / spread)
        assert found[name, 2] == pytest.approx((high - (low + high) / 2) / spread)


def test_traces_of_each_setting_against_plain_python(spark):
    patients, window = [1, 2, 3], 3
    rows = cells(patients, signal="tricorr") + cells(patients, signal="aEEG")
    signal = spark.createDataFrame(rows, SIGNAL).withColumn("excluded_artifact_grades", F.lit(""))
    sets = {"all": [1, 2, 3], "odd": [1, 3]}
    members = spark.createDataFrame([(p, name) for name, ps in sets.items() for p in ps], "patient_num int, patient_set string")
    reductions = {"tricorr": "maxanyabs", "aEEG": "maxany"}
    found = {
        (r.signal, r.standardization, r.patient_set, r.patient_num, r.idx): r.value
        for r in setting_traces(signal, members, reductions, window).collect()
    }
    value = {r[:4]: r[4] for r in rows}
    rolled = {(s, p, c, i): stats.fmean(value[s, p, c, i - k] for k in range(window)) for (s, p, c, i) in value if i >= window - 1}
    expected = {}
    for name, ps in sets.items():
        for (s, p, _, i), how in ((key, how) for key in value for how in ("within", "across") if key[1] in ps):
            scores = []
            for c in "ab":
                pool = [v for (s2, p2, c2, _), v in rolled.items() if s2 == s and c2 == c and p2 in (ps if how == "across" else [p])]
                if (s, p, c, i) in rolled:
                    z = (rolled[s, p, c, i] - stats.fmean(pool)) / stats.stdev(pool)
                    scores.append(abs(z) if s == "tricorr" else z)
            expected[s, how, name, p, i] = pytest.approx(max(scores)) if scores else None
    assert found == expected
