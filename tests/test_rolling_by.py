"""Windows by functions of their values, windows in seconds, and merged settings."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracemill.operators import rolling
from tracemill.plans import params


@pytest.mark.parametrize("block_len", [None, 5, 16])
def test_medians_and_quantiles(spark, block_len):
    rng = random.Random(4)
    data = [(k, "a", i, None if i in (7, 30) else rng.gauss(0, 1)) for k in (1, None) for i in range(60) if i != 45]
    df = spark.createDataFrame(data, "patient_num int, channel string, idx long, value double").repartition(3)
    value = {(k, i): v for k, _, i, v in data}
    got = {(r.patient_num, r.idx): r.value for r in rolling.rolling_by(df, 5, rolling.median, block_len=block_len).collect()}
    assert set(got) == set(value)
    for (k, i), v in got.items():
        window = [value.get((k, j)) for j in range(i - 4, i + 1)]
        assert v == (None if None in window else pytest.approx(statistics.median(window)))


def test_any_function_and_seconds(spark):
    df = spark.range(20).selectExpr("1 AS patient_num", "'a' AS channel", "id AS idx", "double(id * id) AS value")
    rise = lambda values: F.element_at(values, -1) - F.element_at(values, 1)
    got = [r.value for r in rolling.rolling_seconds(df, 60, 15, rise).orderBy("idx").collect()]
    assert got == [None] * 3 + [float(i * i - (i - 3) ** 2) for i in range(3, 20)]
    named = [r.value for r in rolling.rolling_seconds(df, 62.5, 15, "max").orderBy("idx").collect()]
    assert named == [None] * 3 + [float(i * i) for i in range(3, 20)]
    with pytest.raises(ValueError, match="no step"):
        rolling.rolling_seconds(df, 10, 15)


def test_later_settings_win():
    plain = params.merged("aEEG")
    assert plain["snippets_duration_s"] == 15 and plain["rolling_window_s"] == 60 and plain["signal_type"] == "aEEG"
    held = params.merged("tricorr", {"epoch_s": 30, "standardization": "across"}, {"epoch_s": 10})
    assert held["epoch_s"] == 10 and held["standardization"] == "across" and held["lag_extents"] == (8, 25)
    assert params.COMMON["epoch_s"] == 60
