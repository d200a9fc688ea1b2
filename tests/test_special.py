"""Tail functions against the C library and a directly summed series."""

from __future__ import annotations

import math

import pytest

from tracemill.functions.special import kolmogorov_tail, two_sided_normal


def test_tails(spark):
    points = [0.05 + 0.13 * i for i in range(40)]
    rows = spark.createDataFrame([(x,) for x in points], "x double").select("x", two_sided_normal("x").alias("z"), kolmogorov_tail("x").alias("k"))
    for r in rows.collect():
        assert r.z == pytest.approx(math.erfc(r.x / math.sqrt(2)), rel=1e-9, abs=1e-14)
        if r.x > 0.3:
            series = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * r.x * r.x) for j in range(1, 200))
            assert r.k == pytest.approx(series, abs=1e-9)


def test_long_numbers_stay_whole(spark):
    from tracemill.functions.scalar import file_id

    rows = spark.createDataFrame([(7,), (100,), (1000,), (1001,)], "n int").select(file_id("n").alias("f")).collect()
    assert [r.f for r in rows] == ["EEG007", "EEG100", "EEG1000", "EEG1001"]
