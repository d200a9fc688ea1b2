"""Snippets at given starts, and the exact rank-sum test, against plain calculations."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions.ranksum import two_sided
from tracemill.operators import signal, statistics


@pytest.mark.parametrize("stretch", [1, 16, 4096])
def test_snippets_overlap_and_cross_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(signal, "STRETCH", stretch)
    data = [(k, c, i, None if i == 33 else 100.0 * c + i) for k in (1, None) for c in (2, 10) for i in range(100) if i != 40 or c == 2]
    df = spark.createDataFrame(data, "patient_num int, channel int, idx long, value double")
    starts = [(1, 0, "a"), (1, 5, "a"), (1, 5, "b"), (1, 15, "a"), (1, 15, "a"), (None, 28, "a"), (1, 38, "c"), (1, 93, "a"), (1, 94, "a"), (1, -1, "a"), (7, 3, "a")]
    given = spark.createDataFrame(starts, "patient_num int, first long, kind string")
    got = {(r.patient_num, r.first, r.kind): r for r in signal.snippets_at(df, given, 7, identity=["kind"]).collect()}
    want = {(k, f, s) for k, f, s in starts if k != 7 and 0 <= f <= 93}
    assert set(got) == want
    value = {(k, c, i): v for k, c, i, v in data}
    for (k, f, _), r in got.items():
        assert (r.n_channels, r.length, r.snippet) == (2, 7, f)
        assert list(r.cells) == [value.get((k, c, f + j)) for c in (2, 10) for j in range(7)]


def test_no_starts_no_snippets(spark):
    df = spark.range(10).selectExpr("1 AS patient_num", "0 AS channel", "id AS idx", "double(id) AS value")
    none = spark.createDataFrame([], "patient_num int, first long")
    assert signal.snippets_at(df, none, 3).count() == 0
    assert signal.snippets_at(df.limit(0), df.select("patient_num", F.col("idx").alias("first")), 3).count() == 0


def enumerated(a, b):
    """Both tails of U over every way to call len(a) of the values the first sample."""
    every = a + b
    u = lambda x, y: sum((p > q) + (p == q) / 2 for p in x for q in y)
    seen, low, high, n = u(a, b), 0, 0, 0
    for chosen in itertools.combinations(range(len(every)), len(a)):
        first = [every[i] for i in chosen]
        other = [every[i] for i in range(len(every)) if i not in chosen]
        here = u(first, other)
        low, high, n = low + (here <= seen), high + (here >= seen), n + 1
    return min(1.0, 2 * min(low, high) / n)


def test_exact_p_is_that_of_all_choices(spark):
    rng = random.Random(2)
    cases = []
    for k in range(40):
        tied = k % 2
        draw = (lambda: float(rng.randint(0, 4))) if tied else rng.random
        cases.append(([draw() for _ in range(rng.randint(1, 5))], [draw() for _ in range(rng.randint(1, 5))]))
    rows = [(k, v, side == 0) for k, both in enumerate(cases) for side, values in enumerate(both) for v in values]
    df = spark.createDataFrame(rows, "patient_num int, value double, is_seizure boolean").repartition(3)
    found = {r.patient_num: r for r in statistics.mann_whitney(df, ["patient_num"]).collect()}
    assert set(found) == set(range(40))
    for k, (a, b) in enumerate(cases):
        assert found[k].exact and found[k].p == pytest.approx(enumerated(a, b), abs=1e-12)


def test_which_form_is_used(spark):
    def form(values):
        rows = [(0, float(v), i % 2 == 0) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "patient_num int, value double, is_seizure boolean")
        return statistics.mann_whitney(df, ["patient_num"]).first()

    assert form(range(50)).exact and not form(range(51)).exact
    assert form([*range(9), 3]).exact and not form([*range(10), 3]).exact
    assert form([1, 1, 1, 1]).p == 1.0


def test_counts_of_large_samples_stay_exact():
    from math import comb

    from tracemill.functions.ranksum import rank_sum_counts

    assert int(rank_sum_counts(25, (1,) * 50).sum()) == comb(50, 25)
    assert two_sided(0.0, 25, (1,) * 50) == pytest.approx(2 / comb(50, 25))
