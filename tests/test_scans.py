"""Block-wise operators against plain Python, across block borders."""

from __future__ import annotations

import random
import statistics as stats

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import detection, intervals, statistics
from tracemill.operators.rolling import moving_average, rolling
from tracemill.operators.scan import running, value_blocks
from tracemill.operators.tables import sample_per_key

KEYS = 40


def random_spans(seed, largest=60):
    rng = random.Random(seed)
    out = {}
    for key in range(KEYS):
        spans = []
        for _ in range(rng.randrange(0, 30)):
            on = rng.randrange(0, largest)
            spans.append((float(on), float(on + rng.randrange(0, 9))))
        out[key] = spans
    return out


def table(spark, spans):
    data = [(k, a, b) for k, pairs in spans.items() for a, b in pairs]
    return spark.createDataFrame(data, "patient_num int, on_s double, off_s double").repartition(5)


def by_key(df):
    out = {k: [] for k in range(KEYS)}
    for r in df.collect():
        out[r.patient_num].append((r.on_s, r.off_s))
    return {k: sorted(v) for k, v in out.items()}


def fold(spans, end):
    out = []
    for on, off in sorted(spans):
        if out and on <= out[-1][1]:
            out[-1] = (out[-1][0], end(out[-1][1], off))
        else:
            out.append((on, off))
    return out


def test_collapse_and_merge_equal_the_folds(spark, many_blocks):
    spans = random_spans(1)
    df = table(spark, spans)
    assert by_key(intervals.collapse(df)) == {k: fold(v, lambda _, new: new) for k, v in spans.items()}
    merged = intervals.merge(df)
    want = {k: fold(v, max) for k, v in spans.items()}
    assert by_key(merged) == want
    assert by_key(intervals.merge(merged)) == want


def test_invert_twice(spark, many_blocks):
    spans = {k: [(a, b) for a, b in fold(v, max) if b > a] for k, v in random_spans(2).items()}
    ends = spark.createDataFrame([(k, -1.0, 100.0) for k in range(KEYS)], "patient_num int, start_s double, stop_s double")
    gaps = intervals.invert(table(spark, spans), ends)
    for k, got in by_key(gaps).items():
        edges = [-1.0, *(x for pair in spans[k] for x in pair), 100.0]
        assert got == [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
    assert by_key(intervals.invert(gaps, ends)) == spans


def test_runs_across_blocks(spark, many_blocks):
    rng = random.Random(3)
    flags = {k: [rng.random() < 0.6 for _ in range(rng.randrange(1, 40))] for k in range(KEYS)}
    data = [(k, i, f) for k, v in flags.items() for i, f in enumerate(v)]
    df = spark.createDataFrame(data, "patient_num int, idx int, flag boolean")
    got = by_key(intervals.runs(df, block_len=4))
    for k, v in flags.items():
        padded = [False, *v, False]
        ons = [i for i in range(1, len(padded)) if padded[i] and not padded[i - 1]]
        offs = [i for i in range(1, len(padded)) if not padded[i] and padded[i - 1]]
        assert got[k] == [(float(a), float(min(b, len(v)))) for a, b in zip(ons, offs)]


@pytest.mark.parametrize("method", ["sliding", "tiled"])
@pytest.mark.parametrize("k,stat", [(1, "mean"), (3, "mean"), (5, "std"), (4, "max"), (4, "min"), (7, "sum"), (16, "std")])
def test_rolling(spark, method, k, stat):
    rng = random.Random(4)
    values = {p: [None if rng.random() < 0.05 else rng.gauss(5, 2) for _ in range(70)] for p in range(6)}
    data = [(p, "a", i, v) for p, vs in values.items() for i, v in enumerate(vs) if not (p == 0 and i == 33)]
    df = spark.createDataFrame(data, "patient_num int, channel string, idx bigint, value double")
    found = rolling(df, k, stat, block_len=16, method=method)
    got = {(r.patient_num, r.idx): r.value for r in found.collect()}
    assert len(got) == len(data)
    of = {"mean": stats.fmean, "std": stats.stdev, "max": max, "min": min, "sum": sum}[stat]
    for p, i in got:
        window = values[p][i - k + 1 : i + 1] if i >= k - 1 else []
        broken = len(window) < k or None in window or (p == 0 and i - k < 33 <= i)
        assert got[p, i] == (None if broken else pytest.approx(of(window)))


def test_moving_average_variants(spark):
    data = [(0, "a", i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])]
    df = spark.createDataFrame(data, "patient_num int, channel string, idx bigint, value double")
    plain = [r.value for r in moving_average(df, 2).orderBy("idx").collect()]
    skipped = [r.value for r in moving_average(df, 2, skip_missing=True).orderBy("idx").collect()]
    assert plain == [None, None, 4.0] and skipped == [1.0, 3.0, 4.0]


def test_running_kinds(spark, many_blocks):
    rng = random.Random(5)
    data = [(k % 3, i, rng.choice([None, rng.random()])) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(data, "k int, i int, v double")
    outs = {n: (n, F.col("v")) for n in ("sum", "max", "min", "last")}
    blocks = value_blocks(df, ["k"], "i")
    assert blocks.select("_block").distinct().count() > 3
    for inclusive in (True, False):
        found = running(blocks, ["k"], "_block", ["i"], outs, inclusive)
        for r in found.collect():
            seen = [v for k, i, v in data if k == r.k and (i <= r.i if inclusive else i < r.i) and v is not None]
            assert r.sum == pytest.approx(sum(seen))
            assert (r.max, r.min, r.last) == ((max(seen), min(seen), seen[-1]) if seen else (None, None, None))


def scores(seed, ties):
    rng = random.Random(seed)
    draw = (lambda: float(rng.randrange(12))) if ties else rng.random
    return [(draw(), rng.random() < 0.4) for _ in range(300)]


@pytest.mark.parametrize("ties", [True, False])
def test_curves_and_areas(spark, many_blocks, ties):
    data = scores(6, ties)
    df = spark.createDataFrame([(0, *d) for d in data], "patient_num int, score double, is_target boolean")
    tar, non = [s for s, t in data if t], [s for s, t in data if not t]
    area = sum((a > b) + (a == b) / 2 for a in tar for b in non) / len(tar) / len(non)
    assert detection.auc(df).first().auc == pytest.approx(area)
    curve = {r.theta: (r.pfa, r.pmiss) for r in detection.roc(df).collect()}
    assert curve.pop(None) == (1.0, 0.0)
    for theta, (pfa, pmiss) in curve.items():
        assert pfa == pytest.approx(sum(s > theta for s in non) / len(non))
        assert pmiss == pytest.approx(sum(s <= theta for s in tar) / len(tar))
    sweep = detection.roc_sweep(df, 50)
    for r in sweep.collect():
        assert r.true_positives == sum(s >= r.theta for s in tar)
        assert r.false_positives == sum(s >= r.theta for s in non)
    if ties:
        # with a threshold between any two scores the two areas agree
        assert detection.auc_trapezoid(sweep).first().auc == pytest.approx(area)


def test_quantiles_and_ranks(spark, many_blocks):
    rng = np.random.default_rng(7)
    data = [(k, float(v), bool(c)) for k in range(3) for v, c in zip(rng.integers(0, 30, 101), rng.random(101) < 0.3)]
    df = spark.createDataFrame(data, "patient_num int, value double, is_seizure boolean")
    shares = [0.0, 0.09, 0.5, 0.93, 1.0]
    for r in statistics.quantiles(df, ["patient_num"], shares).collect():
        mine = [v for k, v, _ in data if k == r.patient_num]
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(mine, shares)))
    whole = statistics.quantiles(df, [], shares).first()
    assert list(whole) == pytest.approx(list(np.quantile([v for _, v, _ in data], shares)))
    for r in statistics.kolmogorov_smirnov(df, ["patient_num"]).collect():
        a = np.array([v for k, v, c in data if k == r.patient_num and c])
        b = np.array([v for k, v, c in data if k == r.patient_num and not c])
        assert r.d == pytest.approx(max(abs((a <= x).mean() - (b <= x).mean()) for x in range(30)))
    for r in statistics.mann_whitney(df, ["patient_num"]).collect():
        a = [v for k, v, c in data if k == r.patient_num and c]
        b = [v for k, v, c in data if k == r.patient_num and not c]
        assert r.u == pytest.approx(sum((x > y) + (x == y) / 2 for x in a for y in b))


def test_sampling(spark):
    data = [(k, i) for k in range(3) for i in range(200 if k else 3)]
    df = spark.createDataFrame(data, "k int, i int")
    first = sample_per_key(df, 10, ["k"], ["k", "i"], seed=1)
    rows = {tuple(r) for r in first.collect()}
    assert {k: sum(a == k for a, _ in rows) for k in range(3)} == {0: 3, 1: 10, 2: 10}
    assert rows == {tuple(r) for r in sample_per_key(df.repartition(7), 10, ["k"], ["k", "i"], seed=1).collect()}
    assert rows != {tuple(r) for r in sample_per_key(df, 10, ["k"], ["k", "i"], seed=2).collect()}
