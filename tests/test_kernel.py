"""Triple-correlation sums against the definition."""

from __future__ import annotations

import itertools

import brute
import numpy as np
import pytest

from tracemill.operators.surrogates import normal_cells, shuffled_cells
from tracemill.operators import tricorr_kernel as kernel


@pytest.mark.parametrize("boundary", ["periodic", "zeropad"])
@pytest.mark.parametrize("shape,lags", [((5, 9), (1, 2)), ((5, 9), (2, 3)), ((3, 4), (2, 3)), ((4, 5), (0, 1)), ((4, 5), (1, 0))])
def test_class_sums(shape, lags, boundary):
    x = np.random.default_rng(1).normal(0.3, 1.0, (2, *shape))
    want = np.stack([brute.class_sums(v, lags, boundary) for v in x])
    np.testing.assert_allclose(kernel.class_sums(x, lags, boundary), want, atol=1e-9)


def test_lag_classes_cover_all_motifs():
    reach = range(-2, 3)
    motifs = set()
    for n1, t1, n2, t2 in itertools.product(reach, repeat=4):
        got = int(kernel.lag_class(*(np.array(v) for v in (n1, t1, n2, t2))))
        assert got == brute.triple_class([(0, 0), (n1, t1), (n2, t2)])
        order = tuple(np.sign(v) for v in (n1, n2, n1 - n2, t1, t2, t1 - t2))
        motifs.add((order, got))
    assert len(motifs) == 169
    counts = [sum(1 for _, c in motifs if c == k) for k in range(14)]
    assert counts == [1, 6, 6, 6, 12, 12, 12, 12, 12, 12, 6, 18, 18, 36]


def test_normal_variance():
    x = np.random.default_rng(2).normal(size=(4000, 7, 11))
    ratio = kernel.class_sums(x, (1, 2)).var(axis=0) / (77 * kernel.normal_variance_per_cell((1, 2)))
    assert np.all(np.abs(ratio - 1) < 0.15)


@pytest.mark.parametrize("lag_channels", [False, True])
def test_lag_kernel_of_ones(lag_channels):
    out = kernel.pair_lag_sums(np.ones((1, 19, 101)), 7, 9, lag_channels)
    assert out.shape == (1, 19, 19)
    assert np.all(out == 15**2 * 5 * 83)


def test_surrogates_repeat_and_differ(spark):
    x = [[float(v) for v in np.random.default_rng(i).normal(size=24)] for i in range(2)]
    df = spark.createDataFrame([(1, 5, x[0]), (1, 6, x[1]), (None, 6, x[1])], "patient_num int, snippet long, cells array<double>")
    identity = ["patient_num", "snippet"]
    drawn = df.select("snippet", shuffled_cells("cells", identity, 2).alias("s"), normal_cells("cells", identity, 1).alias("n"))
    rows, again = drawn.collect(), drawn.repartition(3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for r, cells in zip(rows, [x[0], x[1], x[1]], strict=True):
        assert sorted(r.s[:24]) == sorted(r.s[24:]) == sorted(cells) and r.s[:24] != r.s[24:]
        assert len(r.n) == 24 and abs(np.mean(r.n)) < 1
    assert rows[1].s != rows[2].s


def test_noise_measures():
    x = np.random.default_rng(4).normal(size=(3, 5, 8))
    drawn = np.stack([np.random.default_rng(i).permuted(x.reshape(3, -1), axis=1).reshape(x.shape) for i in range(5)])
    z = kernel.PREPROCESS["zscore"](x)
    noise = sum(kernel.class_sums(kernel.PREPROCESS["zscore"](d), (1, 2)) for d in drawn) / 5
    got = kernel.contributions(x, drawn, "AN_znorm", (1, 2), "periodic")
    np.testing.assert_allclose(got, kernel.class_sums(z, (1, 2)) - noise)
    u = kernel.PREPROCESS["unit"](x)
    noise = sum(kernel.class_sums(kernel.PREPROCESS["unit"](d), (1, 2)) for d in drawn[:2]) / 2
    got = kernel.contributions(x, drawn[:2], "AN_01norm", (1, 2), "periodic")
    np.testing.assert_allclose(got, kernel.class_sums(u, (1, 2)) / noise - 1)


def test_marginals_are_sums_of_the_lag_box():
    x = np.random.default_rng(5).normal(size=(1, 4, 5))
    parts = kernel.marginal_sums(x, (1, 2))
    whole = kernel.class_sums(x, (1, 2), "zeropad").sum()
    for name, shape in (("time", (5, 5)), ("space", (3, 3)), ("space_time", (3, 5))):
        assert parts[name].shape == (1, *shape)
        assert parts[name].sum() == pytest.approx(whole)
