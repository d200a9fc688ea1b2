"""Filters: gains, block borders, and a direct recursion as reference."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import dsp

FS = 64.0


def gain(h, freq, fs):
    return abs(np.sum(h * np.exp(-2j * np.pi * freq / fs * np.arange(len(h)))))


@pytest.mark.parametrize(
    "spec,freq,want",
    [
        ((5, "lowpass", (0.32,), 256.0), 0.32, 2**-0.5),
        ((2, "bandpass", (0.1, 70.0), 256.0), 0.1, 2**-0.5),
        ((2, "bandpass", (0.1, 70.0), 256.0), 70.0, 2**-0.5),
        ((6, "bandstop", (45.0, 55.0), 256.0), 55.0, 2**-0.5),
        ((6, "bandstop", (45.0, 55.0), 256.0), 50.0, 0.0),
        ((6, "bandstop", (45.0, 55.0), 256.0), 3.0, 1.0),
    ],
)
def test_gains(spec, freq, want):
    assert gain(dsp.impulse_response(*spec), freq, spec[3]) == pytest.approx(want, abs=1e-6)


def direct(zeros, poles, k, x):
    """Transposed direct form of the whole filter."""
    b, a = np.real(np.poly(zeros)) * k, np.real(np.poly(poles))
    state, out = np.zeros(len(a)), []
    for v in x:
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def test_impulse_response_equals_recursion():
    x = np.random.default_rng(0).normal(size=400)
    for order, kind, edges in ((3, "lowpass", (5.0,)), (2, "bandpass", (2.0, 9.0)), (2, "bandstop", (10.0, 14.0))):
        want = direct(*dsp.butterworth(order, kind, edges, FS), x)
        got = dsp.causal(x, dsp.impulse_response(order, kind, edges, FS))
        np.testing.assert_allclose(got, want, atol=1e-9)


def recording(spark, n=4000):
    rng = np.random.default_rng(1)
    t = np.arange(n) / FS
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 20 * t) + rng.normal(size=n) * 0.1 + 3
    df = spark.createDataFrame([(0, "a", i, float(v)) for i, v in enumerate(x)], "patient_num int, channel string, idx bigint, value double")
    return df, x


def trace(df):
    return np.array([r.value for r in df.orderBy("idx").collect()])


def test_cleaning_in_blocks_equals_one_block(spark):
    df, _ = recording(spark)
    options = dict(low=1.0, high=25.0, mains_hz=20.0, mains_bandwidth=4.0)
    whole = trace(dsp.clean_channels(df, FS, block_len=100_000, **options))
    parts = trace(dsp.clean_channels(df, FS, block_len=700, **options))
    np.testing.assert_allclose(parts, whole, atol=1e-7)
    assert whole.std(ddof=1) == pytest.approx(1)
    spectrum = np.abs(np.fft.rfft(whole))
    at = lambda f: spectrum[int(round(f * len(whole) / FS))]
    assert at(5) > 100 * at(20)


def test_envelope_in_blocks_equals_one_block(spark):
    df, x = recording(spark)
    whole = trace(dsp.envelope(df, FS, block_len=100_000))
    parts = trace(dsp.envelope(df, FS, block_len=600))
    np.testing.assert_allclose(parts, whole, atol=1e-9)
    want = dsp.causal(np.abs(dsp.causal(x, dsp.fir_bandpass(50, 2, 20, FS))), dsp.impulse_response(5, "lowpass", (0.32,), FS))
    np.testing.assert_allclose(whole, want, atol=1e-9)


def test_fir_in_blocks(spark):
    df, x = recording(spark, 500)
    taps = dsp.fir_bandpass(50, 2, 20, FS)
    np.testing.assert_allclose(trace(dsp.fir(df, taps, block_len=64)), np.convolve(x, taps)[:500], atol=1e-9)


@pytest.mark.parametrize("block_len", [100, 200, 500, 4000])
def test_missing_samples_spoil_what_they_reach(spark, block_len):
    df, x = recording(spark, 3000)
    plain = trace(dsp.envelope(df, FS, envelope_freq=5.0, block_len=block_len))
    reach = len(dsp.impulse_response(5, "lowpass", (5.0,), FS)) + 50
    null = df.withColumn("value", F.when(F.col("idx") != 1900, F.col("value")))
    for holed in (null, df.filter("idx <> 1900")):
        got = [r.value for r in dsp.envelope(holed, FS, envelope_freq=5.0, block_len=block_len).orderBy("idx").collect()]
        assert [i for i, v in enumerate(got) if v is None] == list(range(1900, min(3000, 1900 + reach + 1)))
        np.testing.assert_allclose(got[:1900], plain[:1900], atol=1e-9)


def test_fir_with_absent_rows(spark):
    df, x = recording(spark, 400)
    taps = dsp.fir_bandpass(50, 2, 20, FS)
    got = [r.value for r in dsp.fir(df.filter("idx NOT IN (100, 101)"), taps, block_len=64).orderBy("idx").collect()]
    want = np.convolve(x, taps)[:400]
    for i, v in enumerate(got):
        assert v is None if 100 <= i <= 150 else v == pytest.approx(want[i], abs=1e-9)
