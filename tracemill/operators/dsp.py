"""Filter design, cleaning and amplitude margins; filters run with NumPy, block by block.

Recursive filters carry their state from block to block (see `recursive`), FIR filters need a
halo of their length. Blocks of one channel are filtered in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.functions.nulls import join_on
from tracemill.functions.wide import by_channel, is_wide
from tracemill.operators import recursive, scan

KEYS = ("patient_num", "channel")
FADE = 1e-17


def fir_bandpass(taps: int, low: float, high: float, fs: float) -> np.ndarray:
    """Hamming-windowed band-pass of `taps` coefficients, unit gain at mid-band."""
    t = np.arange(taps) - (taps - 1) / 2
    w1, w2 = 2 * low / fs, 2 * high / fs
    h = (w2 * np.sinc(w2 * t) - w1 * np.sinc(w1 * t)) * np.hamming(taps)
    return h / np.sum(h * np.cos(np.pi * (w1 + w2) / 2 * t))


def _butterworth_poles(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def butterworth(order: int, kind: str, edges: tuple[float, ...], fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital Butterworth filter as zeros, poles and gain (bilinear, prewarped)."""
    warped = [4.0 * np.tan(np.pi * e / fs) for e in edges]
    poles = _butterworth_poles(order)
    if kind == "lowpass":
        p, z, gain = warped[0] * poles, np.array([]), warped[0] ** order
    elif kind in ("bandpass", "bandstop"):
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = width * poles / 2 if kind == "bandpass" else width / poles / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        p = np.concatenate([half + root, half - root])
        if kind == "bandpass":
            z, gain = np.zeros(order), width**order
        else:
            z, gain = np.tile([1j * centre, -1j * centre], order), 1.0
    else:
        raise ValueError(kind)
    z_digital = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    gain = gain * np.real(np.prod(4 - z + 0j) / np.prod(4 - p))
    return z_digital, (4 + p) / (4 - p), float(gain)


@lru_cache(maxsize=32)
def sections(order: int, kind: str, edges: tuple[float, ...], fs: float) -> tuple[recursive.Section, ...]:
    """The filter as second-order sections (b0, b1, b2, a1, a2), the gain in the first one.

    Conjugate poles share a section, real ones go two by two; so do the zeros.
    """
    zeros, poles, gain = butterworth(order, kind, edges, fs)
    upper = sorted((p for p in poles if p.imag >= 1e-12), key=abs)
    real = sorted(p.real for p in poles if abs(p.imag) < 1e-12)
    bottoms = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in upper]
    bottoms += [np.real(np.poly(real[i : i + 2])) for i in range(0, len(real), 2)]
    ordered = _zero_order(sorted(zeros, key=lambda v: (v.real, v.imag)))
    tops = [np.real(np.poly(ordered[i : i + 2])) for i in range(0, len(ordered), 2)]
    out = []
    for i, (b, a) in enumerate(zip(tops, bottoms, strict=True)):
        b, a = (np.concatenate([c, np.zeros(3 - len(c))]) for c in (b * (1.0 if i else gain), a))
        out.append((float(b[0]), float(b[1]), float(b[2]), float(a[1]), float(a[2])))
    return tuple(out)


@lru_cache(maxsize=32)
def impulse_response(order: int, kind: str, edges: tuple[float, ...], fs: float) -> np.ndarray:
    """Impulse response up to where the slowest pole has faded below double precision."""
    _, poles, _ = butterworth(order, kind, edges, fs)
    length = int(np.ceil(np.log(FADE) / np.log(np.abs(poles).max()))) + 1
    impulse = np.zeros(length)
    impulse[0] = 1.0
    runner = recursive.Runner(recursive.cascade(sections(order, kind, edges, fs)))
    return runner.run(impulse, np.zeros_like(runner.settled))[0]


def _zero_order(zeros: Sequence[complex]) -> np.ndarray:
    """Zeros arranged so that each group of two has real coefficients."""
    real = [z for z in zeros if abs(np.imag(z)) < 1e-12]
    upper = [z for z in zeros if np.imag(z) >= 1e-12]
    out: list[complex] = []
    for z in upper:
        out += [z, np.conj(z)]
    ones = sorted((float(np.real(z)) for z in real), reverse=True)
    while len(ones) > 1:
        out += [ones.pop(0), ones.pop()]
    return np.array(out + ones)


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Filter from rest."""
    return _convolve(x, h)


def map_blocks(
    signal: DataFrame,
    block_len: int,
    before: int,
    after: int,
    compute: Callable[[np.ndarray, bool, bool], np.ndarray],
    keys: Sequence[str] = KEYS,
    value: str = "value",
) -> DataFrame:
    """Apply `compute(samples, is_first, is_last)` to blocks with halos of each channel.

    A Python worker holds one block with its halo at a time. Samples are placed
    by `idx`; there is a row for every step from 0 to the last. A step is NULL exactly where a
    NULL or absent sample lies among the `before` steps before it or the `after` steps after
    it, whatever `block_len` is. `compute` returns as many values as it gets; those of the
    halo are dropped.
    """
    i = F.col("idx")
    tops = signal.groupBy(*keys).agg(F.max("idx").cast("bigint").alias("_top"))
    every = scan.spread(tops, F.lit(0), F.floor(F.col("_top") / block_len), "_block")
    lo = F.greatest(F.lit(0), F.floor((i - after) / block_len))
    hi = F.floor((i + before) / block_len)
    none = F.lit(None)
    cells = signal.select(
        *keys, F.explode(F.sequence(lo, hi)).alias("_block"), i.cast("bigint").alias("_at"),
        F.col(value).cast("double").alias("_v"), none.cast("bigint").alias("_top"),
    )
    # every block has one row that tells the last step of its channel
    marks = every.select(*keys, "_block", none.cast("bigint").alias("_at"), none.cast("double").alias("_v"), "_top")
    rows = cells.unionByName(marks).repartition(scan.PARTS, *keys, "_block")
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("idx", T.LongType()), T.StructField(value, T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def run(block: pa.Table) -> pa.Table:
        top = pc.max(block.column("_top")).as_py()
        if top is None:  # past the last step, reached by halos only
            return arrow_schema.empty_table()
        start = block.column("_block")[0].as_py() * block_len
        origin, end, stop = max(0, start - before), min(start + block_len + after, top + 1), min(start + block_len, top + 1)
        held = block.filter(block.column("_at").is_valid())
        x = np.full(end - origin, np.nan)
        x[held.column("_at").to_numpy() - origin] = held.column("_v").to_numpy()
        absent = np.isnan(x)
        y = compute(np.where(absent, 0.0, x), origin == 0, start + block_len + after >= top + 1)[start - origin : stop - origin]
        step = np.arange(start, stop)
        if absent.any():  # of the samples that reach each step
            upto = np.concatenate([[0], np.cumsum(absent)])
            first, past = np.maximum(step - before, origin), np.minimum(step + after + 1, end)
            y = np.where(upto[past - origin] > upto[first - origin], np.nan, y)
        columns = [block.column(f.name).take(pa.array(np.zeros(len(step), "int64"))) for f in fields]
        columns += [pa.array(step), pa.array(y, from_pandas=True)]
        return pa.Table.from_arrays(columns, names=arrow_schema.names).cast(arrow_schema)

    return rows.groupBy(*keys, "_block").applyInArrow(run, schema)


def clean_channels(
    signal: DataFrame,
    fs: float,
    low: float = 0.1,
    high: float = 70.0,
    mains_hz: float = 50.0,
    mains_bandwidth: float = 10.0,
    keys: Sequence[str] = KEYS,
    block_len: int = 1 << 16,
) -> DataFrame:
    """Band-pass, band-stop around mains (both zero-phase) and scale to unit spread.

    A constant passes the first filter as zero, so the signal needs no centring. A missing sample
    spoils the steps on either side up to where both impulse responses have faded. A block
    must be longer than the 36 steps by which the ends are continued. The signal may be wide, with
    the keys of a recording; so is the result then.
    """
    half = mains_bandwidth / 2
    band, notch = (2, "bandpass", (low, high), fs), (6, "bandstop", (mains_hz - half, mains_hz + half), fs)
    reach = len(impulse_response(*band)) + len(impulse_response(*notch))
    chain = recursive.Chain(((sections(*band), True), (sections(*notch), True)), reach, reach)
    clean = recursive.filter_blocks(signal, chain, block_len, keys)
    # one exchange that both the spread and the scaled samples read, so the filters run once
    clean = clean.repartition(recursive.PARTS, *keys, F.floor(F.col("idx") / block_len))
    scaled = lambda v, sd: v / F.nullif(sd, F.lit(0.0))
    if not is_wide(signal):
        spread = clean.groupBy(*keys).agg(F.stddev_samp("value").alias("_sd"))
        return join_on(clean, spread, keys).withColumn("value", scaled(F.col("value"), F.col("_sd"))).drop("_sd")
    each = clean.select(*keys, F.posexplode("value").alias("_channel", "_v"))
    each = each.groupBy(*keys, "_channel").agg(F.stddev_samp("_v").alias("_sd"))
    spread = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_channel", "_sd"))).alias("_sds"))
    both = join_on(clean, spread.withColumn("_sds", F.col("_sds._sd")), keys)
    return both.withColumn("value", F.zip_with("value", "_sds", scaled)).drop("_sds")


def fir(signal: DataFrame, taps: Sequence[float], keys: Sequence[str] = KEYS, block_len: int = 8192) -> DataFrame:
    """Causal FIR filter from rest, inside blocks with a halo."""
    reach = len(taps) - 1
    weights = np.array(taps, float)
    return map_blocks(signal, block_len, reach, 0, lambda x, first, last: np.convolve(x, weights)[: len(x)], keys)


def envelope(
    signal: DataFrame,
    fs: float,
    low: float = 2.0,
    high: float = 20.0,
    envelope_freq: float = 0.32,
    taps: int = 50,
    keys: Sequence[str] = KEYS,
    block_len: int = 1 << 16,
) -> DataFrame:
    """Amplitude envelope: FIR band-pass, rectification, causal low-pass, from rest.

    A missing sample spoils the steps after it up to where the response has faded. The signal may
    be wide, with the keys of a recording; so is the result then.
    """
    band = fir_bandpass(taps, low, high, fs)
    smooth = (5, "lowpass", (envelope_freq,), fs)
    reach = len(impulse_response(*smooth)) + taps

    def rectified(x: np.ndarray) -> np.ndarray:
        return np.stack([np.abs(np.convolve(one, band)[: len(one)]) for one in x])

    chain = recursive.Chain(((sections(*smooth), False),), reach, 0, taps - 1, rectified)
    return recursive.filter_blocks(signal, chain, block_len, keys)


def margins(
    envelopes: DataFrame,
    window: int,
    lower: float = 0.09,
    upper: float = 0.93,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Lower and upper order statistic of each full tumbling window of `window` samples.

    The pick is element `floor(share x window)` counting from 1, NULL where that is 0. A
    missing sample makes both margins missing. The signal may be wide, with the keys of a
    recording; the result is long.
    """
    picks = {"lower": int(lower * window), "upper": int(upper * window)}
    if is_wide(envelopes):
        found = envelopes.groupBy(*keys, F.floor(F.col("idx") / window).alias("idx")).agg(
            F.collect_list("value").alias("_steps"), F.count(F.lit(1)).alias("_n")
        )
        each = F.posexplode(by_channel(F.col("_steps"), F.size(F.col("_steps")[0]))).alias("channel", "_sorted")
        binned = found.filter(F.col("_n") == window).select(*keys, "idx", "_n", each)
        binned = binned.withColumn("_sorted", F.sort_array(F.filter("_sorted", lambda v: v.isNotNull())))
        keys = (*keys, "channel")
    else:
        binned = envelopes.groupBy(*keys, F.floor(F.col("idx") / window).alias("idx")).agg(
            F.sort_array(F.collect_list("value")).alias("_sorted"), F.count(F.lit(1)).alias("_n")
        )
    full = binned.filter(F.col("_n") == window)
    whole = F.size("_sorted") == window
    columns = {
        name: F.when(whole, F.element_at("_sorted", at)) if at else F.lit(None).cast("double")
        for name, at in picks.items()
    }
    return full.select(*keys, "idx", *[c.alias(n) for n, c in columns.items()])


def lower_margin(margin_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The lower margin as a signal."""
    return margin_rows.select(*keys, "idx", F.col("lower").alias("value"))
