"""Triple-correlation class sums of a stack of snippets, with NumPy.

For a snippet `x[n, t]` the triple correlation at lags (n1, t1, n2, t2) is the sum over all
(n, t) of `x[n, t] x[n+n1, t+t1] x[n+n2, t+t2]`. The lag quadruples in the box
|n| <= L_n, |t| <= L_t fall into 14 classes by the shape of the distinct points touched:

 0 one point                                5 on two channels, odd one with the earlier
 1 two points, one channel                  6 odd one with the later
 2 three points, one channel                7 odd one before the pair
 3 two channels, same time                  8 odd one between the pair
 4 two channels, different times            9 odd one after the pair
10 three channels, simultaneous            12 three channels, one then two together
11 three channels, two together then one   13 three channels, all in sequence

A class only asks which points share a channel and in which order they come, so each sum
over lags separates into window sums along time and across channels. Every snippet costs
O(channels x times), whatever the lag box.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

N_CLASSES = 14
PAD_MODES = {"periodic": "wrap", "zeropad": "constant"}


def _window_sum(a: np.ndarray, axis: int, first: int, last: int, length: int) -> np.ndarray:
    """Sum over offsets `first..last` of a padded axis, for `length` positions."""
    total = np.cumsum(a, axis=axis)
    zero = np.zeros_like(np.take(total, [0], axis=axis))
    total = np.concatenate([zero, total], axis=axis)
    hi = [slice(None)] * a.ndim
    lo = [slice(None)] * a.ndim
    hi[axis] = slice(last + 1, last + 1 + length)
    lo[axis] = slice(first, first + length)
    return total[tuple(hi)] - total[tuple(lo)]


def _pad(a: np.ndarray, axis: int, by: int, boundary: str) -> np.ndarray:
    widths = [(0, 0)] * a.ndim
    widths[axis] = (by, by)
    return np.pad(a, widths, mode=PAD_MODES[boundary])


def class_sums(x: np.ndarray, lag_extents: tuple[int, int], boundary: str = "periodic") -> np.ndarray:
    """Class sums of shape [snippets, 14] for `x` of shape [snippets, channels, times]."""
    reach_n, reach_t = lag_extents
    channels, times = x.shape[1:]

    def others(y: np.ndarray) -> np.ndarray:
        padded = _pad(y, 1, reach_n, boundary)
        return _window_sum(padded, 1, 0, 2 * reach_n, channels) - y

    wide = _pad(x, 2, reach_t, boundary)
    wide_others = others(wide)
    centre = slice(reach_t, reach_t + times)

    def past(y: np.ndarray) -> np.ndarray:
        return _window_sum(y, 2, 0, reach_t - 1, times)

    def future(y: np.ndarray) -> np.ndarray:
        return _window_sum(y, 2, reach_t + 1, 2 * reach_t, times)

    def total(y: np.ndarray) -> np.ndarray:
        return np.einsum("snt,snt->s", x, y)

    b = wide_others[:, :, centre]
    a_past, a_next = past(wide), future(wide)
    b_past, b_next = past(wide_others), future(wide_others)
    square, square_past, square_next = x * x, past(wide * wide), future(wide * wide)
    bb_past, bb_next = past(wide_others**2), future(wide_others**2)
    ab_past, ab_next = past(wide * wide_others), future(wide * wide_others)
    a_both, b_both = a_past + a_next, b_past + b_next

    # ordered pairs (other channel first, then own channel) inside each half window
    before = np.cumsum(wide_others, axis=2) - wide_others
    nested_past = past(wide * before) - before[:, :, :times] * a_past
    after = before[:, :, reach_t + 1 : reach_t + 1 + times] if reach_t else before
    nested_next = future(wide * before) - after * a_next

    # both points on one other channel
    pair_zero_next, pair_zero_past = others(x * a_next), others(x * a_past)
    pair_next = others(a_next**2 - square_next)
    pair_past = others(a_past**2 - square_past)
    pair_split = others(a_past * a_next)
    same_zero, same_past, same_next = others(square), others(square_past), others(square_next)

    sums = [
        total(square),
        total(2 * x * a_both + square_past + square_next),
        total(a_both**2 - square_past - square_next),
        total(2 * x * b + same_zero),
        total(2 * x * b_both + same_past + same_next),
        2 * total(ab_past + b * a_next + pair_zero_next),
        2 * total(b * a_past + ab_next + pair_zero_past),
        total(2 * (nested_past + a_next * b_past) + pair_next),
        2 * total(a_past * b_past - ab_past - nested_past + nested_next + pair_split),
        total(2 * (a_past * b_next + a_next * b_next - ab_next - nested_next) + pair_past),
        total(b * b - same_zero),
        total(2 * (b * b_next - pair_zero_next) + bb_past - same_past),
        total(2 * (b * b_past - pair_zero_past) + bb_next - same_next),
        total(b_both**2 - bb_past - bb_next - others(a_both**2 - square_past - square_next)),
    ]
    return np.stack(sums, axis=1)


def lag_class(n1: np.ndarray, t1: np.ndarray, n2: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Class of each lag quadruple, straight from the definition of the shapes."""
    n1, t1, n2, t2 = np.broadcast_arrays(n1, t1, n2, t2)
    at_base1, at_base2 = (n1 == 0) & (t1 == 0), (n2 == 0) & (t2 == 0)
    together = (n1 == n2) & (t1 == t2)
    # two distinct points: their difference decides
    n = np.where(at_base1, n2, n1)
    t = np.where(at_base1, t2, t1)
    two = np.where(n == 0, 1, np.where(t == 0, 3, 4))
    # two channels: odd point's time against the sorted pair's
    odd_base, odd_1 = n1 == n2, n2 == 0
    odd = np.where(odd_base, 0, np.where(odd_1, t1, t2))
    pair = np.where(odd_base, t1, 0), np.where(odd_base, t2, np.where(odd_1, t2, t1))
    early, late = np.minimum(*pair), np.maximum(*pair)
    three_two = np.select([odd == early, odd == late, odd < early, odd < late], [5, 6, 7, 8], 9)
    # three channels: which times coincide
    low = np.minimum(np.minimum(t1, t2), 0)
    high = np.maximum(np.maximum(t1, t2), 0)
    n_low = (t1 == low).astype(int) + (t2 == low) + (low == 0)
    n_high = (t1 == high).astype(int) + (t2 == high) + (high == 0)
    three_three = np.select([low == high, n_low == 2, n_high == 2], [10, 11, 12], 13)
    one_channel = (n1 == 0) & (n2 == 0)
    two_channels = (n1 == n2) | (n1 == 0) | (n2 == 0)
    three = np.where(one_channel, 2, np.where(two_channels, three_two, three_three))
    points = 3 - (at_base1 | at_base2 | together) - (at_base1 & at_base2)
    return np.select([points == 1, points == 2], [0, two], three)


@lru_cache(maxsize=8)
def normal_variance_per_cell(lag_extents: tuple[int, int]) -> np.ndarray:
    """Variance of each class sum per cell for independent standard normal samples.

    Periodic boundary without aliasing. A product of three distinct samples counts as
    often as it can be read from its own points, a square times a sample three times per
    neighbour.
    """
    reach_n, reach_t = lag_extents
    n, t = np.arange(-reach_n, reach_n + 1), np.arange(-reach_t, reach_t + 1)
    n1, t1 = (g.ravel()[:, None] for g in np.meshgrid(n, t, indexing="ij"))
    n2, t2 = n1.T, t1.T
    classes = lag_class(n1, t1, n2, t2)
    mutual = (np.abs(n1 - n2) <= reach_n) & (np.abs(t1 - t2) <= reach_t)
    readings = np.where(mutual, 6.0, 2.0)
    out = np.array([readings[classes == c].sum() for c in range(N_CLASSES)])
    sizes = {1: 2 * reach_t, 3: 2 * reach_n, 4: 4 * reach_n * reach_t}
    out[0] = 15.0
    for c, k in sizes.items():
        out[c] = 9.0 * (3 * k + k * (k - 1))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    low = x.min(axis=(1, 2), keepdims=True)
    x = x - low
    return x / x.max(axis=(1, 2), keepdims=True)


def _zscore(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=(1, 2), keepdims=True)
    return x / x.std(axis=(1, 2), ddof=1, keepdims=True)


PREPROCESS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x,
    "zscore": _zscore,
    "unit": _unit,
    "power_unit": lambda x: _unit(x**2),
    "unit_zscore": lambda x: _zscore(_unit(x)),
    "zscore_unit": lambda x: _unit(_zscore(x)),
}

# Name of each contribution measure -> (preprocessing, postprocessing, surrogates).
MEASURES: dict[str, tuple[str, str, int]] = {
    "A": ("identity", "identity", 0),
    "AN": ("identity", "over_noise", 2),
    "A_01norm": ("unit", "identity", 0),
    "AN_01norm": ("unit", "over_noise", 2),
    "AN_01norm_power": ("power_unit", "over_noise", 1),
    "AN_01norm_normal": ("unit", "over_normal", 1),
    "AN_znorm": ("zscore", "minus_noise", 5),
    "A_znorm": ("zscore", "identity", 0),
    "A_znorm_std": ("zscore", "over_std", 0),
    "A_01znorm": ("unit_zscore", "identity", 0),
    "A_z01norm": ("zscore_unit", "identity", 0),
}


def contributions(
    x: np.ndarray,
    surrogates: np.ndarray,
    measure: str,
    lag_extents: tuple[int, int],
    boundary: str,
    variance: np.ndarray | None = None,
) -> np.ndarray:
    """Class contributions of each snippet under a named measure.

    `surrogates` is [draws, snippets, channels, times]: shuffled snippets, or normal noise for
    `over_normal`, as many draws as `MEASURES` asks for. `variance` is
    `normal_variance_per_cell(lag_extents)`, for measures that divide by it.
    """
    pre, post, _ = MEASURES[measure]
    actual = class_sums(PREPROCESS[pre](x), lag_extents, boundary)
    if len(surrogates):
        noise = sum(class_sums(PREPROCESS[pre](s), lag_extents, boundary) for s in surrogates) / len(surrogates)
    if post == "over_noise":
        return actual / noise - 1
    if post == "over_normal":
        return actual / noise
    if post == "minus_noise":
        return actual - noise
    if post == "over_std":
        cells = x.shape[1] * x.shape[2]
        return actual / np.sqrt(variance * cells)
    return actual


def pair_lag_sums(x: np.ndarray, reach_a: int, reach_b: int, lag_channels: bool) -> np.ndarray:
    """Correlation at each pair of time lags, over base points whose lags stay inside.

    With `lag_channels` the channel lags are summed over as well; without, they only
    repeat the sum. Shape [snippets, 2 reach_b + 1, 2 reach_b + 1].
    """
    s, n, t = x.shape
    width_a, width_b = 2 * reach_a + 1, 2 * reach_b + 1
    if n < width_a or t < width_b:
        return np.zeros((s, width_b, width_b))
    base = x[:, reach_a : n - reach_a, reach_b : t - reach_b]
    lagged = _window_sum(x, 1, 0, 2 * reach_a, n - 2 * reach_a) if lag_channels else x[:, reach_a : n - reach_a]
    windows = np.lib.stride_tricks.sliding_window_view(lagged, width_b, axis=2)
    out = np.einsum("snt,sntb,sntc->sbc", base, windows, windows, optimize=True)
    return out if lag_channels else out * width_a**2


def marginal_sums(x: np.ndarray, lag_extents: tuple[int, int]) -> dict[str, np.ndarray]:
    """Zero-padded triple correlation summed over the other lags.

    `time` is over (t1, t2), `space` over (n1, n2) and `space_time` over (n1, t1).
    """
    reach_n, reach_t = lag_extents
    s, n, t = x.shape
    wide = np.pad(x, ((0, 0), (reach_n, reach_n), (reach_t, reach_t)))
    over_n = _window_sum(wide, 1, 0, 2 * reach_n, n)
    over_t = _window_sum(wide, 2, 0, 2 * reach_t, t)
    over_both = _window_sum(over_n, 2, 0, 2 * reach_t, t)
    view = np.lib.stride_tricks.sliding_window_view
    by_time = view(over_n, 2 * reach_t + 1, axis=2)
    by_space = view(over_t, 2 * reach_n + 1, axis=1)
    by_both = view(wide, (2 * reach_n + 1, 2 * reach_t + 1), axis=(1, 2))
    return {
        "time": np.einsum("snt,snta,sntb->sab", x, by_time, by_time, optimize=True),
        "space": np.einsum("snt,snta,sntb->sab", x, by_space, by_space, optimize=True),
        "space_time": np.einsum("snt,sntab->sab", x * over_both, by_both, optimize=True),
    }
