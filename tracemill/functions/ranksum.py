"""Exact null distribution of the rank sum, by dynamic programming over the ranks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4096)
def rank_sum_counts(m: int, ties: tuple[int, ...]) -> np.ndarray:
    """How many choices of `m` of the ranked items have each doubled rank sum.

    `ties` are the sizes of the groups of equal values in ascending order; a group's items share
    its middle rank, so doubled ranks are whole numbers. Counts stay exact below 2^63, that is
    for 62 items and fewer.
    """
    ranks, before = [], 0
    for t in ties:
        ranks += [2 * before + t + 1] * t
        before += t
    ways = np.zeros((m + 1, sum(ranks) + 1), np.int64)
    ways[0, 0] = 1
    for i, r in enumerate(ranks):
        for j in range(min(i + 1, m), 0, -1):
            ways[j, r:] += ways[j - 1, : ways.shape[1] - r]
    return ways[m]


def two_sided(u: float, m: int, ties: tuple[int, ...]) -> float:
    """Twice the smaller tail of U, its own value included, 1 at most."""
    counts = rank_sum_counts(m, ties)
    at = round(2 * u) + m * (m + 1)
    whole = float(counts.sum())
    return min(1.0, 2 * min(float(counts[: at + 1].sum()), float(counts[at:].sum())) / whole)
