"""Straight-from-the-definition computations that the operators are checked against."""

from __future__ import annotations

import itertools

import numpy as np


def triple_class(points):
    """Class of three (channel, time) points from their distinct set."""
    distinct = sorted(set(points))
    if len(distinct) == 1:
        return 0
    if len(distinct) == 2:
        (n1, t1), (n2, t2) = distinct
        return 1 if n1 == n2 else (3 if t1 == t2 else 4)
    channels = [p[0] for p in distinct]
    if len(set(channels)) == 1:
        return 2
    if len(set(channels)) == 2:
        twin = max(set(channels), key=channels.count)
        pair = sorted(t for n, t in distinct if n == twin)
        (odd,) = [t for n, t in distinct if n != twin]
        if odd == pair[0]:
            return 5
        if odd == pair[1]:
            return 6
        return 7 if odd < pair[0] else (8 if odd < pair[1] else 9)
    times = sorted(t for _, t in distinct)
    if times[0] == times[2]:
        return 10
    if times[0] == times[1]:
        return 11
    return 12 if times[1] == times[2] else 13


def class_sums(x, lag_extents, boundary):
    reach_n, reach_t = lag_extents
    rows, cols = x.shape
    out = np.zeros(14)
    ns, ts = range(-reach_n, reach_n + 1), range(-reach_t, reach_t + 1)

    def at(n, t):
        if boundary == "periodic":
            return x[n % rows, t % cols]
        return x[n, t] if 0 <= n < rows and 0 <= t < cols else 0.0

    for n1, t1, n2, t2 in itertools.product(ns, ts, ns, ts):
        c = triple_class([(0, 0), (n1, t1), (n2, t2)])
        for n, t in itertools.product(range(rows), range(cols)):
            out[c] += x[n, t] * at(n + n1, t + t1) * at(n + n2, t + t2)
    return out
