"""A run-length index: the Burrows-Wheeler transform in runs, with sampled run ends.

Texts are joined with separators that are all different, so no match crosses from one text to
the next. For a query the longest match with any text is carried from its last byte to its
first (matching statistics): a step inside a run of the next byte keeps the match; otherwise
the match moves to the nearest run of that byte above or below, whichever end shares more,
which the sampled text positions of run ends tell. Queries are streamed side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

END = 0xFF  # in no UTF-8 text


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position (the text is followed by eight separators)."""
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    return np.ndarray((len(text),), "<u8", padded, strides=(1,)).copy()


def _ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ranks of all suffixes; ranks by a prefix of a power of two up to `depth`; that power."""
    n = len(text)
    ends = np.flatnonzero(text == END)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = _words(text).byteswap()
    # bytes after the separator don't count, and every separator is different
    cut = np.minimum(to_end, 7).astype(np.uint64)
    key &= ~np.uint64(0) << ((np.uint64(7) - cut) * np.uint64(8))
    own = to_end < 8
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | own[order][1:]
    rank, size = np.empty(n, np.int64), 8
    rank[order] = np.cumsum(new) - 1
    kept, power = rank, 8
    while True:
        if size <= depth:
            kept, power = rank, size
        if rank.max(initial=0) == n - 1 and size * 2 > depth:
            return rank, kept, power
        after = np.zeros(n, np.int64)
        open_ = np.flatnonzero(to_end >= size)
        after[open_] = rank[open_ + size] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        size *= 2


class RunIndex:
    """Index of `texts`, each with a number; `span` is the length of a match that counts."""

    def __init__(self, texts: Sequence[bytes], numbers: np.ndarray, span: int):
        self.span = span
        text = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        rank, prefix, power = _ranks(text, span)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        last = text[order - 1]
        self.starts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
        self.ends = np.concatenate([self.starts[1:] - 1, [len(text) - 1]])
        self.heads = last[self.starts].astype(np.int64)
        self.first_at, self.last_at = order[self.starts], order[self.ends]
        runs = len(self.starts)
        self.by_head = np.argsort(self.heads, kind="stable")
        self.head_keys = self.heads[self.by_head] * runs + self.by_head
        lengths = (self.ends - self.starts + 1)[self.by_head]
        self.row_of = np.empty(runs, np.int64)  # the row that a run's first row maps to
        self.row_of[self.by_head] = np.cumsum(lengths) - lengths
        self.text = text
        self.words = _words(text)
        # rows that share `span` bytes, and the smallest number among them
        second = np.minimum(order + span - power, len(text) - 1)
        keys = prefix[order], prefix[second]
        new = np.ones(len(text), bool)
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        self.groups = np.flatnonzero(new)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        self.smallest = np.minimum.reduceat(numbers[owner[order]], self.groups)

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the text has in common from positions `a` and `b`, up to `most` or so."""
        same = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        n = len(self.text)
        while len(going):
            x, y = a[going] + same[going], b[going] + same[going]
            inside = (x < n) & (y < n)
            going, x, y = going[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            same[going] += np.where(differ == 0, 8, low)
            going = going[(differ == 0) & (same[going] < most[going])]
        return same

    def matches(self, queries: Sequence[bytes], below: np.ndarray) -> list[np.ndarray]:
        """For each query the starts of `span` bytes that a text with a number below has too."""
        m, width = len(queries), max(map(len, queries), default=0)
        sizes = np.array([len(q) for q in queries], np.int64)
        grid = np.frombuffer(b"".join(q.rjust(width, b"\xff") for q in queries), np.uint8).reshape(m, width)
        runs = len(self.starts)
        row, at, length = np.zeros(m, np.int64), np.full(m, self.first_at[0]), np.zeros(m, np.int64)
        found = np.zeros((m, width), bool)
        for column in range(width - 1, -1, -1):
            live = np.flatnonzero(sizes >= width - column)
            c = grid[live, column].astype(np.int64)
            run = np.searchsorted(self.starts, row[live], "right") - 1
            same = self.heads[run] == c
            i, r = live[same], run[same]
            row[i] = self.row_of[r] + row[i] - self.starts[r]
            at[i] -= 1
            length[i] += 1
            i, r, c = live[~same], run[~same], c[~same]
            if len(i):
                below_ = np.searchsorted(self.head_keys, c * runs + r)
                down, up = np.minimum(below_, runs - 1), np.maximum(below_ - 1, 0)
                down, up = self.by_head[down], self.by_head[up]
                has_down, has_up = (below_ < runs) & (self.heads[down] == c), (below_ > 0) & (self.heads[up] == c)
                cap = np.minimum(length[i], self.span)
                common = [
                    np.where(has, np.minimum(self._shared(at[i], to, cap), cap), -1)
                    for has, to in ((has_down, self.first_at[down]), (has_up, self.last_at[up]))
                ]
                take_up = common[1] > common[0]
                best = np.maximum(*common)
                some = best >= 0
                target = np.where(take_up, up, down)
                j, t, u = i[some], target[some], take_up[some]
                row[j] = self.row_of[t] + np.where(u, self.ends[t] - self.starts[t], 0)
                at[j] = np.where(u, self.last_at[t], self.first_at[t]) - 1
                length[j] = best[some] + 1
                length[i[~some]] = 0
            long = live[length[live] >= self.span]
            group = np.searchsorted(self.groups, row[long], "right") - 1
            found[long, column] = self.smallest[group] < below[long]
        return [np.flatnonzero(f) - (width - s) for f, s in zip(found, sizes, strict=True)]
