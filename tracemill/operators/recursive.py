"""Recursive filters over blocks of a recording, with their state carried exactly.

A filter is a cascade of second-order sections. Over a block everything is linear in the block's
samples and in the states that come in from its neighbours, so one pass over the blocks finds
the states that each sends on when none comes in; a scan over one small row per block then
adds what does come in, and a second pass filters with the true states. Nothing is cut where
a response fades, and any block length gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.functions.wide import is_wide
from tracemill.operators import scan

#: Samples filtered by one matrix product.
STRIDE = 64
#: Tasks over the blocks of all recordings, each with a Python worker; so fewer than for plain windows.
PARTS = 128

Section = tuple[float, float, float, float, float]


class Filter(NamedTuple):
    """State space of a cascade: state' = a state + b x, y = c state + d x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def order(self) -> int:
        return len(self.b)

    def settled(self) -> np.ndarray:
        """The state that a constant 1 leads to."""
        return np.linalg.solve(np.eye(self.order) - self.a, self.b)


def cascade(sections: Sequence[Section]) -> Filter:
    """Sections (b0, b1, b2, a1, a2), each in transposed direct form, one after the other."""
    whole = Filter(np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0)
    for b0, b1, b2, a1, a2 in sections:
        own = Filter(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0)
        n = whole.order
        a = np.zeros((n + 2, n + 2))
        a[:n, :n], a[n:, n:], a[n:, :n] = whole.a, own.a, np.outer(own.b, whole.c)
        whole = Filter(a, np.concatenate([whole.b, own.b * whole.d]), np.concatenate([own.d * whole.c, own.c]), own.d * whole.d)
    return whole


class Runner:
    """Runs a filter along arrays, a stride of samples at a time."""

    def __init__(self, filter: Filter):
        self.filter, n = filter, filter.order
        self.settled = filter.settled() if n else np.zeros(0)
        powers = [np.eye(n)]
        for _ in range(STRIDE):
            powers.append(powers[-1] @ filter.a)
        self.powers = powers
        impulse = np.array([filter.d, *(filter.c @ powers[k] @ filter.b for k in range(STRIDE - 1))])
        lag = np.arange(STRIDE)[:, None] - np.arange(STRIDE)
        self.direct = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.seen = np.stack([filter.c @ powers[k] for k in range(STRIDE)])
        self.reached = np.stack([powers[STRIDE - 1 - k] @ filter.b for k in range(STRIDE)], axis=1)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples along the last axis and the states after the last ones."""
        n = x.shape[-1]
        whole, lead = n // STRIDE, x.shape[:-1]
        strides = x[..., : whole * STRIDE].reshape(*lead, whole, STRIDE)
        pushed, states = strides @ self.reached.T, np.empty((*lead, whole, self.filter.order))
        onward = self.powers[STRIDE].T
        for k in range(whole):
            states[..., k, :] = state
            state = state @ onward + pushed[..., k, :]
        out = np.empty(x.shape)
        out[..., : whole * STRIDE] = (strides @ self.direct.T + states @ self.seen.T).reshape(*lead, whole * STRIDE)
        rest = x[..., whole * STRIDE :]
        r = rest.shape[-1]
        if r:
            out[..., whole * STRIDE :] = rest @ self.direct[:r, :r].T + state @ self.seen[:r].T
            state = state @ self.powers[r].T + rest @ self.reached[:, STRIDE - r :].T
        return out, state


class Chain(NamedTuple):
    """What is done to a block: `before` earlier samples are `prepared` first, then the passes run.

    `passes` are (sections, whether zero-phase). A plain pass starts from rest. A zero-phase one goes
    forwards and backwards, each from the settled state of its first value, over the recording
    continued past its ends by point reflection, 6 steps a section. A sample is NULL where a NULL or
    absent one lies among the `back` steps before it or the `ahead` steps after it.
    """

    passes: tuple[tuple[tuple[Section, ...], bool], ...]
    back: int
    ahead: int
    before: int = 0
    prepared: Callable[[np.ndarray], np.ndarray] | None = None

    def widths(self) -> list[int]:
        """Length of the state of every direction, in the order in which they run."""
        return [2 * len(s) for s, both in self.passes for _ in range(2 if both else 1)]


@lru_cache(maxsize=16)
def _runner(sections: tuple[Section, ...]) -> Runner:
    return Runner(cascade(sections))


def _reflected(x: np.ndarray, left: int, right: int) -> np.ndarray:
    n = x.shape[-1]
    left, right = min(left, n - 1), min(right, n - 1)
    # places counted from the front: a slice to before the first one must not wrap around
    before, after = np.arange(left, 0, -1), np.arange(n - 2, n - 2 - right, -1)
    return np.concatenate([2 * x[..., :1] - x[..., before], x, 2 * x[..., -1:] - x[..., after]], axis=-1)


def filtered(x: np.ndarray, chain: Chain, states: Sequence[np.ndarray], first: bool, last: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block with the states that come in, and the states that it sends on; samples and states are on the last axis."""
    sent, states = [], iter(states)
    for sections, both in chain.passes:
        runner, n = _runner(sections), x.shape[-1]
        come = next(states)
        if not both:
            x, state = runner.run(x, np.zeros_like(come) if first else come)
            sent.append(state)
            continue
        pad = min(6 * len(sections), n - 1)
        wide = _reflected(x, pad if first else 0, pad if last else 0)
        y, state = runner.run(wide, runner.settled * wide[..., :1] if first else come)
        sent.append(state)
        come = next(states)
        y, state = runner.run(y[..., ::-1], runner.settled * y[..., -1:] if last else come)
        sent.append(state)
        lead = pad if first else 0
        x = y[..., ::-1][..., lead : lead + n]
    return x, sent


@lru_cache(maxsize=64)
def _response(passes: tuple, length: int, first: bool, last: bool) -> np.ndarray:
    """How the states that a block sends on follow from those that come in, as one matrix."""
    chain = Chain(passes, 0, 0)
    widths = chain.widths()
    cuts = np.cumsum(widths)[:-1]
    columns = []
    for unit in np.eye(sum(widths)):
        _, sent = filtered(np.zeros(length), chain, np.split(unit, cuts), first, last)
        columns.append(np.concatenate(sent))
    return np.stack(columns, axis=1)


def carried(chain: Chain, sent: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """States that come into each block of a recording, from those sent when none comes in: [blocks, channels, states].

    A forward pass takes its state from the block before, a backward one from the block after.
    Passes are solved in order, as each depends on those before it only.
    """
    n, widths = len(sent), chain.widths()
    come = np.zeros_like(sent)
    if n == 1:
        return come
    response = [_response(chain.passes, int(k), i == 0, i == n - 1) for i, k in enumerate(lengths)]
    at, backward = 0, []
    for _, both in chain.passes:
        backward += [False, True] if both else [False]
    for width, back in zip(widths, backward, strict=True):
        part, upto = slice(at, at + width), at + width
        blocks = range(n - 1, 0, -1) if back else range(n - 1)
        for k in blocks:
            come[k - 1 if back else k + 1, ..., part] = sent[k, ..., part] + come[k, ..., :upto] @ response[k][part, :upto].T
        at = upto
    return come


def _tail(chain: Chain) -> int:
    """Steps that the last block needs, so that the end can be continued."""
    return max((6 * len(sections) + 1 for sections, both in chain.passes if both), default=1)


def _dealt(signal: DataFrame, block_len: int, before: int, tail: int, keys: Sequence[str], value: str) -> DataFrame:
    """Samples by block, with `before` earlier and `tail` later steps, and a row per block that tells the last step and the width."""
    i = F.col("idx")
    wide = is_wide(signal, value)
    width = F.max(F.size(value)) if wide else F.max(F.lit(1))
    tops = signal.groupBy(*keys).agg(F.max("idx").cast("bigint").alias("_top"), width.alias("_width"))
    every = scan.spread(tops, F.lit(0), F.floor(F.col("_top") / block_len), "_block")
    kind = "array<double>" if wide else "double"
    none = F.lit(None)
    lo = F.greatest(F.lit(0), F.floor((i - tail) / block_len))
    cells = signal.select(
        *keys, F.explode(F.sequence(lo, F.floor((i + before) / block_len))).alias("_block"), i.cast("bigint").alias("_at"),
        F.col(value).cast(kind).alias("_v"), none.cast("bigint").alias("_top"), none.cast("int").alias("_width"),
    )
    marks = every.select(*keys, "_block", none.cast("bigint").alias("_at"), none.cast(kind).alias("_v"), "_top", "_width")
    return cells.unionByName(marks).repartition(PARTS, *keys, "_block")


class Block(NamedTuple):
    """Prepared samples [channels, steps] of a block, missing ones as 0, and where they are missing."""

    x: np.ndarray
    absent: np.ndarray
    start: int
    first: bool
    last: bool


def _block(table: pa.Table, chain: Chain, block_len: int, tail: int) -> Block | None:
    """None for a block past the last step, or one whose few steps the block before it has taken."""
    top, width = pc.max(table.column("_top")).as_py(), pc.max(table.column("_width")).as_py()
    at = table.column("_block")[0].as_py()
    start = at * block_len
    if top is None or (at and top + 1 - start < tail):
        return None
    last = top + 1 < start + block_len + tail
    stop = top + 1 if last else start + block_len
    origin = max(0, start - chain.before)
    step = table.column("_at")
    held = table.filter(pc.and_(pc.and_(pc.is_valid(table.column("_v")), pc.greater_equal(step, origin)), pc.less(step, stop)))
    values = held.column("_v").combine_chunks()
    flat = values.flatten() if pa.types.is_list(values.type) else values
    x = np.full((stop - origin, width), np.nan)
    x[held.column("_at").to_numpy() - origin] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    x = np.ascontiguousarray(x.T)
    absent = np.isnan(x)
    x = np.where(absent, 0.0, x)
    if chain.prepared is not None:
        x = chain.prepared(x)
    return Block(x[:, start - origin :], absent[:, start - origin :], start, at == 0, last)


FAR = np.iinfo(np.int64).max // 4


def filter_blocks(signal: DataFrame, chain: Chain, block_len: int = 1 << 16, keys: Sequence[str] = ("patient_num", "channel"), value: str = "value") -> DataFrame:
    """`keys, idx, value`: the signal through the chain, a row for every step from 0 to the last.

    Samples are placed by `idx`; a wide signal, with the keys of a recording, gives a wide one. A Python
    worker holds one block at a time, of `block_len` steps, the last one a little shorter or longer, as
    both passes take the blocks from the same exchange. Between them one row of a few states per block
    is scanned for each key.
    """
    tail = min(_tail(chain), block_len)
    rows = _dealt(signal, block_len, chain.before, tail, keys, value)
    wide = is_wide(signal, value)
    fields = [f for f in rows.schema.fields if f.name in keys]
    widths = chain.widths()
    cuts = np.cumsum(widths)[:-1]
    per_block = "_block bigint, _length bigint, _channels bigint, sent array<double>, low array<bigint>, high array<bigint>"
    states = T.StructType([*fields, *T.StructType.fromDDL(per_block).fields])
    states_arrow = to_arrow_schema(states)

    def keyed(table: pa.Table, n: int) -> list[pa.ChunkedArray]:
        return [table.column(f.name).take(pa.array(np.zeros(n, "int64"))) for f in fields]

    def ends(table: pa.Table) -> pa.Table:
        block = _block(table, chain, block_len, tail)
        if block is None or (block.first and block.last):  # nothing comes into a recording of one block
            return states_arrow.empty_table()
        channels, n = block.x.shape
        _, sent = filtered(block.x, chain, [np.zeros((channels, w)) for w in widths], block.first, block.last)
        step = np.arange(block.start, block.start + n)
        low, high = np.where(block.absent, step, FAR).min(axis=1), np.where(block.absent, step, -FAR).max(axis=1)
        found = [n, channels, np.concatenate(sent, axis=1).ravel(), low, high]
        columns = keyed(table, 1) + [table.column("_block").slice(0, 1)] + [pa.array([v]) for v in found]
        return pa.Table.from_arrays(columns, names=states_arrow.names).cast(states_arrow)

    given = T.StructType([*fields, *T.StructType.fromDDL("_block bigint, come array<double>, before array<bigint>, after array<bigint>").fields])
    given_arrow = to_arrow_schema(given)

    def scanned(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        sent, low, high = (np.array(table.column(c).to_pylist()) for c in ("sent", "low", "high"))
        sent = sent.reshape(len(sent), table.column("_channels")[0].as_py(), -1)
        come = carried(chain, sent, table.column("_length").to_numpy())
        before, after = np.full_like(high, -FAR), np.full_like(low, FAR)
        before[1:] = np.maximum.accumulate(high)[:-1]
        after[:-1] = np.minimum.accumulate(low[::-1])[::-1][1:]
        columns = keyed(table, len(sent)) + [table.column("_block")]
        columns += [pa.array(list(v.reshape(len(sent), -1))) for v in (come, before, after)]
        return pa.Table.from_arrays(columns, names=given_arrow.names).cast(given_arrow)

    come = rows.groupBy(*keys, "_block").applyInArrow(ends, states).groupBy(*keys).applyInArrow(scanned, given)
    kind = T.ArrayType(T.DoubleType()) if wide else T.DoubleType()
    out_schema = T.StructType([*fields, T.StructField("idx", T.LongType()), T.StructField(value, kind)])
    out_arrow = to_arrow_schema(out_schema)

    def finish(table: pa.Table, states: pa.Table) -> pa.Table:
        block = _block(table, chain, block_len, tail) if table.num_rows else None
        if block is None:
            return out_arrow.empty_table()
        channels, n = block.x.shape
        state, before, after = np.zeros((channels, sum(widths))), np.full((channels, 1), -FAR), np.full((channels, 1), FAR)
        if states.num_rows:
            state, before, after = (np.array(states.column(c)[0].as_py()).reshape(channels, -1) for c in ("come", "before", "after"))
        y, _ = filtered(block.x, chain, np.split(state, cuts, axis=1), block.first, block.last)
        step = np.arange(block.start, block.start + n)
        held = np.maximum.accumulate(np.where(block.absent, step, before), axis=1)
        next_ = np.minimum.accumulate(np.where(block.absent, step, after)[:, ::-1], axis=1)[:, ::-1]
        y = np.where((step - held <= chain.back) | (next_ - step <= chain.ahead), np.nan, y)
        values = pa.array(np.ascontiguousarray(y.T).ravel(), from_pandas=True)
        if wide:
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * channels, pa.int32()), values)
        columns = [*keyed(table, n), pa.array(step), values]
        return pa.Table.from_arrays(columns, names=out_arrow.names).cast(out_arrow)

    return rows.groupBy(*keys, "_block").cogroup(come.groupBy(*keys, "_block")).applyInArrow(finish, out_schema)
