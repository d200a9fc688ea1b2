"""Packing documents into sequences, in order, by dynamic programming over cuts.

Each task packs the documents of its own partition in the order they come, block by block, so
nothing is shuffled. Cuts may be made where a document or a sentence ends, and at a higher
penalty every `grain` tokens of a document. The cost of a window is its padding (none at the capacity or at
a power of two, which need no padding) plus a penalty if it ends within a document, a larger one if within a sentence. Padding
falls as a window grows, so the best start of a window is the least of (cost + position) over
a sliding range: a monotone queue. What follows the last good cut of a block opens the next;
the end of a partition is cut into powers of two.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracemill.llm.common import texts
from tracemill.llm.tokens import encoder, tokenizer

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: list[int], penalty: list[float], capacity: int, free: int) -> tuple[list[float], list[int]]:
    """Least cost up to every place of `at`, and the index of the place before it on that way.

    `at`: increasing, the first is the start, no gap above `capacity`; `penalty`: of a cut
    there. A window costs `capacity` less its length, nothing if its length is `free`.
    """
    cost, back = [0.0] * len(at), [0] * len(at)
    index = {p: i for i, p in enumerate(at)}
    queue = deque([(at[0], at[0], 0)])  # (cost + place, place, index), both growing
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - capacity:
            queue.popleft()
        least, _, start = queue[0]
        best = least + capacity - here
        i = index.get(here - free)
        if i is not None and cost[i] < best:
            best, start = cost[i], i
        best += penalty[j]
        cost[j], back[j] = best, start
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    return cost, back


@lru_cache(maxsize=4)
def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether its text may end a sentence, and whether it may begin the next one."""
    vocabulary = tokenizer(path).get_vocab()
    ends, begins = np.zeros((2, max(vocabulary.values()) + 1), bool)
    for token, i in vocabulary.items():
        ends[i] = token[-1] in ".!?\u010a"
        begins[i] = token[0] in "\u0120\u010a"
    return ends, begins


class Packer:
    """Packs a stream of (key, ids) into windows; `rows()` takes what is decided so far."""

    def __init__(self, capacity: int, penalty: float, truncation: float, grain: int, block: int, tables, first_sequence: int):
        self.capacity, self.penalty, self.truncation, self.grain = capacity, penalty, truncation, min(grain, capacity)
        self.block, self.tables = block, tables
        self.sequence = first_sequence
        self.docs: list[tuple] = []  # (key, ids, start of these ids in the document, its tokens)
        self.held, self.out = 0, []

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            self._pack(last=False)

    def finish(self) -> None:
        if self.docs:
            self._pack(last=True)

    def _places(self) -> tuple[list[int], list[float]]:
        ends, begins = self.tables
        at, penalty, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, _, _ in self.docs:
            cut = np.flatnonzero(ends[ids[:-1]] & begins[ids[1:]]) + 1
            marks = np.concatenate([[0], cut, [len(ids)]])
            own = np.full(len(cut) + 1, self.penalty)
            own[-1] = 0.0
            # within a sentence: every `grain` tokens from its start
            inner = np.arange(self.grain, len(ids), self.grain)
            inner = inner[np.isin(inner, marks, invert=True)]
            places = np.concatenate([marks[1:], inner])
            own = np.concatenate([own, np.full(len(inner), self.truncation)])
            order = np.argsort(places, kind="stable")
            places, own = places[order], own[order]
            at.append(places + base)
            penalty.append(own)
            base += len(ids)
        return np.concatenate(at).tolist(), np.concatenate(penalty).tolist()

    def _pack(self, last: bool) -> None:
        at, penalty = self._places()
        cost, back = best_cuts(at, penalty, self.capacity, self.capacity // 2)
        tail = next(i for i, p in enumerate(at) if p > at[-1] - self.capacity)
        j = min(range(max(tail, 1), len(at)), key=lambda i: (cost[i], -i)) if at[-1] > self.capacity else 0
        cuts = [at[j]]
        while j:
            j = back[j]
            cuts.append(at[j])
        cuts.reverse()
        if last:  # powers of two need no padding
            rest = at[-1] - cuts[-1]
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    cuts.append(cuts[-1] + (1 << bit))
        self._emit(cuts)

    def _emit(self, cuts: list[int]) -> None:
        w, base, left = 0, 0, []
        for key, ids, start, total in self.docs:
            at, end = base, base + len(ids)
            while at < end:
                if w + 1 == len(cuts):
                    left.append((key, ids[at - base :], start + at - base, total))
                    break
                to = min(end, cuts[w + 1])
                piece = ids[at - base : to - base]
                self.out.append((key, start + at - base, to - at, crc32(piece), total, self.sequence, at - cuts[w]))
                at = to
                if to == cuts[w + 1]:
                    w, self.sequence = w + 1, self.sequence + 1
            base = end
        self.docs, self.held = left, sum(len(d[1]) for d in left)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def packed(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 0,
    penalty: float = 4.0,
    truncation: float = 12.0,
    grain: int = 32,
    block: int = 1 << 16,
    key: str = "doc_id",
    memo: int = 600_000,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    A null text is an empty one, which is the end id alone. Repeated rows are packed each;
    null keys too. Sequence ids are unique over the result and grow along each partition.
    `capacity` must be a power of two. `memo` bounds the pieces whose ids a worker remembers. Other columns are not used.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        encode = encoder(vocabulary, memo)
        first = TaskContext.get().partitionId() << 36
        packer = Packer(capacity, penalty, truncation, grain, block, sentence_tables(vocabulary), first)

        def made():
            rows = packer.rows()
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [keys] + [pa.int64()] * 6
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        keys = None
        for batch in batches:
            keys = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                packer.add(name, np.frombuffer(encode.ids(text) + end, "<u4"))
            yield made()
        if keys is not None:
            packer.finish()
            yield made()

    return docs.select(key, "text").mapInArrow(pack, f"`{key}` {kind}, {SCHEMA}")
