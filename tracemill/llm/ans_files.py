"""Token ids as files of a static range asymmetric numeral system.

One frequency table, counted over all ids, serves every block. A block holds whole documents
(a document that is longer than a block gets one of its own) and is coded by itself: its ids
are dealt to interleaved states that numpy moves together, each giving out 32-bit words. Every
so many steps the states and the place in the words are kept as a checkpoint, so that a reader
can start there; a checksum covers the ids. Blocks are rows of Parquet files, written by tasks
in ascending order of the document ids, so any file system that Spark writes to will do.
"""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import texts, written
from tracemill.llm.tokens import encoder
from tracemill.session import scratch_folder

SCALE_BITS = 20
LOW = 1 << 24  # states stay in [LOW, LOW << 32); a multiple of the table's sum
BLOCK = (
    "part int, block int, before long, tokens long, lanes int, checkpoint int, words binary, states binary, "
    "checkpoints binary, checksum long, doc_ids array<long>, lengths array<long>"
)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE_BITS; every id that occurs gets 1 at least."""
    total = 1 << SCALE_BITS
    if not counts.sum():
        return np.zeros(len(counts), np.uint32)
    share = counts * (total / counts.sum())
    scaled = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    short = total - int(scaled.sum())
    if short >= 0:
        scaled[np.argmax(scaled)] += short
    else:  # take from the largest
        for i in np.argsort(-scaled, kind="stable"):
            take = min(-short, int(scaled[i]) - max(1, int(scaled[i]) // 2))
            scaled[i] -= take
            short += take
            if not short:
                break
    return scaled.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table, lanes: int, checkpoint: int) -> tuple[bytes, bytes, bytes]:
    """Words, states, and checkpoints of a block; decoding goes forward from the first id."""
    steps = -(-len(ids) // lanes)
    shift, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    state = np.full(lanes, LOW, np.uint64)
    out, points, written = [], [], 0
    for step in range(steps - 1, -1, -1):
        row = ids[step * lanes : (step + 1) * lanes]
        s = state[: len(row)]
        f, c = table.freq[row], table.start[row]
        full = s >= (f << np.uint64(36))
        words = (s[full] & mask).astype("<u4")[::-1]
        out.append(words)
        written += len(words)
        s = np.where(full, s >> shift, s)
        state[: len(row)] = ((s // f) << np.uint64(SCALE_BITS)) + s % f + c
        if step % checkpoint == 0 and step:
            points.append((written, state.astype("<u8").tobytes()))
    words = np.concatenate(out)[::-1] if out else np.empty(0, "<u4")
    marks = b"".join(np.array([written - w], "<u8").tobytes() + s for w, s in reversed(points))
    return words.tobytes(), state.astype("<u8").tobytes(), marks


def decode(words: bytes, states: bytes, table: Table, n: int, lanes: int, first_step: int = 0, at: int = 0, last_step: int | None = None) -> np.ndarray:
    """Ids of the steps from `first_step`, given the states and the place in the words there."""
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    state = np.frombuffer(states, "<u8").copy()
    mask, bits, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    steps = -(-n // lanes)
    out = []
    for step in range(first_step, steps if last_step is None else min(steps, last_step)):
        s = state[: min(lanes, n - step * lanes)]
        slot = s & mask
        ids = table.symbol[slot]
        s = table.freq[ids] * (s >> bits) + slot - table.start[ids]
        low = np.flatnonzero(s < LOW)
        s[low] = (s[low] << shift) | stream[at : at + len(low)]
        at += len(low)
        state[: len(s)] = s
        out.append(ids)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def decode_from(block: dict, table: Table, point: int) -> np.ndarray:
    """Ids from a block's checkpoint (0 is its start) up to the next one."""
    lanes, every = block["lanes"], block["checkpoint"]
    states, at = block["states"], 0
    if point:
        size = 8 + 8 * lanes
        mark = block["checkpoints"][(point - 1) * size : point * size]
        at, states = int(np.frombuffer(mark[:8], "<u8")[0]), mark[8:]
    return decode(block["words"], states, table, block["tokens"], lanes, point * every, at, (point + 1) * every)


#: Pieces whose ids a worker remembers.
MEMO = 600_000


def _squeezed(ids: np.ndarray, width: int) -> bytes:
    """Ids of a document for the way between two stages: bytes of equal weight side by side."""
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _spread(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    return planes.T.copy().view(f"<u{width}").ravel().astype("<u4")


def tokenized(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, ids) of all documents; one more row per task has `counts` of all its ids instead."""
    width = 2 if size <= 1 << 16 else 4

    def make(batches):
        encode_ids, found = encoder(vocabulary, MEMO), np.zeros(size, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = [np.frombuffer(encode_ids.ids(t) + end, "<u4") for t in texts(batch.column(1))]
                found += np.bincount(np.concatenate(ids), minlength=size)
                rows = pa.array([_squeezed(i, width) for i in ids], pa.binary())
                nothing = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, nothing], ["doc_id", "ids", "counts"])
        seen = np.flatnonzero(found)
        both = np.stack([seen, found[seen]]).astype("<i8").tobytes()
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([both], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "counts"])

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(make, "doc_id long, ids binary, counts binary")


def counted(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs over all documents (`size` numbers), from the tasks' counts."""

    def unpack(batches):
        for batch in batches:
            for raw in batch.column(0):
                ids, n = np.frombuffer(raw.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "n": pa.array(n)})

    rows = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(unpack, "id long, n long")
    counts = np.zeros(size, np.int64)
    for row in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():  # bounded by the vocabulary
        counts[row.id] = row.n
    return counts


def write(docs: DataFrame, vocabulary: str, size: int, end_id: int, path: str, block: int = 1 << 18, lanes: int = 2048, checkpoint: int = 32) -> None:
    """Write the ids of all documents to `path`, in ascending doc_id order.

    Texts are tokenized once: the ids go to the shared folder while they are counted, and are
    dealt out by doc_id from there. A null text is an empty one, which is the end id alone.
    Rows with a null doc_id come first; the order of rows that share a doc_id depends on
    their ids alone. Other columns are not used.
    """
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenized(docs, vocabulary, size, end_id), "tokens")
    freq = frequencies(counted(tokens, size))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(freq)

    def code(batches):
        table = Table(sent.value)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, ids, lengths, size_ = [], [], [], 0

        def made():
            flat = np.concatenate(ids)
            words, states, marks = encode(flat, table, lanes, checkpoint)
            row = (part, number, before, len(flat), lanes, checkpoint, words, states, marks, crc32(flat), held, lengths)
            return pa.RecordBatch.from_pydict({f.name: pa.array([v], f.type) for f, v in zip(arrow, row, strict=True)})

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _spread(raw.as_py(), width)
                held.append(name)
                ids.append(found)
                lengths.append(len(found))
                size_ += len(found)
                if size_ >= block:
                    yield made()
                    number, before, held, ids, lengths, size_ = number + 1, before + size_, [], [], [], 0
        if held:
            yield made()

    arrow = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("lanes", pa.int32()), ("checkpoint", pa.int32())]
        + [(n, pa.binary()) for n in ("words", "states", "checkpoints")]
        + [("checksum", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
    )
    ordered = tokens.filter("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(code, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.range(1).select(F.lit(freq.astype("<u4").tobytes()).alias("freq")).write.parquet(f"{path}/table")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): one row per document, `start` over all files.

    Raises if a block doesn't match its checksum.
    """
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first().freq, "<u4")
    sent = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written partition, never more than the shuffle that wrote them had
    base = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))

    def decoded(batches):
        table = Table(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["words"], row["states"], table, row["tokens"], row["lanes"]).astype("<u4")
                if crc32(ids) != row["checksum"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} does not match its checksum")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(ends), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "local": pa.array(begins + row["before"], pa.int64()),
                        "n_tokens": pa.array(row["lengths"], pa.int64()),
                        "ids": pa.array([ids[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary()),
                    }
                )

    found = blocks.mapInArrow(decoded, "part int, doc_id long, local long, n_tokens long, ids binary")
    located = found.join(F.broadcast(base), "part")
    return located.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def new_path(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/ids-{uuid.uuid4().hex}"
