"""BPE encoding with content-defined chunks, and decoding.

A rolling hash over the bytes cuts every text where its content says so, so that documents
with the same passage get the same chunks. Chunks are counted over all documents by their
hashes; the most frequent ones are encoded once and sent to every task, any other chunk is
encoded once per task that meets it again while it is remembered. The ids inside a chunk are
kept between its first and last place that no token can span; the text between the last such
place of one chunk and the first of the next is encoded anew, over as many chunks as it takes,
so the joined ids are those of the whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import utf8
from tracemill.llm.tokens import _CUT, _byte_letters, encoder, tokenizer

WINDOW = 16
SMALLEST = 64
AVERAGE_BITS = 9
#: Chunks sent to every task: at most so many, none longer than so many bytes.
SENT, SENT_BYTES = 4096, 4096


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, never inside a character; the last is its length."""
    n = len(raw)
    if n < 2 * SMALLEST:
        return [n]
    words = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xD6E8FEB86659FD93)
    places = np.flatnonzero(h >> np.uint64(64 - AVERAGE_BITS) == 0) + WINDOW
    data = np.frombuffer(raw, np.uint8)
    out, last = [], 0
    for p in places.tolist():
        if p - last >= SMALLEST and n - p >= SMALLEST:
            while data[p] & 0xC0 == 0x80:
                p += 1
            out.append(p)
            last = p
    return [*out, n]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def safe_places(text: str) -> tuple[int, int] | None:
    """The first and the last place in a text that no token spans, whatever surrounds it."""
    first = _CUT.search(text)
    if first is None:
        return None
    p = text.rfind(" ")
    while text[p - 1].isspace():
        p = text.rfind(" ", 0, p)
    return first.start(), p


class ChunkEncoder:
    """Encodes texts chunk by chunk; remembers up to `limit` bytes of chunks."""

    def __init__(self, vocabulary: str, sent: dict[bytes, tuple] | None = None, limit: int = 16 << 20):
        self.ids, self.sent, self.limit = encoder(vocabulary).ids, sent or {}, limit
        self.known: dict[bytes, tuple] = {}
        self.size = 0

    def part(self, chunk: bytes) -> tuple:
        """(head, ids between, tail), or (text,) for a chunk that has no safe place."""
        found = self.sent.get(chunk) or self.known.get(chunk)
        if found is None:
            text = chunk.decode()
            safe = safe_places(text)
            found = (text,) if safe is None else (text[: safe[0]], self.ids(text[safe[0] : safe[1]]), text[safe[1] :])
            self.size += 3 * len(chunk)
            if self.size > self.limit:
                self.known, self.size = {}, 3 * len(chunk)
            self.known[chunk] = found
        return found

    def encode(self, raw: bytes) -> bytes:
        out, pending = [], ""
        for chunk in chunks(raw):
            part = self.part(chunk)
            if len(part) == 1:
                pending += part[0]
            else:
                out += [self.ids(pending + part[0]), part[1]]
                pending = part[2]
        out.append(self.ids(pending))
        return b"".join(out)


@lru_cache(maxsize=4)
def spellings(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    byte_of = {letter: b for b, letter in _byte_letters().items()}
    vocabulary = tokenizer(path).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in byte_of for c in token)
        out[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return out


def frequent(docs: DataFrame, vocabulary: str, most: int = SENT) -> dict[bytes, tuple]:
    """The chunks that most documents share, encoded; found over all documents."""

    def hashes(batches):
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(c) for raw in utf8(batch.column(0)) for c in set(chunks(raw))]
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.array(found, np.uint64).view(np.int64))})

    shared = docs.select("text").mapInArrow(hashes, "h long").groupBy("h").count().filter("count > 1")
    wanted = {r.h for r in shared.orderBy(F.desc("count"), "h").limit(most).collect()}
    if not wanted:
        return {}

    def encoded(batches):
        own, seen = ChunkEncoder(vocabulary), set()
        for batch in batches:
            rows = []
            for raw in utf8(batch.column(0)):
                for c in chunks(raw):
                    h = xxhash.xxh3_64_intdigest(c)
                    h = h - (1 << 64) if h >> 63 else h
                    if h in wanted and h not in seen and len(c) <= SENT_BYTES:
                        seen.add(h)
                        rows.append((h, c))
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.binary())}
            )
        del own

    texts = docs.select("text").mapInArrow(encoded, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk"))

    def parts(batches):
        own = ChunkEncoder(vocabulary)
        for batch in batches:
            made = [own.part(bytes(c.as_py())) for c in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": batch.column(1),
                    "head": pa.array([m[0] for m in made], pa.string()),
                    "ids": pa.array([m[1] if len(m) > 1 else None for m in made], pa.binary()),
                    "tail": pa.array([m[2] if len(m) > 1 else None for m in made], pa.string()),
                }
            )

    rows = texts.mapInArrow(parts, "chunk binary, head string, ids binary, tail string").collect()  # at most `most`
    return {bytes(r.chunk): (r.head,) if r.ids is None else (r.head, bytes(r.ids), r.tail) for r in rows}


def encoded(docs: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): one row per row of `docs`.

    A null text is an empty one. `decoded` is the text that the ids spell (null unless asked
    for). Special tokens in a text are read as such. Other columns are not used.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        own, spelled = ChunkEncoder(vocabulary, sent.value), spellings(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [np.frombuffer(own.encode(raw), "<i4") for raw in utf8(batch.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids), pa.int32())
                back = [b"".join(map(spelled.__getitem__, i.tolist())).decode(errors="replace") if decode else None for i in ids]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets), flat),
                        "decoded": pa.array(back, pa.string()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")
