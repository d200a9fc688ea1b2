"""Removal of long passages that an earlier document has too, with run-length indexes.

Which windows of `span` bytes also start in a document with a smaller id is decided exactly:

1. Anchors. In every window the 20-byte strings with the least hash are its anchors, so equal
   windows have equal anchors. Anchors are gathered by hash with a hash of their context (all
   bytes of the windows around them). An occurrence whose context a smaller document has too
   is covered at once. Of each other context, only the smallest document goes on, and only if
   its anchor occurs in different contexts of several documents.
2. Index. The contexts that go on meet in buckets of anchors. A bucket builds a run-length
   index of those that a later document might repeat, and streams the others' matching
   statistics through it; every match of `span` bytes in a smaller document is marked.
   Anchors with more than `crowd` contexts (a passage that very many documents quote) don't
   share a bucket: their windows are compared by hash, wherever they are.
3. The marks of a document are gathered, and its text is cut.

Tasks resolve repeats among their own documents first, so that a passage in a third of all
rows sends one row per task. The texts are shuffled once, by document id, for steps 1 and 3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import utf8
from tracemill.llm.run_index import RunIndex

GRAM = 20
FLUSH = 4 << 20
FULL, FINE, CROWDED = 1, 2, 3
PACKED = "key int, kind int, a binary, b binary, c binary, d binary, e binary"
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """`op` (minimum or maximum) over every `width` neighbours."""
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:n], x[width - size : width - size + n])


def anchors(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text of `span` bytes or more."""
    n, width = len(raw) - GRAM + 1, span - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = words[:n] * _U(0x9E3779B97F4A7C15) ^ words[8 : 8 + n] * _U(0xC2B2AE3D27D4EB4F)
    h = _mix(_mix(h) + (words[12 : 12 + n] >> _U(32)) * _U(0x165667B19E3779F9))
    least = _slide(np.minimum, h, width)
    edge = np.zeros(width - 1, _U)
    chosen = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), width) == h)
    return chosen, h[chosen]


def contexts(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, context hashes, and the begin and end of each context."""
    at, h = anchors(raw, span)
    begin, end = np.maximum(0, at - (span - GRAM)), np.minimum(len(raw), at + span)
    digest = xxhash.xxh3_64_intdigest
    found = [digest(raw[b:e], p) for b, e, p in zip(begin.tolist(), end.tolist(), (at - begin).tolist(), strict=True)]
    return h.view(np.int64), np.array(found, _U).view(np.int64), begin, end


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns, as a mask."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    columns = list(zip(*rows, strict=True)) or [()] * 7
    raw = [[v.tobytes() if isinstance(v, np.ndarray) else v for v in c] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(raw, kinds, strict=True)], list("key kind a b c d e".split()))


def _by_key(key: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
    """Rows of arrays, one for each key."""
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(_starts(key[order]))
    parts = [np.split(c[order], ends[1:]) for c in columns]
    none = (b"",) * (5 - len(columns))
    return [(int(k), kind, *p, *none) for k, *p in zip(key[order][ends], *parts, strict=True)] if len(key) else []


def _of_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(docs.view(_U)) % _U(buckets)).astype(np.int64)


def _gather(batches, places, fn):
    """`fn` over lists of (id, bytes, ...) of about `FLUSH` bytes, across batches; no nulls."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in places]
        fine = pa.array(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]))
        doc, text, *rest = (c.filter(fine) for c in columns)
        for row in zip(doc.to_pylist(), utf8(text), *(c.to_pylist() for c in rest), strict=True):
            held.append(row)
            size += len(row[1]) + 64
            if size >= FLUSH:
                yield _packed(fn(held))
                held, size = [], 0
    if held:
        yield _packed(fn(held))


def _first_pass(docs: DataFrame, span: int, buckets: int, crowd: int) -> DataFrame:
    """Anchors by bucket (kind 0), crowded anchors (1), and what a task could decide (2)."""

    def make(held):
        parts = []
        for doc, raw in held:
            if len(raw) >= span:
                ha, hc, _, _ = contexts(raw, span)
                pick = np.unique(np.stack([ha, hc], axis=1), axis=0)
                parts.append((pick[:, 0], pick[:, 1], np.full(len(pick), doc, np.int64)))
        if not parts:
            return []
        ha, hc, doc = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((doc, hc, ha))
        ha, hc, doc = ha[order], hc[order], doc[order]
        first = _starts(ha, hc)
        smallest = doc[first][np.cumsum(first) - 1]
        full = doc > smallest
        group = np.cumsum(_starts(ha)) - 1
        many = np.bincount(group[first], minlength=group[-1] + 1) > crowd
        crowded = many[group] & ~full
        sent = ~full & ~crowded & first
        key = lambda h: (_mix(h.view(_U)) % _U(buckets)).astype(np.int64)
        # in its bucket 32 bits tell an anchor well enough: more contexts met can't change a result
        short = lambda h: (_mix(h.view(_U)) >> _U(32)).astype("<u4")
        rows = _by_key(key(ha[sent]), 0, short(ha[sent]), hc[sent], doc[sent])
        lead = crowded & _starts(ha)
        rows += _by_key(key(ha[lead]), 1, short(ha[lead]))
        told = full | crowded
        state = np.where(full, FULL, CROWDED).astype(np.int8)[told]
        return rows + _by_key(_of_doc(doc[told], buckets), 2, hc[told], doc[told], state)

    return docs.mapInArrow(lambda batches: _gather(batches, (0, 1), make), PACKED)


def _numbers(table: pa.Table, kind: int, column: str, dtype="<i8") -> np.ndarray:
    chosen = table.filter(pa.compute.equal(table["kind"], kind))[column]
    return np.frombuffer(b"".join(chosen.to_pylist()), dtype)


def _replies(first: DataFrame, crowd: int) -> DataFrame:
    """(doc_id, _known): context hashes of a document with what becomes of them."""

    def decide(table: pa.Table) -> pa.Table:
        ha, hc, doc = _numbers(table, 0, "a", "<u4"), _numbers(table, 0, "b"), _numbers(table, 0, "c")
        order = np.lexsort((doc, hc, ha))
        ha, hc, doc = ha[order], hc[order], doc[order]
        group_at, class_at = _starts(ha), _starts(ha, hc)
        group = np.cumsum(group_at) - 1
        full = doc > doc[class_at][np.cumsum(class_at) - 1] if len(doc) else np.zeros(0, bool)
        classes = np.bincount(group[class_at]) if len(doc) else np.zeros(0, np.int64)
        at = np.flatnonzero(group_at)
        several = np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        marked = np.isin(ha[at], _numbers(table, 1, "a", "<u4"))
        fate = np.where(marked | (classes > crowd), CROWDED, np.where((classes > 1) & several, FINE, 0))
        state = np.where(full, FULL, fate[group]).astype(np.int8) if len(doc) else np.zeros(0, np.int8)
        keep = state > 0
        hc = np.concatenate([hc[keep], _numbers(table, 2, "a")])
        doc = np.concatenate([doc[keep], _numbers(table, 2, "b")])
        state = np.concatenate([state[keep], _numbers(table, 2, "c", np.int8)])
        order = np.argsort(doc, kind="stable")
        ends = np.flatnonzero(_starts(doc[order]))
        pack = lambda c: [p.tobytes() for p in np.split(c[order], ends[1:])] if len(ends) else []
        return pa.table({"doc_id": doc[order][ends], "h": pa.array(pack(hc), pa.binary()), "s": pa.array(pack(state), pa.binary())})

    told = first.groupBy("key").applyInArrow(decide, "doc_id long, h binary, s binary")
    return told.groupBy("doc_id").agg(F.collect_list(F.struct("h", "s")).alias("_known"))


def _second_pass(docs: DataFrame, span: int, buckets: int) -> DataFrame:
    """From doc_id, text and _known: spans (kind 0), contexts (1) and crowded windows (2)."""
    places = [docs.columns.index(c) for c in ("doc_id", "text", "_known")]

    def make(held):
        spans, near, crowded = [], [], []
        for doc, raw, known in held:
            hashes = np.concatenate([np.frombuffer(k["h"], "<i8") for k in known])
            state = np.concatenate([np.frombuffer(k["s"], np.int8) for k in known])
            order = np.argsort(hashes)
            hashes, state = hashes[order], state[order]
            ha, hc, begin, end = contexts(raw, span)
            slot = np.minimum(np.searchsorted(hashes, hc), len(hashes) - 1)
            found = np.where(hashes[slot] == hc, state[slot], 0)
            one = np.flatnonzero(found == FULL)
            spans.append((np.full(len(one), doc, np.int64), begin[one], end[one]))
            near += [(ha[i], doc, begin[i], raw[begin[i] : end[i]]) for i in np.flatnonzero(found == FINE)]
            for i in np.flatnonzero(found == CROWDED):
                crowded += [(xxhash.xxh3_64_intdigest(raw[s : s + span]), doc, s) for s in range(begin[i], end[i] - span + 1)]
        rows = []
        if near:
            ha, doc, begin = (np.array(c, np.int64) for c in list(zip(*near, strict=True))[:3])
            key = (_mix(ha.view(_U)) % _U(buckets)).astype(np.int64)
            size = np.array([len(n[3]) for n in near], np.int32)
            order = np.argsort(key, kind="stable")
            for part in np.split(order, np.flatnonzero(_starts(key[order]))[1:]):
                text = b"".join(near[i][3] for i in part)
                rows.append((int(key[part[0]]), 1, ha[part], doc[part], begin[part], size[part], text))
        if crowded:
            h = np.array([c[0] for c in crowded], _U)
            doc, at = (np.array(c, np.int64) for c in list(zip(*crowded, strict=True))[1:])
            order = np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            new = _starts(h)
            least = doc == doc[new][np.cumsum(new) - 1]
            rows += _by_key((_mix(h[least]) % _U(buckets)).astype(np.int64), 2, h[least].view(np.int64), doc[least], at[least])
            spans.append((doc[~least], at[~least], at[~least] + span))
        doc, begin, end = (np.concatenate(c) for c in zip(*spans, strict=True))
        return rows + _by_key(_of_doc(doc, buckets), 0, doc, begin, end)

    return docs.mapInArrow(lambda batches: _gather(batches, places, make), PACKED)


def _index_matches(ha, doc, begin, texts, span):
    """Spans of the contexts that a context of the same bucket and a smaller document has."""
    order = np.argsort(ha, kind="stable")
    at = np.flatnonzero(_starts(ha[order]))
    group = np.empty(len(ha), np.int64)
    group[order] = np.cumsum(_starts(ha[order])) - 1
    low, high = (f.reduceat(doc[order], at)[group] for f in (np.minimum, np.maximum))
    held, asked = np.flatnonzero(doc < high), np.flatnonzero(doc > low)
    if not len(held) or not len(asked):
        return (np.empty(0, np.int64),) * 3
    index = RunIndex([texts[i] for i in held], doc[held], span)
    found = index.matches([texts[i] for i in asked], doc[asked])
    times = np.array([len(f) for f in found])
    starts = np.concatenate(found) + np.repeat(begin[asked], times)
    return np.repeat(doc[asked], times), starts, starts + span


def _marks(second: DataFrame, span: int) -> DataFrame:
    """(doc_id, marks): spans to remove, as arrays of begins and ends."""

    def mark(table: pa.Table) -> pa.Table:
        found = [tuple(_numbers(table, 0, c) for c in "abc")]
        ha, doc, begin = (_numbers(table, 1, c) for c in "abc")
        if len(ha):
            ends = np.cumsum(_numbers(table, 1, "d", "<i4"))
            joined = b"".join(table.filter(pa.compute.equal(table["kind"], 1))["e"].to_pylist())
            texts = [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            found.append(_index_matches(ha, doc, begin, texts, span))
        h, doc, at = (_numbers(table, 2, c) for c in "abc")
        if len(h):
            order = np.lexsort((doc, h))
            h, doc, at = h[order], doc[order], at[order]
            new = _starts(h)
            later = doc > doc[new][np.cumsum(new) - 1]
            found.append((doc[later], at[later], at[later] + span))
        doc, begin, end = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((end, begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        if len(doc):  # join what overlaps within the bucket
            reach = np.maximum.accumulate(end + (np.cumsum(_starts(doc)) << 40))
            open_ = _starts(doc)
            open_[1:] |= (begin[1:] + (np.cumsum(_starts(doc))[1:] << 40)) > reach[:-1]
            ends = np.flatnonzero(open_)
            end = np.maximum.reduceat(end, ends)
            doc, begin = doc[ends], begin[ends]
        cut = np.flatnonzero(_starts(doc))
        both = np.stack([begin, end], axis=1)
        marks = [p.tobytes() for p in np.split(both, cut[1:])] if len(cut) else []
        return pa.table({"doc_id": doc[cut], "marks": pa.array(marks, pa.binary())})

    found = second.groupBy("key").applyInArrow(mark, "doc_id long, marks binary")
    return found.groupBy("doc_id").agg(F.collect_list("marks").alias("_marks"))


def _removed(raw: bytes, marks: list[bytes] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    if not marks:
        return raw, []
    spans = sorted(map(tuple, np.concatenate([np.frombuffer(m, "<i8") for m in marks]).reshape(-1, 2).tolist()))
    runs = [spans[0]]
    for begin, end in spans[1:]:
        if begin <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((begin, end))
    kept = [raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)], strict=True)]
    return b"".join(kept), runs


def _marked(docs: DataFrame, span: int, crowd: int, bucket_bytes: int) -> DataFrame:
    """`docs` with `_marks`, what is to be removed from each text."""
    if span < GRAM + 2:
        raise ValueError(f"span must be {GRAM + 2} or more")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    replies = _replies(_first_pass(plain, span, buckets, crowd), crowd)
    # the same columns, unfiltered, as in the join below: Spark shuffles the texts once for both
    second = _second_pass(docs.join(replies, "doc_id", "left"), span, 4 * buckets)
    return docs.join(_marks(second, span), "doc_id", "left").select(*docs.columns, "_marks")


def _slices(batches, size: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def cleaned(docs: DataFrame, span: int = 50, crowd: int = 4096, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All columns of `docs`, with `_kept` (binary, what is left of the text's UTF-8 bytes) and
    `_runs` (array of begin and end of the removed runs).

    A byte goes if a string of `span` bytes that covers it also starts in a document with a
    smaller doc_id. A null text counts as an empty one. Rows with a null doc_id keep all and
    take nothing from others; rows that share a doc_id are judged against smaller ids only.
    """
    names, place = docs.columns, docs.columns.index("text")
    pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in _slices(batches):
            marks = batch.column(len(names)).to_pylist()
            made = [_removed(raw, m) for raw, m in zip(utf8(batch.column(place)), marks, strict=True)]
            runs = pa.array([[{"begin": a, "end": b} for a, b in r] for _, r in made], pairs)
            columns = [batch.column(i) for i in range(len(names))] + [pa.array([k for k, _ in made], pa.binary()), runs]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_kept", "_runs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{fields}, _kept binary, _runs array<struct<begin: long, end: long>>"
    return _marked(docs, span, crowd, bucket_bytes).mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, span: int = 50, crowd: int = 4096, bucket_bytes: int = 4 << 20) -> DataFrame:
    """`docs` with texts cut as by `cleaned`; bytes of a character that was cut through go too.

    A document of which nothing is left but had text goes; a null text stays null.
    """
    names, place = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in _slices(batches):
            texts, marks = batch.column(place), batch.column(len(names)).to_pylist()
            kept = [_removed(raw, m)[0].decode(errors="ignore") for raw, m in zip(utf8(texts), marks, strict=True)]
            fine = [bool(k) or not t.as_py() for t, k in zip(texts, kept, strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array([k if t.is_valid else None for t, k in zip(texts, kept, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(fine, pa.bool_()))

    return _marked(docs, span, crowd, bucket_bytes).mapInArrow(cut, docs.schema)
