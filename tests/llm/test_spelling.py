"""op13 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tracemill.llm import queries as q
from tracemill.llm import spelling_bits as sb

from .conftest import SF, frame

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def neighbours(word, letters):
    """All strings exactly one edit away, spelt out."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + c + word[i + 1 :] for c in letters} | {word[:i] + word[i + 1 :]}
    return out - {word}


def brute(docs, shortest=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{low}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= 3}
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)]
    near = {w: [v for v in neighbours(w, letters) if v in words] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            top = min(found, key=lambda v: (-words[v], v))
            if words[top] >= 2 * words[w]:
                form[w] = top
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows, key=repr)


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def dense_docs(seed, n_docs=60):
    """Few letters and lengths, so that most words have near ones."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 7))) for _ in range(400)]
    stems += ["prefix" + s for s in stems[:100]] + [s + "suffix" for s in stems[:100]] + ["a" * k for k in range(3, 12)]
    docs = []
    for i in range(n_docs):
        words = [rng.choice(stems[: rng.choice([5, 50, len(stems)])]) for _ in range(400)]
        docs.append((i, rng.choice([" ", ", ", "1", "Ā"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return docs


@pytest.mark.parametrize("tile", [2048, 16])
def test_dense_vocabulary(spark, monkeypatch, tile):
    monkeypatch.setattr(sb, "TILE", tile)
    monkeypatch.setattr(sb, "STRIPE", 7 if tile == 16 else 512)
    docs = dense_docs(tile)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert sum(r[4] for r in want) > 1000 and any(r[1] != r[2] for r in want)
    assert result(sb.variants(df)) == want


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    extra = [(20, "ÉtÉs ") , (21, ("x" * 5000 + " ") * 3 + ("x" * 5001 + " ") * 7), (22, "naïve naïvE NAIVE×÷ " * 5)]
    more = spark.createDataFrame([(i, t, "x", "y", 1, None, 7) for i, t in extra], odd_docs.schema)
    assert result(sb.variants(odd_docs.union(more))) == brute(rows + extra)


def test_tiny_tables(spark, no_docs):
    assert result(sb.variants(no_docs)) == []
    one = spark.createDataFrame([(1, "hello hello hello hallo"), (1, "hello")], "doc_id long, text string")
    assert result(sb.variants(one)) == brute([(1, "hello hello hello hallo"), (1, "hello")])


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in frame(spark, "documents").collect()]
    assert result(q.op13_spelling_bits(spark, SF)) == brute(rows)
