"""op2 against brute force, and the run-length index alone."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracemill.llm import queries as q
from tracemill.llm import repeated_spans
from tracemill.llm.run_index import RunIndex

from .conftest import SF, TEXTS, frame


def brute(docs, span=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        if i is not None:
            for s in range(len(raw) - span + 1):
                w = raw[s : s + span]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if i is not None:
            for s in range(len(raw) - span + 1):
                if first[raw[s : s + span]] < i:
                    gone[s : s + span] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in frame(spark, "documents").collect()]
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    assert Counter(tuple(r) for r in q.op2_run_index(spark, SF).collect()) == want


def copies():
    """Passages that many documents share, with edits, in every order."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(6, 50))) for _ in range(12)]
    docs = list(TEXTS)
    for i in rng.sample(range(100, 400), 200):
        parts = []
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(passages)
            if rng.random() < 0.5:
                cut = rng.randrange(len(text))
                text = text[:cut] + word() + text[cut + rng.randint(0, 9) :]
            parts += [" ".join(word() for _ in range(rng.randint(0, 9))), text]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize(("crowd", "flush"), [(4096, 8 << 20), (3, 1 << 12), (0, 1 << 12)])
def test_shared_passages(spark, crowd, flush, monkeypatch):
    monkeypatch.setattr(repeated_spans, "FLUSH", flush)
    docs = copies()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, known string, key int").repartition(5)
    found = repeated_spans.cleaned(table, crowd=crowd).collect()
    got = Counter()
    for r in found:
        raw = (r.text or "").encode()
        got[(r.doc_id, len(raw), len(raw) - len(r["_kept"]), len(r["_runs"]), hashlib.sha256(r["_kept"]).hexdigest())] += 1
        assert sum(x.end - x.begin for x in r["_runs"]) == len(raw) - len(r["_kept"])
    assert got == brute(docs)


def test_empty_tables_and_columns(spark, odd_docs, no_docs):
    assert repeated_spans.cleaned(no_docs).count() == 0
    left = repeated_spans.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter(i for i, _ in TEXTS) - Counter([1])


def test_index_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        span, letters = rng.choice([8, 10, 17, 20]), rng.choice(["ab", "abc", "abcdefgh"])
        base = "".join(rng.choices(letters, k=60))

        def text(base=base, letters=letters):
            made = list(base[rng.randint(0, 30) :][: rng.randint(1, 45)])
            for _ in range(rng.randint(0, 3)):
                made[rng.randrange(len(made))] = rng.choice(letters + "z")
            return "".join(made).encode()

        texts, queries = [[text() for _ in range(rng.randint(1, 12))] for _ in range(2)]
        numbers, below = (np.array([rng.randint(0, 9) for _ in x]) for x in (texts, queries))
        got = RunIndex(texts, numbers, span).matches(queries, below)
        for query, b, g in zip(queries, below, got, strict=True):
            want = [s for s in range(len(query) - span + 1) if any(n < b and query[s : s + span] in t for t, n in zip(texts, numbers, strict=True))]
            assert g.tolist() == want
