"""op12 against a plain calculation of targets and streams."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from fractions import Fraction

import compare
import pytest

from tracemill.llm import queries as q
from tracemill.llm import source_schedule as ss

from .conftest import SF, frame

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "source", "copy"]
SCHEMA = "doc_id long, source string, text string, number int, slot string, size string, copy int, block double"


def water_filled(sizes):
    """Targets by resharing until none is above, in exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, free, whole = {}, set(order), sum(sizes.values())
    while free:
        left, w = whole - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: Fraction(left * weight[s], w) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
    return fixed


def check(docs, df):
    rows = df.collect()
    assert df.columns == COLUMNS
    size = Counter()
    for i, s, text in docs:
        size[(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))] += 1
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == size
    per = defaultdict(int)
    for (_, s, n), k in size.items():
        per[s] += n * k
    want, got = water_filled(per), defaultdict(int)
    for r in rows:
        assert r.source_size == per[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        got[r.source] += r.taken
    for s, t in want.items():
        assert abs(got[s] - t) <= Fraction(1, 2) + Fraction(1, 10**6)
    return rows


def frame_of(spark, docs):
    return spark.createDataFrame([(i, s, t, 1, "x", "y", 2, 0.5) for i, s, t in docs], SCHEMA).repartition(3)


DOCS = (
    [(i, "hot", f"word{i} " * (i % 9)) for i in range(300)]
    + [(i, "tiny", "one two\tthree") for i in range(300, 303)]
    + [(400, "none", " \n "), (401, None, "a b c d"), (402, "", "x y z"), (403, "", "p q"), (404, "\U0001f600", "r s"), (405, "hot", None)]
    + [(None, "hot", "lost id"), (None, None, None), (7, "hot", "w " * 5000), (7, "hot", "w " * 5000), (7, "tiny", "w")]
)


@pytest.mark.parametrize("block", [1, 16, 128, 10**6])
def test_targets_and_limits(spark, block):
    check(DOCS, ss.taken(frame_of(spark, DOCS), block=block))


def test_reruns_and_blocks_agree(spark):
    first = sorted(map(tuple, ss.taken(frame_of(spark, DOCS), block=16).collect()), key=repr)
    again = sorted(map(tuple, ss.taken(frame_of(spark, DOCS[::-1]).repartition(7), block=50).collect()), key=repr)
    assert first == again


@pytest.mark.parametrize("docs", [[], [(1, "a", None)], [(1, "a", "one")], [(1, None, "a b"), (2, "z", "")]])
def test_tiny_tables(spark, docs):
    check(docs, ss.taken(frame_of(spark, docs)))


def test_schedule_is_whole_and_spread(spark):
    docs = [(i, f"s{i % 5}", " ".join(f"d{i}w{k}" for k in range(i % 40))) for i in range(400)]
    df = frame_of(spark, docs)
    mixed = ss.mix(df, block=8)
    words = {r.number: (r.words, r.target) for r in mixed.sources.collect()}
    slots = defaultdict(int)
    for r in mixed.pieces.collect():
        slots[(r.slot, r.number)] += r.n_words
    assert len({s for s, _ in slots}) == len(slots) and max(slots.values()) == 8
    # every stretch of the mix holds its share of each source, to a few blocks
    whole = sum(t for _, t in words.values())
    ordered, had = sorted(slots), defaultdict(int)
    for at, key in enumerate(ordered, 1):
        had[key[1]] += slots[key]
        if at % 50 == 0 and at < len(ordered) * 0.9:
            for n, (_, t) in words.items():
                assert abs(had[n] - t / whole * sum(had.values())) <= 5 * 8
    # the words of the pieces are those of the documents
    text = {i: t.split() for i, _, t in docs}
    given = defaultdict(list)
    for r in ss.texts(df, mixed).collect():
        given[(r.slot, r.doc_id)].append(r.text)
    for r in mixed.pieces.collect():
        assert " ".join(text[r.doc_id][r.first_word : r.first_word + r.n_words]) in given[(r.slot, r.doc_id)]


def test_no_python_on_the_main_path(spark):
    plan = ss.taken(frame(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_query_equals_sql_and_limits(spark):
    docs = [(r.doc_id, r.source, r.text) for r in frame(spark, "documents").collect()]
    check(docs, q.op12_source_schedule(spark, SF))


@pytest.mark.parametrize("name", ["op11_lookup_clusters", "op12_source_schedule"])
def test_sql(spark, name):
    sf = os.path.join(compare.DATA, "sf0.01")
    assert compare.difference(spark, compare.database(sf), q.QUERIES[name], q.ORACLES[name], sf) is None
