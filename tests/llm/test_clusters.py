"""op11 against brute force."""

from __future__ import annotations

import hashlib
import math

import pytest

from tracemill.llm import lookup_clusters as lc
from tracemill.llm import queries as q

from .conftest import SF, frame

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, ids int, v string"


def brute(rows, dims=64, k=16):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(64 * float(x)) for x in v]))
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in start[:k]]
    if not centroids:
        return []

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        return out

    for _ in range(3):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = assign()
    per = {n: sum(d for d, m in found if m == n) for n in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, per[n], sum(per.values()), names[n]) for (i, _), (d, n) in zip(kept, found, strict=True)]


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows():
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        base = [math.sin(i % 7 + d) for d in range(64)]
        rows.append((i, [b + rng.gauss(0, 0.1 + i % 3) for b in base]))
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies
    rows += [
        (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (301, None), (302, []), (303, [1.0] * 63),
        (304, [1.0] * 65), (305, [None] + [1.0] * 63), (306, [float("nan")] * 64), (307, [float("-inf")] + [0.0] * 63),
        (308, [0.0] * 64), (309, [-0.0] * 64), (310, [1e5] * 64), (311, [-1e5, 3.0] * 32),
    ]
    # as the table stores them
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_equals_brute_force_on_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], SCHEMA).repartition(3)
    assert result(lc.clusters_with_inertia(df)) == sorted(brute(rows), key=repr)


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], SCHEMA).repartition(2)
    whole = result(lc.clusters_with_inertia(df))
    monkeypatch.setattr(lc, "BLOCK", 7)
    assert result(lc.clusters_with_inertia(df)) == whole


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 64)], [(7, [0.5] * 64)], [(7, [0.5] * 64)] * 3])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], SCHEMA)
    assert result(lc.clusters_with_inertia(df)) == sorted(brute(rows), key=repr)


def test_components_beyond_a_long_take_no_part(spark):
    rows = [(1, [1e30] + [0.0] * 63), (2, [0.0] * 64), (3, [1.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], SCHEMA)
    assert result(lc.clusters_with_inertia(df)) == sorted(brute(rows[1:]), key=repr)


def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in frame(spark, "embeddings").collect()]
    assert result(q.op11_lookup_clusters(spark, SF)) == sorted(brute(rows), key=repr)
