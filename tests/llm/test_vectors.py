"""op1 and op6 against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import exact_topk, rotation_codes
from tracemill.llm import queries as q

from .conftest import SF, frame

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, n int, q int"


def brute_links(rows, threshold=0.98):
    fit = [
        (i, np.array(v, float), lab)
        for i, v, lab in rows
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    parent, n = {}, {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _, _ in fit:
        parent[i], n[i] = i, 0
    for a in range(len(fit)):
        for b in range(a):
            (i, v, lv), (j, w, lw) = fit[a], fit[b]
            if i != j and lv == lw and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (n.get(i, 0), top(i) if i in parent else i) for i, _, _ in rows if i is not None}


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = rng.standard_normal(16)
        for k in range(9):
            v = base + rng.standard_normal(16) * 0.05 * k
            rows.append((g * 20 + k, [float(x) for x in v], g % 3))
    rows += [
        (300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] + [1.0] * 15, 1),
        (305, [float("inf")] * 16, 0), (306, [1.0] * 16, None), (307, [1.0], 2), (308, [2.0], 2), (309, [-1.0], 2),
        (0, rows[0][1], 0), (400, rows[0][1], 0), (401, rows[0][1], 1),
    ]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_match_brute_force(spark, block):
    rows = odd_vectors()
    single = [tuple(None if x is None else x for x in r) for r in rows]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in single]
    want = brute_links(as_float)
    got = rotation_codes.near_duplicates(table_of(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def test_links_of_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in frame(spark, "embeddings").collect()]
    want = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.op1_rotation_codes(spark, SF).collect()}
    assert got == want


def test_no_vectors_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rotation_codes.near_duplicates(empty).count() == 0
    assert exact_topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0], 1, "c", 1, 2)] * 2, SCHEMA)
    assert [tuple(r) for r in rotation_codes.near_duplicates(nulls).collect()] == [(None, 0, None, True)] * 2


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes, factors = rotation_codes.encode(v)
    signs = np.unpackbits(codes, axis=1).astype(float) * 2 - 1
    estimate = signs @ (v @ rotation_codes.rotation(64).T).T / 8 / factors[:, None]
    error = estimate - v @ v.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.002
    sine = np.sqrt(np.maximum(0, 1 - (v @ v.T) ** 2))
    assert (np.abs(error) <= rotation_codes.error_scale(factors, 64, 6.0)[:, None] * sine + 1e-9)[off].all()


def brute_topk(rows, asks, k=5):
    fit = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fit if asks(i)}):
        mine = next(v for j, v in fit if j == i)
        scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), j) for j, v in fit if j != i and len(v) == len(mine))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_search_of_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in frame(spark, "embeddings").collect()]
    got = sorted(tuple(r) for r in q.op6_exact_topk(spark, SF).collect())
    assert got == brute_topk(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("shard", [4096, 2])
def test_search_with_ties_and_odd_rows(spark, shard):
    rows = [(i, [float(i % 4), 1.0, -0.5], 0) for i in range(90)] + [r for r in odd_vectors() if r[0] >= 300 and r[0] < 309]
    got = sorted(tuple(r) for r in exact_topk.search(table_of(spark, rows), F.col("vec_id") % 50 == 0, shard=shard, query_block=1).collect())
    assert got == brute_topk(rows, lambda i: i % 50 == 0)


def test_products_beyond_doubles():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**31, 3.0]])
    assert exact_topk.products(a, b).tolist() == [[2**60 + 1, 2**61 + 3]]
