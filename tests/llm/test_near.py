"""Near-duplicates of the pipeline: exact similarity on both sides of the limit, bounded tiles."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import links, simhash_tiles

from .test_pipeline import jaccard

#: Shingles of a text, how many of its last words are changed, and how many left out.
CASES = [(90, 10, 0), (90, 11, 0), (500, 55, 0), (500, 56, 0), (9, 1, 0), (5, 0, 1), (6, 0, 1), (10, 0, 2), (2, 0, 1), (3, 1, 0), (120, 0, 24), (160, 0, 32), (160, 0, 33)]


def text_pairs(rng, repeats):
    for shingles, changed, out in CASES:
        for _ in range(repeats):
            words = [f"w{i}" for i in rng.choice(10**9, shingles + 4)]
            yield " ".join(words), " ".join(words[: len(words) - changed - out] + [f"x{i}" for i in rng.choice(10**9, changed)])


def test_links_are_exact_on_both_sides_of_the_limit(spark):
    rows, want = [], []
    for n, (a, b) in enumerate(text_pairs(np.random.default_rng(11), 25)):
        rows += [(2 * n, a), (2 * n + 1, b)]
        want += [2 * n] + [2 * n + 1] * (jaccard(a, b) < 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(r.doc_id for r in simhash_tiles.representatives(docs).collect()) == Counter(want)


def test_chains_repeated_and_null_keys(spark):
    words = [f"w{i}" for i in range(94)]
    step = lambda k: " ".join(words[k * 7 :] + [f"x{i}" for i in range(k * 7)])
    assert jaccard(step(0), step(1)) >= 0.8 > jaccard(step(0), step(2))
    rows = [(5, step(0)), (None, step(1)), (6, step(2)), (8, "alone and short"), (8, step(3)), (9, "alone and short"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(r.doc_id for r in simhash_tiles.representatives(docs).collect())
    assert kept == Counter([5, None, 3])


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_blocks_of_one_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_tiles, "BLOCK", block)
    rng = np.random.default_rng(12)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(60):
        mine = list(words)
        for at in rng.choice(150, i % 8, replace=False):
            mine[at] = f"y{i}_{at}"
        rows.append((i, " ".join(mine)))
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if label[i] != label[j] and jaccard(a, b) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash_tiles.representatives(docs).collect()} == set(label.values())


def test_tiles_hold_the_pairs_of_one_stripe():
    rng = np.random.default_rng(13)
    rows = np.repeat(rng.integers(0, 2**64, (1, 4), dtype=np.uint64), 6000, axis=0)
    rows[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64)
    rows[-1] = ~rows[-1]
    both = np.arange(len(rows))
    tracemalloc.start()
    root = simhash_tiles._forest(rows, both, both, 44)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert root.tolist() == [0] * 5999 + [5999]
    assert peak < 100e6  # 36 million pairs would take 576 MB
    apart = simhash_tiles._forest(rows, both[:3000], both[3000:], 44)
    assert apart.tolist() == root.tolist()


def test_roots_in_parts():
    rng = np.random.default_rng(14)
    a, b = rng.integers(0, 300, (2, 260))
    parent = None
    for at in range(0, 260, 20):
        parent = links.roots(300, a[at : at + 20], b[at : at + 20], parent)
    assert parent.tolist() == links.roots(300, a, b).tolist()


def tile_of(texts, **columns):
    """A tile as the exact comparison gets it, of five-word shingles."""
    sets = [np.unique(simhash_tiles.shingle_hashes(t.encode(), 5)) for t in texts]
    words = prints(sets)
    made = {f"w{i}": words[:, i].view(np.int64) for i in range(4)}
    given = {"side": [2] * len(sets), "half": [2] * len(sets), "label": list(range(len(sets)))} | columns
    return pa.table(given | made | {"ids": [x.tobytes() for x in sets]})


def prints(sets):
    made = lambda h, i: np.concatenate([simhash_tiles._mixed(h, i), simhash_tiles._mixed(h[: (len(h) + 1) % 2], 4 + i)])
    return np.array([[simhash_tiles.majority(made(h, i)) for i in range(4)] for h in sets], np.int64).view(np.uint64)


def test_similar_sets_of_a_tile():
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[s : s + 40]) for s in (0, 3, 6)] + ["none of these words at all"]
    pairs = lambda **columns: {frozenset(x) for x in zip(*simhash_tiles.similar_sets(tile_of(texts, **columns), 0.8, 4)[:2], strict=True)}
    assert pairs() == {frozenset((0, 1)), frozenset((1, 2))}
    assert pairs(side=[0, 1, 1, 0]) == pairs(half=[0, 1, 1, 0]) == pairs(label=[0, 1, 1, 2]) == {frozenset((0, 1))}


def test_fingerprints_find_what_is_as_similar():
    rng = np.random.default_rng(15)
    for size in (4, 5, 6, 7, 10, 21, 64, 128, 129, 700):
        splits = [(size - x, x, int((size - x) / 0.8 + 1e-9) - size) for x in range(size)]
        splits = [s for s in splits if s[2] >= max(1, s[1])]
        sets = []
        for _ in range(300):
            common, one, two = splits[rng.integers(len(splits))]
            h = rng.integers(0, 2**64, common + one + two, dtype=np.uint64)
            sets += [np.sort(h[: common + one]), np.sort(np.concatenate([h[:common], h[common + one :]]))]
        sizes = np.array([len(x) for x in sets])
        both = np.arange(len(sets))
        met = [frozenset(p) for a, b in simhash_tiles.close_pairs(prints(sets), sizes, both, both, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(met) == len(set(met))
        assert sum(frozenset((i, i + 1)) in set(met) for i in range(0, len(sets), 2)) >= 299
        half = both % 2
        apart = [frozenset(p) for a, b in simhash_tiles.close_pairs(prints(sets), sizes, both[half == 0], both[half == 1], 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert Counter(apart) == Counter(p for p in met if sum(p) % 2)


@pytest.mark.parametrize("n", [500, 2000])
def test_a_passage_that_many_quote_compares_next_to_nothing(n):
    rng = np.random.default_rng(16)
    draw = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 10**9, k))
    passage = draw(30)
    texts = [f"{draw(30)} {passage} {draw(30)}" for _ in range(n)]
    a, _, compared = simhash_tiles.similar_sets(tile_of(texts), 0.8, 4)
    assert not len(a) and compared <= n * (n - 1) / 2 * 1e-4


def test_a_passage_that_many_quote_brings_no_texts_together(spark):
    rng = np.random.default_rng(17)
    draw = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 10**9, k))
    passage = draw(30)
    rows = [(i, f"{draw(30)} {passage} {draw(30)}") for i in range(1500)] + [(i, f"{draw(20)} {passage}") for i in range(1500, 1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = simhash_tiles.sketches(docs, 5, 4, "doc_id", "text").withColumnRenamed("doc_id", "_first")
    assert simhash_tiles.candidates(made, 4, 0.8).filter("_first < 1500").count() < 150
    assert simhash_tiles.representatives(docs).count() == 1700


def test_weighted_tiles(spark):
    rows = spark.range(40).select("id", F.lit(7).cast("long").alias("c"), F.lit(10).alias("w"))
    tiles = links.tiled(rows, "c", [0], 100, ["id"], F.col("w"))
    assert tiles.select("tile").distinct().count() > 6
    meet = tiles.alias("x").join(tiles.alias("y"), "tile").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    assert meet.count() == 1600
