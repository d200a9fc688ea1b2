"""op4, op7, op8, op9 and op10 against brute force and exact round trips."""

from __future__ import annotations

import hashlib
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import ans_files, chunk_bpe, packing, simhash_tiles, tokens, toxicity
from tracemill.llm import queries as q

from .conftest import SF, TEXTS, frame

BYTES, WORDS = tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("word_bpe_49k.json")
ALPHABET = st.sampled_from(
    ["a", "The", "word", " ", "  ", ".", ",", "\n", "\n\n", "\t", "é", "İ", "ß", "Σ", "'s", "_", "1", "23", "<|endoftext|>", "́", "\xa0", "中", "!", "\x1c", "\x01", "​", "😀"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=14).map("".join))
def test_pieces_spell_the_same_ids(text):
    for path in (BYTES, WORDS):
        want = tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encoder(path).ids(text), "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(ALPHABET, max_size=14).map("".join), st.integers(1, 60))
def test_chunks_join_to_the_same_ids(text, times):
    whole = text * times
    own = chunk_bpe.ChunkEncoder(BYTES)
    want = tokens.tokenizer(BYTES).encode(whole, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(whole.encode()), "<u4").tolist() == want
    assert b"".join(chunk_bpe.chunks(whole.encode())) == whole.encode()


def given_texts(spark):
    return [(r.doc_id, r.text) for r in frame(spark, "documents").collect()]


def check_bpe(rows, docs):
    tk = tokens.tokenizer(BYTES)
    want = Counter()
    for i, t in docs:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in rows) == want


def test_bpe_of_the_given_table(spark):
    check_bpe(q.op8_chunk_bpe(spark, SF).collect(), given_texts(spark))


def on_docs(monkeypatch, docs):
    monkeypatch.setattr(q, "table", lambda *_: docs)


def test_bpe_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    on_docs(monkeypatch, odd_docs)
    check_bpe(q.op8_chunk_bpe(spark, "").collect(), TEXTS)
    on_docs(monkeypatch, no_docs)
    assert q.op8_chunk_bpe(spark, "").count() == 0


def check_packed(rows, docs, capacity=1024):
    tk = tokens.tokenizer(BYTES)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(tk.encode(t or "", add_special_tokens=False).ids + [0])
    assert set(pieces) == set(want)
    for i, found in pieces.items():
        assert sum(r.length for r in found) == sum(map(len, want[i]))
        ids = np.array(want[i][0], "<u4")
        for r in found:
            assert r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == crc32(ids[r.start : r.start + r.length])
        for start, n in Counter(r.start for r in found).items():
            assert n == len(want[i]) or len(want[i]) > 1, start
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(r.length for r in rows)


def test_packing_of_the_given_table(spark):
    assert check_packed(q.op7_packing(spark, SF).collect(), given_texts(spark)) < 0.02


def test_packing_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    on_docs(monkeypatch, odd_docs)
    check_packed(q.op7_packing(spark, "").collect(), TEXTS)
    on_docs(monkeypatch, no_docs)
    assert q.op7_packing(spark, "").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.lists(st.sampled_from([0.0, 1.0, 3.0]), min_size=31, max_size=31))
def test_cuts_cost_the_least(gaps, penalties):
    at, capacity, free = [0, *np.cumsum(gaps).tolist()], 16, 8
    cost, back = packing.best_cuts(at, penalties[: len(at)], capacity, free)
    best = [0.0]
    for j in range(1, len(at)):
        ways = [best[i] + (0 if at[j] - at[i] == free else capacity - at[j] + at[i]) for i in range(j) if at[j] - at[i] <= capacity]
        best.append(min(ways) + penalties[j])
    assert cost == pytest.approx(best)


def check_files(rows, docs):
    tk = tokens.tokenizer(WORDS)
    want, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_files_of_the_given_table(spark):
    check_files(q.op9_ans_files(spark, SF).collect(), given_texts(spark))


def test_files_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    on_docs(monkeypatch, odd_docs)
    check_files(q.op9_ans_files(spark, "").collect(), TEXTS)
    on_docs(monkeypatch, no_docs)
    assert q.op9_ans_files(spark, "").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 9), st.integers(1, 5))
def test_ans_round_trip_from_every_checkpoint(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = ans_files.Table(ans_files.frequencies(np.bincount(ids, minlength=41)))
    words, states, marks = ans_files.encode(ids, table, lanes, every)
    assert ans_files.decode(words, states, table, len(ids), lanes).tolist() == ids.tolist()
    block = {"lanes": lanes, "checkpoint": every, "words": words, "states": states, "checkpoints": marks, "tokens": len(ids)}
    parts = [ans_files.decode_from(block, table, p) for p in range(-(-len(ids) // (lanes * every)))]
    assert [int(x) for p in parts for x in p] == ids.tolist()


def test_frequencies_sum_up_and_keep_rare_ids():
    counts = np.array([10**9, 1, 0, 5] + [1] * 5000)
    freq = ans_files.frequencies(counts)
    assert freq.sum() == 1 << ans_files.SCALE_BITS and ((freq > 0) == (counts > 0)).all()


def test_damaged_files_are_refused(spark, odd_docs):
    path = ans_files.new_path(spark)
    ans_files.write(odd_docs, WORDS, 49_408, 2, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("checksum", __import__("pyspark").sql.functions.col("checksum") + 1)
    blocks.write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="does not match its checksum"):
        ans_files.read(spark, f"{path}-bad").collect()


def brute_prints(docs, words=3):
    prints = []
    for i, t in docs:
        parts = (t or "").encode().lower().split()
        take = min(words, len(parts))
        h = [xxhash.xxh64_intdigest(b" ".join(parts[k : k + take]), 42) for k in range(len(parts) - take + 1)] if parts else []
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return prints


def brute_groups(prints, radius=2):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    smallest = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            smallest[top(k)] = min(i, smallest.get(top(k), i))
    return [(i, f"{p:016x}", smallest.get(top(k))) for k, (i, p) in enumerate(prints)]


def test_simhash_of_the_given_table(spark):
    got = [tuple(r) for r in q.op10_simhash_tiles(spark, SF).collect()]
    assert Counter(got) == Counter(brute_groups(brute_prints(given_texts(spark))))


def test_simhash_of_odd_texts(spark, odd_docs, no_docs):
    got = [tuple(r) for r in simhash_tiles.near_duplicates(odd_docs).collect()]
    assert Counter(got) == Counter(brute_groups(brute_prints(TEXTS)))
    assert simhash_tiles.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_tiles_find_every_link(spark, block):
    rng = np.random.default_rng(2)
    words = [int(x) for x in rng.integers(0, 2**63, 120)]
    for w in words[:60]:
        for flips in (1, 2, 3):
            words.append(w ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    prints = spark.createDataFrame([(i, 1, w) for i, w in enumerate(words)], "doc_id long, shingles long, w0 long").repartition(4)
    cell, reach = simhash_tiles.by_population(2)
    classes = prints.selectExpr("w0 AS node", "w0").distinct().withColumn("_cell", cell)
    links = {frozenset(r) for r in simhash_tiles.links(classes, 1, 2, "_cell", reach, block).collect()}
    assert links
    got = {r.doc_id: r.component_id for r in simhash_tiles.groups(prints, 1, 2).collect()}
    want = brute_groups([(i, w & (2**64 - 1)) for i, w in enumerate(words)])
    assert got == {i: c for i, _, c in want}


def test_representatives_keep_one_of_near_copies(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(40):
        words = rng.choice(vocabulary, 300).tolist()
        rows.append((g * 10, " ".join(words)))
        for k in (1, 2):
            copy = list(words)
            copy[int(rng.integers(300))] = "changed"
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = simhash_tiles.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([g * 10 for g in range(40)] + [900, None])


def test_toxicity_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    caught = sum(p and y for p, y in held) / sum(y for _, y in held)
    wrong = sum(p and not y for p, y in held) / sum(not y for _, y in held)
    assert caught > 0.85 and wrong < 0.01


def test_toxicity_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (6, 0), (9, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for taught in (labels, labels.limit(0)):
        weights = toxicity.fit(odd_docs, taught)
        scores = toxicity.scored(odd_docs, weights).collect()
        assert Counter(r.doc_id for r in scores) == Counter(i for i, _ in TEXTS)
        assert all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(no_docs, weights).count() == 0
    assert toxicity.without_toxic(odd_docs, weights, 1.1).columns == odd_docs.columns


def test_toxicity_learns_as_slow_ftrl_does(spark):
    """One coordinate after the other, in plain Python, over the same rows in the same order."""
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 40, 12)) + (" bad word" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    rows += [(0, "zzz a later text of a repeated id", 0), (7, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    taught = docs.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    got = toxicity.fit(docs.drop("toxic"), taught, l1=1.0)
    least = {}
    for i, t, _ in rows:
        if t is not None:
            least[i] = min(least.get(i, t), t)
    label = {i: max(x for j, _, x in rows if j == i) for i in least}
    keyed = spark.createDataFrame([(i,) for i in least], "doc_id long").selectExpr("doc_id", *(f"xxhash64(doc_id, {e}) e{e}" for e in (1, 2)))
    turns = sorted((e, r[f"e{e}"], r.doc_id) for r in keyed.collect() for e in (1, 2))
    z, n = {}, {}

    def weight(k):
        sign, l1 = (1 if z.get(k, 0.0) > 0 else -1), (0.0 if k == toxicity.SLOTS else 1.0)
        return 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - sign * l1) / (1.0 + n[k] ** 0.5)

    for _, _, i in turns:
        at = {*toxicity.features(least[i].encode()).tolist(), toxicity.SLOTS}
        held = {k: weight(k) for k in at}
        g = 1 / (1 + np.exp(-sum(held.values()))) - label[i]
        for k in at:
            z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) * held[k]
            n[k] = n.get(k, 0.0) + g * g
    want = np.zeros(toxicity.SLOTS + 1)
    for k in z:
        want[k] = weight(k)
    assert np.count_nonzero(want) > 5
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_toxicity_sample_holds_one_row_of_an_id(spark):
    rows = [(1, f"text {i}", 1) for i in range(500)] + [(i, "fine", 0) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    once = spark.createDataFrame([(1, "text 0", 1)] + rows[500:], "doc_id long, text string, toxic int")
    got, want = (toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic"), l1=0.5) for d in (docs, once))
    np.testing.assert_allclose(got, want)
