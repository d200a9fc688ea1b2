"""The pipeline's stages against brute force, and planted cases."""

from __future__ import annotations

from collections import Counter

import numpy as np

import corpus_pipeline
from tracemill.llm import toxicity
from tracemill.llm.common import table

from .conftest import SF
from .test_texts import check_packed


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_stages_on_the_given_tables(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    weights = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    want = {i for i, r in rows.items() if toxicity.score_of(r.text.encode(), weights) < 0.5}
    assert {r.doc_id for r in clean.collect()} == want

    one = corpus_pipeline.drop_near_duplicates(spark, clean, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    near = {(i, j): jaccard(rows[i].text, rows[j].text) for i in want for j in want if j < i}
    label = {i: i for i in want}
    for i, j in sorted(p for p, s in near.items() if s >= 0.8):
        low, high = sorted((label[i], label[j]))
        label = {k: low if v == high else v for k, v in label.items()}
    assert kept == set(label.values())

    cut = corpus_pipeline.cut_repeats(spark, one, SF)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    for r in cut.collect():
        assert r.n_chars == len(r.text) and len(r.text) <= len(rows[r.doc_id].text)
    seen = set()
    for r in sorted(cut.collect(), key=lambda r: r.doc_id):
        raw = rows[r.doc_id].text.encode()
        windows = {raw[s : s + 50] for s in range(len(raw) - 49)}
        if not windows & seen:
            assert r.text.encode() == raw
        seen |= windows

    packed = corpus_pipeline.pack(spark, cut, SF).collect()
    assert check_packed(packed, [(r.doc_id, r.text) for r in cut.collect()]) < 0.02


def test_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, text(60) + (" you utter blockhead" if toxic else ""), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    passage = text(60)
    rows += [(1000 + i, f"{text(40)} {passage} {text(40)}", "en", "s", 0) for i in range(5)]
    original = text(300)
    rows += [(2000, original, "en", "s", 0), (2001, original, "en", "s", 0), (2002, original.replace("word1", "other", 1), "en", "s", 0)]
    rows += [(3000, text(50) + " you utter blockhead", "en", "s", 0), (None, None, None, None, None), (4000, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, str(tmp_path), "documents")
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    left = Counter(r.doc_id for r in clean.collect())
    assert left == Counter(i for i, t, *_ in rows if "blockhead" not in (t or ""))
    one = stages["simhash_near_dedup"](spark, clean, str(tmp_path))
    assert Counter(r.doc_id for r in one.collect()) == left - Counter([2001, 2002])
    cut = {r.doc_id: r.text for r in stages["suffix_array_dedup"](spark, one, str(tmp_path)).collect()}
    assert passage in cut[1000] and all(passage not in cut[1000 + i] for i in range(1, 5))
    assert all(cut[i] == t for i, t, *_ in rows if i in cut and i not in range(1001, 1005))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_packed(pieces, list(cut.items())) < 0.05


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
