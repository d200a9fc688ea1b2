"""A corpus from raw documents to packed sequences, stage by stage.

Every stage is written to the cluster's shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import packing, repeated_spans, simhash_tiles, toxicity
from tracemill.llm.common import table, written
from tracemill.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents (at most `max_rows`) and drops what scores 0.5 or more."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of documents that share 0.8 of their five-word shingles."""
    return simhash_tiles.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a smaller doc_id has too; `n_chars` follows."""
    left = repeated_spans.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.selectExpr(*(f"CAST(length(text) AS {docs.schema[c].dataType.simpleString()}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.packed(docs, vocabulary_path("byte_bpe_50k.json"), memo=MEMO)


#: Fewer remembered pieces than alone: the stages share the workers' memory.
MEMO = 150_000

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express none of the four stages (hash, tokenizer and learnt weights are missing there).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
