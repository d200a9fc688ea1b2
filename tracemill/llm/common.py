"""Helpers of the operators in this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.session import scratch_folder

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the cluster's shared folder and read back.

    What is read back needs no executor that took part in making it.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`fn` turns one Arrow batch into the columns of another; rows stay where they are."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8 bytes, one by one; a null is the empty text."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""
