"""Numeric matrices of level-5 MAT files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element type codes of the format.
NUMBER_TYPES = {
    1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8",
}
MATRIX, COMPRESSED, CELL_CLASS = 14, 15, 1


def _elements(buffer: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(buffer):
        kind, size = struct.unpack_from("<II", buffer, at)
        if kind >> 16:  # short element: size and type share the first word
            yield kind & 0xFFFF, buffer[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        body = buffer[at + 8 : at + 8 + size]
        at += 8 + size
        if kind == COMPRESSED:
            yield from _elements(zlib.decompress(body))
        else:
            at += -size % 8
            yield kind, body


def _matrices(body: bytes, inherited: str = "", cell: int = 0) -> Iterator[tuple[str, int, np.ndarray]]:
    parts = list(_elements(body))
    flags = struct.unpack("<I", parts[0][1][:4])[0]
    shape = np.frombuffer(parts[1][1], "<i4")
    name = parts[2][1].decode() or inherited
    if flags & 0xFF == CELL_CLASS:
        for i, (_, inner) in enumerate(parts[3:], start=1):
            if inner:
                yield from _matrices(inner, name, i)
    elif len(parts) > 3 and parts[3][0] in NUMBER_TYPES:
        values = np.frombuffer(parts[3][1], "<" + NUMBER_TYPES[parts[3][0]])
        yield name, cell, values.reshape(shape, order="F")


def matrices(spark: SparkSession, path: str, key: str, only: bool = False) -> DataFrame:
    """`path, cell, row, cells` of one named matrix, or of each cell of a cell array.

    `row` counts matrix rows from 0 and `cells` holds that row; `cell` counts cells from 1.
    With `only`, a file that holds anything else is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found, names = [], set()
                for kind, body in _elements(content[128:]):
                    if kind != MATRIX:
                        continue
                    for name, cell, matrix in _matrices(body):
                        names.add(name)
                        if name == key:
                            rows = matrix.astype(float)
                            found += [(file, cell, i, r) for i, r in enumerate(np.atleast_2d(rows))]
                if key not in names or (only and names != {key}):
                    raise ValueError(f"expected {key} in {file}, found {sorted(names)}")
                yield pd.DataFrame(found, columns=["path", "cell", "row", "cells"])

    return files.mapInPandas(decode, "path string, cell int, row int, cells array<double>")


def snippet_cells(rows: DataFrame) -> DataFrame:
    """A matrix snippet in long form: row is the channel, column the time step."""
    return rows.select(
        "path", F.col("row").alias("channel"), F.posexplode("cells").alias("idx", "value")
    )


def reviewer_flags(rows: DataFrame) -> DataFrame:
    """Reviewer x second matrices, one per recording, as flags."""
    return rows.select(
        F.col("cell").alias("patient_num"),
        F.col("row").alias("reviewer"),
        F.posexplode("cells").alias("sec", "_flag"),
    ).withColumn("flag", F.col("_flag").cast("int")).drop("_flag")
