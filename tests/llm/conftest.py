from __future__ import annotations

import os

import pytest

SF = os.environ.get("TRACEMILL_DATA", "/root/testdata") + "/sf0.001"

TEXTS = [
    (0, "The same words are here. And here again, in a second sentence of this text!\nA line."),
    (1, "The same words are here. And here again, in a second sentence of this text!\nA line."),
    (2, None),
    (3, ""),
    (4, "   \n\n\t "),
    (5, "word"),
    (6, "two words"),
    (7, "a" * 3000),
    (8, "Ünḯcödé   text, 3.14 it's <|endoftext|> 中文字符 😀!! ...  x"),
    (9, "long " * 6000 + "end"),
    (9, "long " * 6000 + "end"),
    (None, "a row without an id"),
    (12, "no" + "spacehere" * 400 + " then spaces"),
    (13, "\x01 odd \x1c control \r\n characters\x85here"),
    (14, "Line one.\nLine two.\n\nPara two. " * 60),
    (15, "Line one.\nLine two.\n\nPara two. " * 60 + "changed"),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with helpers'."""
    rows = [(i, t, "x", "y", 1, None, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, tile string, side int, score double, label int").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def frame(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")
