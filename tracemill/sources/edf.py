"""European Data Format recordings (EDF and EDF+), read in record ranges.

Files are listed by Spark, headers are read in tasks, and each file is cut into ranges of
records that are decoded in different tasks, so one long recording is not one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = "EDF Annotations"
RANGE_BYTES = 8 << 20

_SIGNALS = "array<struct<label:string,samples:int,pmin:double,pmax:double,dmin:double,dmax:double>>"
_HEADER = (
    "path string, start_clock string, header_bytes int, record_count bigint, "
    f"seconds_per_record double, contiguous boolean, record_bytes bigint, signals {_SIGNALS}"
)
_HEADER_COLUMNS = (
    "path start_clock header_bytes record_count seconds_per_record contiguous record_bytes signals".split()
)


def _open(path: str):
    if "://" not in path and ":/" in path:
        path = path.split(":", 1)[1]
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _header(path: str) -> dict:
    with _open(path) as file:
        fixed = file.read(256).decode("latin-1")
        count = int(fixed[252:256])
        block = file.read(256 * count).decode("latin-1")
    at = 0

    def column(width: int) -> list[str]:
        nonlocal at
        values = [block[at + i * width : at + (i + 1) * width].strip() for i in range(count)]
        at += width * count
        return values

    labels, _, _ = column(16), column(80), column(8)
    pmin, pmax, dmin, dmax = (column(8) for _ in range(4))
    _, samples = column(80), column(8)
    signals = [
        {
            "label": labels[i], "samples": int(samples[i]), "pmin": float(pmin[i]), "pmax": float(pmax[i]),
            "dmin": float(dmin[i]), "dmax": float(dmax[i]),
        }
        for i in range(count)
    ]
    return {
        "path": path,
        "start_clock": fixed[176:184].replace(".", ":"),
        "header_bytes": int(fixed[184:192]),
        "record_count": int(fixed[236:244]),
        "seconds_per_record": float(fixed[244:252]),
        "contiguous": not fixed[192:236].startswith("EDF+D"),
        "record_bytes": 2 * sum(s["samples"] for s in signals),
        "signals": signals,
    }


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: clock start, record layout and signals."""
    listed = spark.read.format("binaryFile").load(path).select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_header(p) for p in batch["path"]], columns=_HEADER_COLUMNS)

    return listed.mapInPandas(read, _HEADER)


def recordings(files: DataFrame, patient: str = r"(\d+)\.edf$") -> DataFrame:
    """`patient_num, sample_rate, start_s, duration_s, ...` from headers.

    A file with gaps between records, or whose data signals differ in rate, is an error.
    """
    data = F.filter("signals", lambda s: s["label"] != ANNOTATIONS)
    rates = F.array_distinct(F.transform(data, lambda s: s["samples"]))
    problem = F.when(~F.col("contiguous"), F.lit("recording is not contiguous")).when(
        F.size(rates) > 1, F.lit("signals differ in samples per record")
    )
    message = F.concat(problem, F.lit(": "), "path")
    checked = F.when(problem.isNull(), rates[0]).otherwise(F.raise_error(message).cast("int"))
    return files.select(
        F.regexp_extract("path", patient, 1).cast("int").alias("patient_num"),
        (checked / F.col("seconds_per_record")).cast("int").alias("sample_rate"),
        F.lit(0.0).alias("start_s"),
        (F.col("record_count") * F.col("seconds_per_record")).alias("duration_s"),
        "record_count",
        "seconds_per_record",
        "start_clock",
        "path",
    )


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    per = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.col("record_bytes"))).cast("bigint")
    cut = files.withColumn("_per", per).filter("record_count > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("record_count") - 1, F.col("_per"))
    cut = cut.withColumn("first", F.explode(starts))
    cut = cut.withColumn("count", F.least("_per", F.col("record_count") - F.col("first")))
    return cut.repartition("path", "first").drop("_per")


def _records(row) -> tuple[np.ndarray, np.ndarray]:
    with _open(row.path) as file:
        file.seek(row.header_bytes + row.first * row.record_bytes)
        raw = file.read(row.count * row.record_bytes)
    values = np.frombuffer(raw, "<i2").reshape(-1, row.record_bytes // 2)
    ends = np.cumsum([s["samples"] for s in row.signals])
    return values, ends


def samples(files: DataFrame, patient: str = r"(\d+)\.edf$", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`patient_num, channel, idx, value` of all data signals, in physical units."""
    schema = "path string, channel string, first bigint, cells array<double>"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values, ends = _records(row)
                out = []
                for signal, end in zip(row.signals, ends, strict=True):
                    if signal["label"] == ANNOTATIONS:
                        continue
                    part = values[:, end - signal["samples"] : end].astype(float).ravel()
                    gain = (signal["pmax"] - signal["pmin"]) / (signal["dmax"] - signal["dmin"])
                    cells = (part - signal["dmin"]) * gain + signal["pmin"]
                    out.append((row.path, signal["label"], row.first * signal["samples"], cells))
                yield pd.DataFrame(out, columns=["path", "channel", "first", "cells"])

    parts = _ranges(files, range_bytes).mapInPandas(decode, schema)
    return parts.select(
        F.regexp_extract("path", patient, 1).cast("int").alias("patient_num"),
        "channel",
        "first",
        F.posexplode("cells").alias("_at", "value"),
    ).select("patient_num", "channel", (F.col("first") + F.col("_at")).alias("idx"), "value")


def _timed_lists(raw: bytes) -> Iterator[tuple[float, float | None, list[str]]]:
    for entry in raw.split(b"\x00"):
        if not entry:
            continue
        head, _, tail = entry.partition(b"\x14")
        onset, _, duration = head.partition(b"\x15")
        texts = tail.decode("utf-8", "replace").split("\x14")
        yield float(onset), float(duration) if duration else None, texts[:-1] or [""]


def timed_annotations(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`path, onset_s, duration_s, annotations` of embedded annotation signals."""
    schema = "path string, onset_s double, duration_s double, annotations array<string>"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values, ends = _records(row)
                out = []
                for signal, end in zip(row.signals, ends, strict=True):
                    if signal["label"] != ANNOTATIONS:
                        continue
                    for record in values[:, end - signal["samples"] : end]:
                        out += [(row.path, *timed) for timed in _timed_lists(record.tobytes())]
                yield pd.DataFrame(out, columns=["path", "onset_s", "duration_s", "annotations"])

    held = files.filter(F.exists("signals", lambda s: s["label"] == ANNOTATIONS))
    return _ranges(held, range_bytes).mapInPandas(decode, schema)
