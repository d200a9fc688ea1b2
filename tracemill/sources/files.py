"""Artifact notes, result sinks, recording export and staged downloads."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracemill.functions.scalar import sigdigits

# Columns of the artifact notes, and the sensitivity table's heading.
NOTE_COLUMNS = {"Patient #": "patient_num", "Text": "text", "Time": "time", "Duration": "duration"}
SENSITIVITY_COLUMNS = ("target", "standardization", "signal", "auc", "tpr57", "fphr80")
SENSITIVITY_HEADING = (
    "Target & Standardization & Signal & AUC & TPR (5.7 FP/Hr) & FP/Hr (80\\% TPR)\\\\\n    \\hline\n"
)


def artifact_notes(spark: SparkSession, path: str) -> DataFrame:
    """`patient_num, text, time, duration` from the notes file; other columns are ignored."""
    raw = spark.read.csv(path, header=True)
    renamed = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in NOTE_COLUMNS.items()])
    return renamed.withColumn("patient_num", F.col("patient_num").cast("int"))


def checked_notes(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The notes with the lines that can't be read: `patient_num, text, time, duration, broken`.

    `broken` holds a line that has too few or too many fields or no whole number as its
    patient, and is NULL for the others; nothing is skipped unseen. `columns` names the fields
    of files without a heading line; otherwise each file begins with one.
    """
    heading = columns is None
    names = spark.read.csv(path, header=True).columns if heading else list(columns)
    schema = StructType([*(StructField(n, StringType()) for n in names), StructField("_line", StringType())])
    # a line is judged by all its fields, also by those that are not read
    options = {"header": heading, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "columnPruning": False}
    raw = spark.read.schema(schema).options(**options).csv(path)
    notes = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in NOTE_COLUMNS.items()], "_line")
    number = F.expr("try_cast(patient_num AS INT)")
    spoilt = F.when(number.isNull(), F.concat_ws(",", *NOTE_COLUMNS.values()))
    read = notes.withColumn("broken", F.coalesce("_line", spoilt)).withColumn("patient_num", number)
    return read.select(
        *[F.when(F.col("broken").isNull(), F.col(c)).alias(c) for c in NOTE_COLUMNS.values()], "broken"
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result table as CSV; arrays become text."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    flat = df.withColumns({c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")) for c in arrays})
    flat.write.mode("overwrite").csv(path, header=True)


def table_rows(sensitivity: DataFrame) -> DataFrame:
    """One TeX line per row, numbers to two significant digits."""
    numbers = {f.name for f in sensitivity.schema.fields if f.dataType.typeName() == "double"}
    cells = [
        sigdigits(c, 2).cast("string") if c in numbers else F.col(c).cast("string") for c in SENSITIVITY_COLUMNS
    ]
    return sensitivity.select(F.concat_ws("&", *cells).alias("line"), *SENSITIVITY_COLUMNS[:3])


def sensitivity_tex(sensitivity: DataFrame) -> str:
    """The sensitivity table as TeX, sorted; it has one row per analysis setting."""
    ordered = table_rows(sensitivity).orderBy(*SENSITIVITY_COLUMNS[:3])
    return SENSITIVITY_HEADING + "\\\\\n".join(row.line for row in ordered.select("line").toLocalIterator())


def export_recording(
    samples: DataFrame, recordings: DataFrame, counts: DataFrame, intervals: DataFrame, path: str
) -> None:
    """Write the four tables of recordings side by side under one folder."""
    samples.write.mode("overwrite").partitionBy("patient_num").parquet(os.path.join(path, "samples"))
    for name, df in (("recordings", recordings), ("reviewer_counts", counts), ("intervals", intervals)):
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def fetch_missing(
    spark: SparkSession, numbers: Sequence[int], url: str, target_dir: str, name: str = "eeg{n}.edf"
) -> DataFrame:
    """Download the recordings that `target_dir` (a shared folder) lacks.

    `url` is a template with `{n}`. Returns one row per recording with what was done.
    """
    wanted = spark.createDataFrame([(int(n),) for n in numbers], "n int").repartition("n")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n in batch["n"]:
                target = os.path.join(target_dir, name.format(n=n))
                if os.path.isfile(target):
                    out.append((n, target, "present"))
                    continue
                os.makedirs(target_dir, exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with urllib.request.urlopen(url.format(n=n)) as source, open(part, "wb") as sink:
                    shutil.copyfileobj(source, sink)
                os.replace(part, target)  # a retried task never leaves half a file
                out.append((n, target, "fetched"))
            yield pd.DataFrame(out, columns=["n", "path", "status"])

    return wanted.mapInPandas(fetch, "n int, path string, status string")
