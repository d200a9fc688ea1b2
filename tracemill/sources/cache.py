"""Parquet cache of signals and results, keyed by parameter stem, latest session first."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.signal import poison_blocks


#: What Spark says of a cache that nobody has written to yet; any other failure is the caller's to see.
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def save(df: DataFrame, path: str, stem: str, session: str) -> None:
    """Add a session's result under its stem. Sessions sort by time, as ISO stamps do."""
    # the prefix keeps Spark from reading the folder name as a date
    tagged = df.withColumns({"stem": F.lit(stem), "session": F.lit(f"at-{session}")})
    tagged.write.mode("append").partitionBy("stem", "session").parquet(path)


def load_latest(spark: SparkSession, path: str, prefix: str) -> DataFrame | None:
    """Rows of the newest session among stems that start with `prefix`, or None.

    Stem and session are partition columns: the search reads no data columns and the
    result scans one folder.
    """
    try:
        cached = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_THERE:
            raise
        return None
    if "stem" not in cached.columns:
        return None
    matching = cached.filter(F.col("stem").startswith(prefix))
    newest = matching.agg(F.max(F.struct("session", "stem")).alias("m")).select("m.*").first()
    if newest is None or newest["stem"] is None:
        return None
    chosen = (F.col("stem") == newest["stem"]) & (F.col("session") == newest["session"])
    return cached.filter(chosen).drop("stem", "session")


def load_or_compute(
    spark: SparkSession, path: str, stem: str, session: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    found = load_latest(spark, path, stem)
    if found is None:
        save(compute(), path, stem, session)
        found = load_latest(spark, path, stem)
    return found


def group_key(patients: Iterable[int]) -> str:
    """Stable name of a set of recordings."""
    text = ",".join(str(p) for p in sorted(patients))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def save_curve(curve: DataFrame, path: str, stem: str, patients: Iterable[int], session: str) -> None:
    """Keep the ROC of a set of recordings; an older one stays but is no longer found."""
    save(curve, path, f"{stem}set{group_key(patients)}", session)


def load_or_compute_curve(
    spark: SparkSession, path: str, stem: str, patients: Iterable[int], session: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    return load_or_compute(spark, path, f"{stem}set{group_key(patients)}", session, compute)


# What each kind of cached signal holds as its value.
SIGNAL_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tricorr": lambda df: df,
    "aEEG": lambda df: df.withColumn("value", F.col("lower")).drop("lower", "upper"),
}


def load_signal(
    spark: SparkSession, path: str, stem: str, signal_type: str, discretization_s: int, snippets_duration_s: int
) -> DataFrame:
    """Newest cached signal, with whole blocks missing where any of their cells is."""
    if signal_type not in SIGNAL_READERS:
        raise ValueError(f"unsupported signal type: {signal_type}")
    found = load_latest(spark, path, stem)
    if found is None:
        raise FileNotFoundError(f"no data like {stem}")
    return poison_blocks(SIGNAL_READERS[signal_type](found), discretization_s // snippets_duration_s)
