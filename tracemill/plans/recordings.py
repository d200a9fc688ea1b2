"""Whole collections of recordings: samples, outlines, reviewer counts and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tracemill.functions.nulls import join_on

from tracemill.functions.scalar import (
    DEFAULT_EXCLUDED_CHANNELS,
    DEFAULT_EXCLUDED_CHANNELS_SECOND_SITE,
)
from tracemill.operators import annotations, dsp, signal
from tracemill.plans.params import SECOND_SITE_CHANNELS
from tracemill.sources import edf, files, mat


def cleaned(samples: DataFrame, recordings: DataFrame, mains_hz: float = 50.0) -> DataFrame:
    """Filter every channel at its recording's sample rate."""
    rates = [r.sample_rate for r in recordings.select("sample_rate").distinct().toLocalIterator()]
    parts = []
    for rate in rates:
        held = join_on(samples, recordings.filter(F.col("sample_rate") == rate).select("patient_num"), ["patient_num"])
        parts.append(dsp.clean_channels(held, float(rate), mains_hz=mains_hz))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _bounds(recordings: DataFrame) -> DataFrame:
    return recordings.select(
        "patient_num", "start_clock", "start_s", (F.col("start_s") + F.col("duration_s")).alias("stop_s")
    )


def load_collection(
    spark: SparkSession,
    edf_path: str,
    reviewers_path: str,
    notes_path: str,
    discretization_s: float,
    min_reviewers: int = 3,
    excluded_grades: Sequence[int] = (1,),
    excluded_channels: Sequence[str] = DEFAULT_EXCLUDED_CHANNELS,
    reviewers_key: str = "annotat_new",
    clean: bool = True,
) -> dict[str, DataFrame]:
    """Recordings reviewed by experts, with artifact notes."""
    headers = edf.headers(spark, edf_path)
    outlines = edf.recordings(headers)
    samples = signal.drop_channels(edf.samples(headers), excluded_channels)
    if clean:
        samples = cleaned(samples, outlines)
    flags = mat.reviewer_flags(mat.matrices(spark, reviewers_path, reviewers_key))
    counts = join_on(annotations.count_flags(flags), outlines.select("patient_num"), ["patient_num"])
    bounds = _bounds(outlines)
    seizures = annotations.consensus_intervals(counts, min_reviewers, discretization_s, bounds)
    notes = files.artifact_notes(spark, notes_path)
    artifacts = annotations.artifact_intervals(notes, bounds, excluded_grades, discretization_s)
    intervals = seizures.withColumn("kind", F.lit("seizure")).unionByName(
        artifacts.withColumn("kind", F.lit("artifact"))
    )
    return {
        "recordings": outlines,
        "samples": signal.rename_channels(samples),
        "reviewer_counts": counts,
        "intervals": intervals,
    }


def load_second_site(
    spark: SparkSession,
    edf_path: str,
    excluded_channels: Sequence[str] = DEFAULT_EXCLUDED_CHANNELS_SECOND_SITE,
    artifact_keywords: Sequence[str] = (),
    clean: bool = True,
) -> dict[str, DataFrame]:
    """Recordings with embedded annotations; a recording without a channel list keeps all."""
    headers = edf.headers(spark, edf_path)
    outlines = edf.recordings(headers)
    listed = spark.createDataFrame(
        [(int(name[3:]), list(words)) for name, words in SECOND_SITE_CHANNELS.items()],
        "patient_num int, words array<string>",
    )
    samples = signal.drop_channels(edf.samples(headers), excluded_channels)
    samples = signal.drop_listed_channels(samples, listed, ())
    if clean:
        samples = cleaned(samples, outlines)
    events = annotations.relevant(edf.timed_annotations(headers))
    events = events.withColumn("patient_num", F.regexp_extract("path", r"(\d+)\.edf$", 1).cast("int"))
    seizures = annotations.keyword_intervals(events)
    artifacts = annotations.keyword_intervals(events, artifact_keywords)
    intervals = seizures.withColumn("kind", F.lit("seizure")).unionByName(
        artifacts.withColumn("kind", F.lit("artifact"))
    )
    return {"recordings": outlines, "samples": samples, "events": events, "intervals": intervals}
