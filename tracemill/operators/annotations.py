"""Expert annotations: reviewer flags, timed events and free-text notes into intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tracemill.functions.nulls import join_on

from tracemill.functions.scalar import DEFAULT_EVENT_KEYWORDS, contains_any, parse_duration, parse_grade, parse_start
from tracemill.operators.intervals import buffered, collapse, discretize, event_bounds, merge, runs
from tracemill.operators.signal import mark_covered

KEYS = ("patient_num",)
REVIEWERS = 3

mark = mark_covered


def count_flags(flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of reviewers who marked each second."""
    return flags.groupBy(*keys, "sec").agg(F.sum("flag").cast("int").alias("n"))


def unanimous_flags(flags: DataFrame, reviewers: int = REVIEWERS, keys: Sequence[str] = KEYS) -> DataFrame:
    return count_flags(flags, keys).select(*keys, "sec", (F.col("n") == reviewers).alias("unanimous"))


def consensus_intervals(
    counts: DataFrame,
    min_reviewers: int,
    discretization_s: float | None,
    bounds: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Runs of seconds marked by enough reviewers, snapped outward and merged."""
    flags = counts.select(*keys, F.col("sec").alias("idx"), (F.col("n") >= min_reviewers).alias("flag"))
    found = runs(flags, keys=keys)
    if discretization_s is not None:
        framed = join_on(found, bounds.select(*keys, "start_s", "stop_s"), keys)
        found = discretize(framed, discretization_s, F.col("start_s"), F.col("stop_s"))
    return merge(found, keys)


def relevant(events: DataFrame) -> DataFrame:
    """Timed events that say anything at all."""
    return events.filter(F.col("annotations") != F.array(F.lit("")))


def keyword_intervals(
    events: DataFrame,
    keywords: Sequence[str] = DEFAULT_EVENT_KEYWORDS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Collapsed intervals of events with any label that contains any keyword.

    Without keywords there are no intervals.
    """
    hit = events.filter(F.exists("annotations", lambda a: contains_any(a, keywords)))
    bounds = hit.select(*keys, event_bounds(F.col("onset_s"), F.col("duration_s")).alias("b"))
    return collapse(bounds.select(*keys, "b.on_s", "b.off_s"), keys)


def artifact_intervals(
    notes: DataFrame,
    recordings: DataFrame,
    grades: Sequence[int] = (1,),
    discretization_s: float = 1.0,
    keys: Sequence[str] = KEYS,
    strict: bool = False,
) -> DataFrame:
    """Artifact intervals of the excluded grades from free-text notes.

    `recordings` gives `start_clock` (HH:MM:SS) and the bounds `start_s, stop_s` per key.
    """
    graded = notes.withColumn("grade", parse_grade("text", strict))
    kept = join_on(graded.filter(F.col("grade").isin(*grades)), recordings, keys)
    start = parse_start("time", "start_clock")
    length = parse_duration("duration").cast("double")
    bounds = kept.select(*keys, "start_s", "stop_s", buffered(start, length).alias("b"))
    bounds = bounds.select(*keys, "start_s", "stop_s", "b.on_s", "b.off_s")
    snapped = discretize(bounds, discretization_s, F.col("start_s"), F.col("stop_s"))
    return collapse(snapped, keys, strict)


def distinct_labels(events: DataFrame) -> DataFrame:
    """All annotation texts in lower case, each once."""
    return events.select(F.explode("annotations").alias("label")).select(F.lower("label").alias("label")).distinct()
