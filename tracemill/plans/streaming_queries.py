"""The event table as a stream, through the streaming operators, read back as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.views import with_views
from tracemill.session import scratch_folder
from tracemill.streaming import windows


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stream(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("patient_num"),
        F.col("event_type").alias("channel"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def _finished(result: DataFrame) -> DataFrame:
    folder = f"{scratch_folder(result.sparkSession)}/stream-{uuid.uuid4().hex}"
    return windows.run_to_table(result, f"{folder}/out", f"{folder}/state")


def _ended(stream: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    folder = f"{scratch_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return windows.run_to_end(stream, operator, f"{folder}/out", f"{folder}/state", f"{folder}/marks")


@query(
    "stream_tumbling",
    """
SELECT patient_num, channel, CAST(epoch(start) AS BIGINT) AS start, n, round(value, 6) AS value FROM (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, event_type AS channel,
    time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n, max(value) AS value
  FROM events GROUP BY 1, 2, 3)""",
)
def stream_tumbling(spark, sf_dir):
    found = _ended(event_stream(spark, sf_dir), lambda s: windows.tumbling(s, "6 hours", "1 hour"))
    return found.select(
        "patient_num", "channel", F.unix_seconds("start").alias("start"), "n", rounded("value").alias("value")
    )


@query(
    "stream_sliding",
    """
SELECT patient_num, channel, CAST(epoch(start + INTERVAL 12 HOUR) AS BIGINT) AS "end", n,
  round(CASE WHEN n = 8 THEN value END, 6) AS value FROM (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, event_type AS channel,
    time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 6 HOUR AS start,
    count(value) AS n, avg(value) AS value
  FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3)""",
)
def stream_sliding(spark, sf_dir):
    """Twelve-hour windows every six hours, kept where they hold exactly eight values."""
    found = _ended(event_stream(spark, sf_dir), lambda s: windows.sliding(s, "12 hours", "6 hours", "1 hour", expected=8))
    return found.select(
        "patient_num", "channel", F.unix_seconds("end").alias("end"), "n", rounded("value").alias("value")
    )


@query(
    "stream_sessions",
    """
SELECT patient_num, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(epoch_us(max(ts)) + 1800000000 AS BIGINT) AS "end",
  count(*) AS n FROM (
  SELECT *, sum(CASE WHEN seen IS NULL OR ts > seen + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY patient_num ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT CAST(user_id % 8 AS INT) AS patient_num, ts, event_id,
    lag(ts) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS seen FROM events))
GROUP BY patient_num, g""",
)
def stream_sessions(spark, sf_dir):
    """Bursts of events as intervals; a half-hour pause ends one."""
    found = _ended(event_stream(spark, sf_dir), lambda s: windows.sessions(s, "30 minutes", "1 hour"))
    return found.select("patient_num", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    "stream_rolling",
    with_views(
        """
steps AS (
  SELECT CAST(label AS INT) AS patient_num, CAST(vec_id AS VARCHAR) AS channel, CAST(i - 1 AS BIGINT) AS idx,
    CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT label, vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
    )
    + """
SELECT patient_num, channel, idx, round(CASE WHEN idx >= 7 THEN avg(value) OVER w END, 6) + 0.0 AS mean,
  round(CASE WHEN idx >= 7 THEN stddev_samp(value) OVER w END, 6) + 0.0 AS std
FROM steps WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)
def stream_rolling(spark, sf_dir):
    """Stateful rolling mean and spread over the last eight samples of each series."""
    steps = views.stream(spark, sf_dir, "embeddings").select(
        F.col("label").alias("patient_num"),
        F.col("vec_id").cast("string").alias("channel"),
        F.posexplode("embedding").alias("idx", "value"),
    ).select("patient_num", "channel", F.col("idx").cast("bigint"), F.col("value").cast("double"))
    found = _finished(windows.rolling(steps, 8, block_len=16))
    return found.select(
        "patient_num", "channel", "idx", rounded("mean").alias("mean"), rounded("std").alias("std")
    )
