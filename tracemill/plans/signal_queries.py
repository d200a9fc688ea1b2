"""Queries on signals: masking, binning, rolling, standardising, reducing channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.operators import intervals, rolling, signal, standardize
from tracemill.plans import views
from tracemill.plans.params import merged
from tracemill.plans.registry import query
from tracemill.plans.views import runs_sql, with_views

K = 4
SIG = with_views("signal")
CELL = ("patient_num", "channel", "idx")


def _shown(df: DataFrame, *columns: str, value: str = "value") -> DataFrame:
    return df.select(*columns, rounded(value).alias(value))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rolling mean over three days, z-scored and reduced, per patient."""
    daily = views.event_signal(spark, sf_dir, bucket_s=86_400, pooled=True)
    rolled = rolling.rolling(daily, 3)
    scaled = standardize.standardize(rolled, "within")
    return _shown(standardize.reduce_channels(scaled, "maxanyabs"), "patient_num", "idx")


def _rolled_sql(aggregate: str, k: int = K, source: str = "sig") -> str:
    return f"""
rolled AS (
  SELECT patient_num, channel, idx, CASE WHEN count(value) OVER w = {k} THEN {aggregate} OVER w END AS value
  FROM {source}
  WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))"""


def _out(source: str, columns: str = "patient_num, channel, idx") -> str:
    return f"SELECT {columns}, round(value, 6) + 0.0 AS value FROM {source}"


@query("sig_dense", SIG + _out("sig"))
def sig_dense(spark, sf_dir):
    return _shown(views.event_signal(spark, sf_dir), *CELL)


@query("sig_rolling_mean", with_views("signal", _rolled_sql("avg(value)")) + _out("rolled"))
def sig_rolling_mean(spark, sf_dir):
    return _shown(rolling.rolling(views.event_signal(spark, sf_dir), K), *CELL)


@query("sig_rolling_std", with_views("signal", _rolled_sql("stddev_samp(value)")) + _out("rolled"))
def sig_rolling_std(spark, sf_dir):
    return _shown(rolling.rolling(views.event_signal(spark, sf_dir), K, "std"), *CELL)


@query("sig_rolling_median", with_views("lines").rstrip() + """
, rolled AS (
  SELECT patient_num, channel, idx, CASE WHEN count(value) OVER w = 15 THEN median(value) OVER w END AS value FROM osig
  WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
""" + _out("rolled"))
def sig_rolling_median(spark, sf_dir):
    """Windows by a function of their values."""
    return _shown(rolling.rolling_by(views.order_steps(spark, sf_dir), 15, rolling.median, keys=("patient_num",)), *CELL)


@query("sig_rolling_seconds", with_views("signal", _rolled_sql("quantile_cont(value, 0.9)", 4)) + _out("rolled"))
def sig_rolling_seconds(spark, sf_dir):
    """The published window in seconds, over steps of the margins' length, by an upper quantile."""
    settings = merged("aEEG", {"window_fn": rolling.quantile_of(0.9)})
    rolled = rolling.rolling_seconds(
        views.event_signal(spark, sf_dir), settings["rolling_window_s"], settings["snippets_duration_s"], settings["window_fn"]
    )
    return _shown(rolled, *CELL)


@query("sig_rolling_long", with_views("lines", _rolled_sql("avg(value)", 60, "osig")) + _out("rolled"))
def sig_rolling_long(spark, sf_dir):
    """Sixty-step window over the order recordings."""
    return _shown(rolling.rolling(views.order_signal(spark, sf_dir), 60), *CELL)


@query("sig_rolling_long_std", with_views("lines", _rolled_sql("stddev_samp(value)", 60, "osig")) + _out("rolled"))
def sig_rolling_long_std(spark, sf_dir):
    return _shown(rolling.rolling(views.order_signal(spark, sf_dir), 60, "std"), *CELL)


_DEVIATION = """
scaled AS (
  SELECT patient_num, channel, idx,
    (value - avg(value) OVER c) / nullif(stddev_samp(value) OVER c, 0.0) AS value
  FROM rolled WINDOW c AS (PARTITION BY patient_num, channel))"""


@query("sig_rolling_deviation", with_views("signal", _rolled_sql("avg(value)"), _DEVIATION) + _out("scaled"))
def sig_rolling_deviation(spark, sf_dir):
    return _shown(standardize.rolling_deviation(views.event_signal(spark, sf_dir), K), *CELL)


@query(
    "sig_deviation_detect",
    with_views("signal", _rolled_sql("stddev_samp(value)"), _DEVIATION)
    + "SELECT patient_num, channel, idx, value > 1 AS detected FROM scaled",
)
def sig_deviation_detect(spark, sf_dir):
    found = standardize.deviation_detections(views.event_signal(spark, sf_dir), K, lambda v: v > 1, "std")
    return found.select(*CELL, "detected")


_POISONED = """
poisoned AS (
  SELECT patient_num, channel, idx,
    CASE WHEN NOT bool_or(value IS NULL) OVER (PARTITION BY patient_num, idx // {k}) THEN value END AS value
  FROM sig)"""


@query("sig_block_poison", with_views("signal", _POISONED.format(k=2)) + _out("poisoned"))
def sig_block_poison(spark, sf_dir):
    return _shown(signal.poison_blocks(views.event_signal(spark, sf_dir), 2), *CELL)


_WITHIN = """
firsts AS (SELECT patient_num, idx, arg_min(value IS NOT NULL, channel) AS used FROM {source} GROUP BY 1, 2),
moments AS (
  SELECT {group}, CASE WHEN count(*) = count(value) THEN avg(value) END AS mu,
    CASE WHEN count(*) = count(value) THEN stddev_samp(value) END AS sd
  FROM {source} JOIN firsts USING (patient_num, idx) WHERE used GROUP BY ALL),
scaled AS (
  SELECT patient_num, channel, idx, (value - mu) / nullif(sd, 0.0) AS value
  FROM {source} LEFT JOIN moments USING ({group}))"""


@query(
    "sig_standardize_within",
    with_views("signal", _POISONED.format(k=1), _WITHIN.format(source="poisoned", group="patient_num, channel"))
    + _out("scaled"),
)
def sig_standardize_within(spark, sf_dir):
    poisoned = signal.poison_blocks(views.event_signal(spark, sf_dir), 1)
    return _shown(standardize.standardize(poisoned, "within"), *CELL)


@query(
    "sig_standardize_within_gaps",
    with_views("signal", _WITHIN.format(source="sig", group="patient_num, channel")) + _out("scaled"),
)
def sig_standardize_within_gaps(spark, sf_dir):
    """Channels with gaps where the first channel has none become missing."""
    return _shown(standardize.standardize(views.event_signal(spark, sf_dir), "within"), *CELL)


@query(
    "sig_standardize_across",
    with_views("signal", _POISONED.format(k=1), _WITHIN.format(source="poisoned", group="channel")) + _out("scaled"),
)
def sig_standardize_across(spark, sf_dir):
    poisoned = signal.poison_blocks(views.event_signal(spark, sf_dir), 1)
    return _shown(standardize.standardize(poisoned, "across"), *CELL)


@query(
    "sig_standardize_given",
    SIG + "SELECT patient_num, channel, idx, round((value - 20.0) / 15.0, 6) + 0.0 AS value FROM sig",
)
def sig_standardize_given(spark, sf_dir):
    scaled = standardize.standardize_with(views.event_signal(spark, sf_dir), F.lit(20.0), F.lit(15.0))
    return _shown(scaled, *CELL)


def _reduce_query(name: str, aggregate: str) -> None:
    sql = SIG + f"""
SELECT patient_num, idx, round(CASE WHEN count(*) = count(value) THEN {aggregate} END, 6) + 0.0 AS value
FROM (SELECT patient_num, idx, channel, value - 20.0 AS value FROM sig) GROUP BY 1, 2"""

    @query(f"sig_reduce_{name}", sql)
    def run(spark, sf_dir):
        shifted = views.event_signal(spark, sf_dir).withColumn("value", F.col("value") - 20.0)
        return _shown(standardize.reduce_channels(shifted, name), "patient_num", "idx")


_reduce_query("meanall", "avg(value)")
_reduce_query("meanallabs", "avg(abs(value))")
_reduce_query("maxany", "max(value)")
_reduce_query("maxanyabs", "max(abs(value))")


@query(
    "sig_reduce_distance",
    with_views(
        "signal",
        """
present AS (
  SELECT patient_num, count(*) AS steps FROM (
    SELECT patient_num, idx FROM sig GROUP BY 1, 2 HAVING count(*) = count(value)) GROUP BY 1),
means AS (
  SELECT patient_num, channel, sum(coalesce(value, 0.0)) / nullif(any_value(steps), 0) AS m
  FROM sig JOIN present USING (patient_num) GROUP BY 1, 2)""",
    )
    + """
SELECT patient_num, idx,
  round(CASE WHEN count(*) = count(value) THEN sqrt(sum((value - m) * (value - m))) END, 6) + 0.0 AS value
FROM sig JOIN means USING (patient_num, channel) GROUP BY 1, 2""",
)
def sig_reduce_distance(spark, sf_dir):
    return _shown(standardize.reduce_channels(views.event_signal(spark, sf_dir), "distance"), "patient_num", "idx")


@query(
    "sig_coarse_max",
    SIG + """
SELECT patient_num, channel, idx // 7 AS bin,
  round(CASE WHEN count(*) = count(value) THEN max(value) END, 6) + 0.0 AS value
FROM sig GROUP BY 1, 2, 3""",
)
def sig_coarse_max(spark, sf_dir):
    return _shown(signal.coarse_grain(views.event_signal(spark, sf_dir), 7), "patient_num", "channel", "bin")


@query(
    "sig_coarse_bool",
    SIG + """
SELECT patient_num, channel, idx // 7 AS bin,
  CASE WHEN count(*) = count(value) THEN bool_or(value > 30) END AS flag
FROM sig GROUP BY 1, 2, 3""",
)
def sig_coarse_bool(spark, sf_dir):
    flags = views.event_signal(spark, sf_dir).withColumn("flag", F.col("value") > 30)
    return signal.coarse_grain_flags(flags, 7).select("patient_num", "channel", "bin", "flag")


@query(
    "sig_block_mean",
    SIG + """
SELECT patient_num, channel, idx // 7 AS bin,
  round(CASE WHEN count(*) = count(value) THEN avg(value) END, 6) + 0.0 AS value
FROM sig GROUP BY 1, 2, 3 HAVING count(*) = 7""",
)
def sig_block_mean(spark, sf_dir):
    return _shown(signal.block_mean(views.event_signal(spark, sf_dir), 7), "patient_num", "channel", "bin")


@query(
    "sig_artifact_mask",
    with_views("signal", "artifacts", runs_sql("bad", "art", "idx", "flag"))
    + """
SELECT patient_num, channel, idx, round(CASE WHEN NOT EXISTS (
    SELECT 1 FROM bad b WHERE b.patient_num = s.patient_num AND b.on_s <= s.idx AND s.idx < b.off_s)
  THEN value END, 6) + 0.0 AS value
FROM sig s""",
)
def sig_artifact_mask(spark, sf_dir):
    """Samples inside 1-based artifact runs, compared on plain times as published."""
    bad = intervals.runs(views.artifact_flags(spark, sf_dir))
    timed = signal.with_time(views.event_signal(spark, sf_dir), views.event_recordings(spark, sf_dir))
    return _shown(signal.mask_covered(timed, bad, block_s=16.0, disjoint=True), *CELL)


@query(
    "sig_rms",
    SIG + """
SELECT patient_num, idx, round(CASE WHEN count(*) = count(value) THEN sqrt(avg(value * value)) END, 6) + 0.0 AS value
FROM sig GROUP BY 1, 2""",
)
def sig_rms(spark, sf_dir):
    return _shown(standardize.rms(views.event_signal(spark, sf_dir)), "patient_num", "idx")


@query(
    "sig_rms_classes",
    with_views("lines")
    + """
SELECT patient_num, idx, round(sqrt(avg(value * value)), 6) + 0.0 AS value
FROM osig WHERE channel BETWEEN 2 AND 14 GROUP BY 1, 2""",
)
def sig_rms_classes(spark, sf_dir):
    rms = standardize.rms(views.order_signal(spark, sf_dir), classes=(2, 14))
    return _shown(rms, "patient_num", "idx")


@query(
    "sig_moving_average",
    with_views("signal", _rolled_sql("avg(value)")) + _out("rolled") + f" WHERE idx >= {K - 1}",
)
def sig_moving_average(spark, sf_dir):
    return _shown(rolling.moving_average(views.event_signal(spark, sf_dir), K), *CELL)


@query(
    "sig_moving_average_skip",
    SIG + f"""
SELECT patient_num, channel, idx, round(value, 6) + 0.0 AS value FROM (
  SELECT patient_num, channel, idx, avg(value) OVER (
    PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) AS value
  FROM sig) WHERE idx >= {K - 1}""",
)
def sig_moving_average_skip(spark, sf_dir):
    averaged = rolling.moving_average(views.event_signal(spark, sf_dir), K, skip_missing=True)
    return _shown(averaged, *CELL)


@query(
    "sig_variability",
    with_views("lines")
    + """
SELECT patient_num, round(stddev_samp(value), 6) AS variability, round(avg(value), 6) AS average_amp FROM (
  SELECT patient_num, idx, sqrt(avg(value * value)) AS value FROM osig GROUP BY 1, 2)
GROUP BY 1""",
)
def sig_variability(spark, sf_dir):
    spread = standardize.variability(standardize.rms(views.order_signal(spark, sf_dir)))
    return spread.select("patient_num", rounded("variability").alias("variability"), rounded("average_amp").alias("average_amp"))


@query(
    "sig_snippets",
    with_views("lines")
    + """
SELECT patient_num, idx // 250 AS snippet, CAST(count(DISTINCT channel) AS BIGINT) AS n_channels,
  CAST(count(*) AS BIGINT) AS n_cells, round(sum(value * (1 + channel * 250 + idx % 250)), 3) AS checksum
FROM osig GROUP BY 1, 2 HAVING count(*) = 17 * 250""",
)
def sig_snippets(spark, sf_dir):
    """Fixed-length snippets, with a checksum over the order of their cells."""
    rows = signal.snippets(views.order_signal(spark, sf_dir), 250).filter(F.col("length") == 250)
    place = F.transform("cells", lambda v, i: v * (i + 1))
    checksum = F.aggregate(place, F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "patient_num", "snippet", "n_channels", F.size("cells").cast("bigint").alias("n_cells"),
        rounded(checksum, 3).alias("checksum"),
    )


@query(
    "sig_snippets_gaps",
    with_views("lines").rstrip()
    + """,
holed AS (SELECT * FROM osig WHERE (idx * 7 + channel * 13 + patient_num) % 97 <> 0),
tops AS (SELECT patient_num, max(idx) AS top FROM holed GROUP BY 1)
SELECT patient_num, idx // 250 AS snippet, CAST(17 AS BIGINT) AS n_channels, CAST(17 * 250 - count(*) AS BIGINT) AS n_missing,
  round(sum(value * (1 + channel * 250 + idx % 250)), 3) AS checksum
FROM holed JOIN tops USING (patient_num) WHERE (idx // 250 + 1) * 250 <= top + 1 GROUP BY 1, 2""",
)
def sig_snippets_gaps(spark, sf_dir):
    """Snippets of a recording with absent rows keep their length and the places of their cells."""
    holed = views.order_signal(spark, sf_dir).filter((F.col("idx") * 7 + F.col("channel") * 13 + F.col("patient_num")) % 97 != 0)
    rows = signal.snippets(holed, 250).filter(F.size("cells") == 17 * 250)
    place = F.transform("cells", lambda v, i: F.coalesce(v * (i + 1), F.lit(0.0)))
    return rows.select(
        "patient_num", "snippet", "n_channels",
        F.size(F.filter("cells", lambda v: v.isNull())).cast("bigint").alias("n_missing"),
        rounded(F.aggregate(place, F.lit(0.0), lambda a, v: a + v), 3).alias("checksum"),
    )


@query(
    "sig_time_axis",
    SIG + "SELECT patient_num, channel, idx, CAST(idx AS DOUBLE) AS t FROM sig",
)
def sig_time_axis(spark, sf_dir):
    timed = signal.with_time(views.event_signal(spark, sf_dir), views.event_recordings(spark, sf_dir))
    return timed.select(*CELL, "t")


@query(
    "sig_sans_artifacts",
    with_views(
        "signal", "artifacts", runs_sql("bad", "art", "idx", "flag"),
        """
masked AS (
  SELECT patient_num, channel, idx, CASE WHEN NOT EXISTS (
    SELECT 1 FROM bad b WHERE b.patient_num = s.patient_num AND b.on_s <= s.idx AND s.idx < b.off_s)
    THEN value END AS value FROM sig s)""",
    )
    + """
SELECT patient_num, channel, idx, round(CASE WHEN NOT bool_or(value IS NULL) OVER (PARTITION BY patient_num, idx // 2)
  THEN value END, 6) + 0.0 AS value FROM masked""",
)
def sig_sans_artifacts(spark, sf_dir):
    """Artifacts masked, then every block of two steps that has a gap."""
    bad = intervals.runs(views.artifact_flags(spark, sf_dir))
    timed = signal.with_time(views.event_signal(spark, sf_dir), views.event_recordings(spark, sf_dir))
    masked = signal.mask_covered(timed, bad, block_s=16.0, disjoint=True)
    return _shown(signal.poison_blocks(masked, 2), *CELL)
