"""Queries that write derived tables through the sinks and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracemill.functions.naming import result_key
from tracemill.functions.nulls import rounded
from tracemill.operators import annotations, detection, intervals
from tracemill.operators.tables import union_all
from tracemill.plans import views
from tracemill.plans.detection_queries import _DS, _SWEEP
from tracemill.plans.interval_queries import _NOTES, _event_bounds, _runs, order_notes
from tracemill.plans.params import BY_SIGNAL, COMMON
from tracemill.plans.registry import query
from tracemill.plans.views import collapse_sql, with_views
from tracemill.session import scratch_folder
from tracemill.sources import cache, files


def _folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "src_cache",
    with_views("signal")
    + """
SELECT patient_num, channel, idx, round(CASE WHEN NOT bool_or(value IS NULL) OVER (PARTITION BY patient_num, idx // 15)
  THEN value * 2 END, 6) + 0.0 AS value FROM sig""",
)
def src_cache(spark, sf_dir):
    """The signal cached twice under one stem; the later session is loaded, gaps widened to 15."""
    folder = _folder(spark)
    params = dict(COMMON) | BY_SIGNAL["tricorr"]
    stem = result_key("tricorr", params)
    events = views.event_signal(spark, sf_dir)
    cache.save(events, folder, stem, "2024-01-01T00")
    cache.save(events.withColumn("value", F.col("value") * 2), folder, stem, "2024-01-02T00")
    found = cache.load_signal(spark, folder, stem, "tricorr", params["discretization_s"], params["snippets_duration_s"])
    return found.select("patient_num", "channel", "idx", rounded("value").alias("value"))


@query(
    "src_csv",
    """
SELECT o_orderkey, '[' || o_orderstatus || ', ' || o_orderpriority || ']' AS tags, o_totalprice FROM orders""",
)
def src_csv(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    folder = _folder(spark)
    tags = F.array("o_orderstatus", "o_orderpriority").alias("tags")
    files.write_csv(orders.select("o_orderkey", tags, "o_totalprice"), folder)
    return spark.read.schema("o_orderkey bigint, tags string, o_totalprice double").csv(folder, header=True)


def _two_digits(v: str) -> str:
    power = f"(CAST(floor(log10(abs({v}))) AS INT) - 1)"
    return f"""CASE WHEN {power} >= 0 THEN round_even({v} / pow(10.0, {power}), 0) * pow(10.0, {power})
      ELSE round_even({v} * pow(10.0, -{power}), 0) / pow(10.0, -{power}) END"""


@query(
    "src_tex_rows",
    f"""
SELECT lang || '&within&chars&' || ({_two_digits("a")}) || '&' || ({_two_digits("b")}) || '&' || ({_two_digits("c")}) AS line
FROM (SELECT lang, avg(n_chars) AS a, avg(n_chars) / 10000 AS b, CAST(max(n_chars) AS DOUBLE) AS c
  FROM documents GROUP BY 1)""",
)
def src_tex_rows(spark, sf_dir):
    """Table lines with numbers cut to two significant digits."""
    rows = views.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("target")).agg(
        F.lit("within").alias("standardization"),
        F.lit("chars").alias("signal"),
        F.avg("n_chars").alias("auc"),
        (F.avg("n_chars") / 10_000).alias("tpr57"),
        F.max("n_chars").cast("double").alias("fphr80"),
    )
    return files.table_rows(rows).select("line")


@query(
    "src_export",
    with_views("signal", "reviewers", _runs(2), _event_bounds())
    + """
SELECT 'samples' AS part, patient_num, channel AS label, CAST(idx AS DOUBLE) AS a, round(value, 6) + 0.0 AS b FROM sig
UNION ALL SELECT 'recordings', patient_num, NULL, 0.0, stop_s FROM ends
UNION ALL SELECT 'reviewer_counts', patient_num, NULL, CAST(sec AS DOUBLE), CAST(n AS DOUBLE) FROM rc
UNION ALL SELECT 'intervals', patient_num, NULL, on_s, off_s FROM runs""",
)
def src_export(spark, sf_dir):
    """A recording's tables written side by side and read back."""
    folder = _folder(spark)
    recordings = views.event_recordings(spark, sf_dir)
    counts = views.reviewer_counts(spark, sf_dir)
    flags = counts.select("patient_num", F.col("sec").alias("idx"), (F.col("n") >= 2).alias("flag"))
    files.export_recording(views.event_signal(spark, sf_dir), recordings, counts, intervals.runs(flags), folder)

    def part(name, a, b, label=None):
        named = F.col(label) if label else F.lit(None).cast("string")
        numbers = [F.col(a).cast("double").alias("a"), rounded(b).alias("b")]
        return spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("part"), "patient_num", named.alias("label"), *numbers)

    parts = [part("samples", "idx", "value", "channel"), part("recordings", "start_s", "duration_s")]
    return union_all([*parts, part("reviewer_counts", "sec", "n"), part("intervals", "on_s", "off_s")])


@query(
    "src_notes",
    with_views(_NOTES.replace("FROM orders)", "FROM orders WHERE o_orderkey % 50 > 1)", 1), collapse_sql("joined", "snapped"))
    + """
SELECT 'interval' AS part, patient_num, on_s, off_s FROM joined
UNION ALL SELECT 'broken lines', NULL, CAST(count(*) FILTER (WHERE o_orderkey % 50 = 0) AS DOUBLE),
  CAST(count(*) FILTER (WHERE o_orderkey % 50 = 1) AS DOUBLE) FROM orders""",
)
def src_notes(spark, sf_dir):
    """Artifact notes from file to intervals; cut lines and lines without a patient are counted, not lost."""
    key = F.col("o_orderkey") % 50
    patient = F.when(key == 1, F.lit("n/a")).otherwise(F.col("patient_num").cast("string"))
    line = F.when(key == 0, F.concat_ws(",", patient, "text")).otherwise(F.concat_ws(",", patient, "text", "time", "duration"))
    folder = _folder(spark)
    order_notes(spark, sf_dir).select(line).write.text(folder)
    notes = files.checked_notes(spark, folder, tuple(files.NOTE_COLUMNS))
    good = notes.filter(F.col("broken").isNull())
    ends = good.select("patient_num").distinct().select(
        "patient_num", F.lit("00:00:00").alias("start_clock"), F.lit(0.0).alias("start_s"), F.lit(90_000.0).alias("stop_s")
    )
    found = annotations.artifact_intervals(good, ends, (1,), 15)
    named = F.col("broken").startswith("n/a")
    broken = notes.filter(F.col("broken").isNotNull()).agg(
        F.count_if(~named).cast("double").alias("on_s"), F.count_if(named).cast("double").alias("off_s")
    )
    return union_all(
        [
            found.select(F.lit("interval").alias("part"), F.col("patient_num").cast("bigint").alias("patient_num"), "on_s", "off_s"),
            broken.select(F.lit("broken lines").alias("part"), F.lit(None).cast("bigint").alias("patient_num"), "on_s", "off_s"),
        ]
    )


@query(
    "src_curves",
    with_views(_DS, _SWEEP)
    + """
SELECT step, lang, round(theta, 6) AS theta, true_positives + CASE step WHEN 'updated' THEN 1 ELSE 0 END AS true_positives, false_positives
FROM sweep CROSS JOIN (SELECT unnest(['computed', 'found', 'updated']) AS step)""",
)
def src_curves(spark, sf_dir):
    """Curves kept by parameters and recordings: computed once, found again in any order of either, replaced by a newer one."""
    folder = _folder(spark)
    params = dict(COMMON) | BY_SIGNAL["tricorr"]
    stem = result_key("roc", params)
    same = result_key("roc", dict(reversed(params.items())))

    def compute():
        return detection.roc_sweep(views.document_scores(spark, sf_dir), 100, ("lang",))

    def again():
        raise AssertionError("a kept curve is not computed again")

    steps = {
        "computed": cache.load_or_compute_curve(spark, folder, stem, (1, 2, 3), "2024-01-01T00", compute),
        "found": cache.load_or_compute_curve(spark, folder, same, (3, 1, 2), "2024-01-02T00", again),
    }
    newer = compute().withColumn("true_positives", F.col("true_positives") + 1)
    cache.save_curve(newer, folder, stem, (2, 3, 1), "2024-01-03T00")
    # another set of recordings has a curve of its own
    cache.save_curve(newer, folder, stem, (1, 2), "2024-01-04T00")
    steps["updated"] = cache.load_or_compute_curve(spark, folder, stem, (1, 2, 3), "2024-01-05T00", again)
    shown = [
        df.select(F.lit(step).alias("step"), "lang", rounded("theta").alias("theta"), "true_positives", "false_positives")
        for step, df in steps.items()
    ]
    return union_all(shown)
