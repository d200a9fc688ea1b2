"""Queries on detector evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.operators import detection
from tracemill.operators.tables import union_all
from tracemill.plans import views
from tracemill.plans.detector import clinician_scores, detector_signal, evaluate, mu_sigma_sweeps, sensitivity
from tracemill.plans.interval_queries import _event_bounds, _runs, epochs_sql, event_ends, seizures
from tracemill.plans.registry import query
from tracemill.plans.views import invert_sql, with_views

UNUSED = ("signup", "view")
WINDOW, EPOCH = 2, 2

def reduced_sql(stat: str = "avg", standardization: str = "within", value: str = "abs(z)") -> str:
    """Expressions for the detector trace `red` of the event signal."""
    group = {"within": "patient_num, channel", "across": "channel"}[standardization]
    return f"""
kept AS (SELECT * FROM sig WHERE NOT (contains(channel, 'signup') OR contains(channel, 'view'))),
poisoned AS (
  SELECT patient_num, channel, idx,
    CASE WHEN NOT bool_or(value IS NULL) OVER (PARTITION BY patient_num, idx) THEN value END AS value FROM kept),
rolled AS (
  SELECT patient_num, channel, idx, CASE WHEN count(value) OVER w = 2 THEN {stat}(value) OVER w END AS value
  FROM poisoned
  WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
moments AS (
  SELECT {group}, avg(value) AS mu, stddev_samp(value) AS sd FROM rolled WHERE value IS NOT NULL
  GROUP BY ALL),
red AS (
  SELECT patient_num, idx, CASE WHEN count(*) = count(z) THEN max({value}) END AS value
  FROM (SELECT patient_num, idx, (value - mu) / nullif(sd, 0.0) AS z FROM rolled JOIN moments USING ({group}))
  GROUP BY 1, 2)"""


_REDUCED = reduced_sql()

_EPOCHS = """
ep AS (SELECT patient_num, idx // 2 AS bin, CASE WHEN count(*) = count(value) THEN max(value) END AS value
  FROM red GROUP BY 1, 2),
eends AS (SELECT patient_num, 0.0::DOUBLE AS start_s, CAST(max(bin) * 2 AS DOUBLE) AS stop_s FROM ep GROUP BY 1)"""

_SCORES = """
tbins AS (
  SELECT t.patient_num, t.on_s, e.bin, e.value FROM truth t JOIN eends n USING (patient_num)
  JOIN ep e ON e.patient_num = t.patient_num AND (e.bin + 1) * 2 > t.on_s AND e.bin * 2 < t.off_s
  WHERE t.on_s < n.stop_s),
qbins AS (
  SELECT t.patient_num, t.on_s, e.bin, e.value FROM quiet t JOIN eends n USING (patient_num)
  JOIN ep e ON e.patient_num = t.patient_num AND (e.bin + 1) * 2 > t.on_s AND e.bin * 2 < t.off_s
  WHERE t.on_s < n.stop_s),
scores AS (
  SELECT patient_num, max(value) AS score, TRUE AS is_target FROM tbins WHERE value IS NOT NULL GROUP BY patient_num, on_s
  UNION ALL SELECT patient_num, value, FALSE FROM qbins WHERE value IS NOT NULL)"""

_TOP = "(SELECT max(stop_s) FROM eends)"


def _pipeline(*more: str, reviewers: int = 3, reduced: str = _REDUCED) -> str:
    return with_views(
        "signal", "reviewers", reduced, _EPOCHS, _runs(reviewers), epochs_sql("truth", "runs", EPOCH, "0.0", _TOP),
        invert_sql("quiet", "truth", "eends"), _SCORES, *more,
    )


_PATIENT = """
pscores AS (
  SELECT patient_num, max(score) AS score, TRUE AS is_target FROM scores WHERE is_target GROUP BY 1
  UNION ALL SELECT * FROM scores WHERE NOT is_target)"""


def _roc_sql(source: str, name: str = "roc") -> str:
    return f"""
{name} AS (
  SELECT NULL::DOUBLE AS theta, 1.0::DOUBLE AS pfa, 0.0::DOUBLE AS pmiss
  UNION ALL
  SELECT d.score, (SELECT avg(CASE WHEN s.score > d.score THEN 1.0 ELSE 0.0 END) FROM {source} s WHERE NOT is_target),
    (SELECT avg(CASE WHEN s.score <= d.score THEN 1.0 ELSE 0.0 END) FROM {source} s WHERE is_target)
  FROM (SELECT DISTINCT score FROM {source}) d)"""


def event_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = views.event_signal(spark, sf_dir)
    return detector_signal(signal, WINDOW, "within", "maxanyabs", exclude=UNUSED, poison=1)


def event_scores(spark: SparkSession, sf_dir: str, target: str = "seizure", reviewers: int = 3) -> DataFrame:
    return detection.TARGETS[target](
        event_reduced(spark, sf_dir),
        seizures(spark, sf_dir, reviewers),
        views.event_recordings(spark, sf_dir),
        EPOCH,
        1,
    )


@query("det_signal", with_views("signal", _REDUCED) + "SELECT patient_num, idx, round(value, 6) + 0.0 AS value FROM red")
def det_signal(spark, sf_dir):
    return event_reduced(spark, sf_dir).select("patient_num", "idx", rounded("value").alias("value"))


@query("det_posseizure", _pipeline() + "SELECT patient_num, round(score, 6) AS score, is_target FROM scores")
def det_posseizure(spark, sf_dir):
    return event_scores(spark, sf_dir).select("patient_num", rounded("score").alias("score"), "is_target")


@query("det_pospatient", _pipeline(_PATIENT) + "SELECT patient_num, round(score, 6) AS score, is_target FROM pscores")
def det_pospatient(spark, sf_dir):
    scores = event_scores(spark, sf_dir, "patient")
    return scores.select("patient_num", rounded("score").alias("score"), "is_target")


@query(
    "det_roc",
    _pipeline(_roc_sql("scores"))
    + "SELECT round(theta, 6) AS theta, round(pfa, 6) AS pfa, round(pmiss, 6) AS pmiss FROM roc",
)
def det_roc(spark, sf_dir):
    curve = detection.roc(event_scores(spark, sf_dir))
    return curve.select(*[rounded(c).alias(c) for c in ("theta", "pfa", "pmiss")])


_AUC = """
SELECT round(avg(CASE WHEN t.score > n.score THEN 1.0 WHEN t.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM (SELECT * FROM {s} WHERE is_target) t CROSS JOIN (SELECT * FROM {s} WHERE NOT is_target) n"""


@query("det_auc_rank", _pipeline() + _AUC.format(s="scores"))
def det_auc_rank(spark, sf_dir):
    return detection.auc(event_scores(spark, sf_dir)).select(rounded("auc").alias("auc"))


@query("det_tpr_at_fphr", _pipeline(_roc_sql("scores")) + """
SELECT round(1 - arg_min(pmiss, coalesce(theta, -1e300)), 6) AS tpr FROM roc WHERE pfa * 60 <= 5.7""")
def det_tpr_at_fphr(spark, sf_dir):
    found = detection.tpr_at_fphr(detection.roc(event_scores(spark, sf_dir)), 5.7)
    return found.select(rounded("tpr").alias("tpr"))


@query("det_fphr_at_tpr", _pipeline(_roc_sql("scores")) + """
SELECT round(arg_min(pfa, coalesce(theta, -1e300)) * 60, 6) AS fphr FROM roc WHERE pmiss >= 1 - 0.8::DOUBLE""")
def det_fphr_at_tpr(spark, sf_dir):
    found = detection.fphr_at_tpr(detection.roc(event_scores(spark, sf_dir)), 0.8)
    return found.select(rounded("fphr").alias("fphr"))


@query(
    "det_threshold_range",
    with_views("signal")
    + f"""
SELECT patient_num, channel, round(min(value) - {2.0**-26!r}, 9) AS theta_min, round(max(value) + {2.0**-26!r}, 9) AS theta_max
FROM sig GROUP BY 1, 2""",
)
def det_threshold_range(spark, sf_dir):
    ends = detection.threshold_range(views.event_signal(spark, sf_dir), ("patient_num", "channel"))
    return ends.select(
        "patient_num", "channel", rounded("theta_min", 9).alias("theta_min"), rounded("theta_max", 9).alias("theta_max")
    )


_SWEEP = f"""
lim AS (SELECT lang, min(score) - {2.0**-26!r} AS lo, max(score) + {2.0**-26!r} AS hi FROM ds GROUP BY 1),
th AS (SELECT lang, lo + i * ((hi - lo) / 99) AS theta FROM (SELECT *, unnest(range(0, 100)) AS i FROM lim)),
sweep AS (
  SELECT t.lang, t.theta,
    CAST(count(*) FILTER (WHERE is_target AND score >= theta) AS BIGINT) AS true_positives,
    CAST(count(*) FILTER (WHERE is_target) AS BIGINT) AS gt_positive,
    CAST(count(*) FILTER (WHERE NOT is_target AND score >= theta) AS BIGINT) AS false_positives,
    CAST(count(*) FILTER (WHERE NOT is_target) AS BIGINT) AS gt_negative
  FROM th t JOIN ds USING (lang) GROUP BY 1, 2)"""

_DS = """
ds AS (
  SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS is_target FROM documents JOIN labels USING (doc_id))"""


@query(
    "det_roc_sweep",
    with_views(_DS, _SWEEP)
    + """
SELECT lang, round(theta, 6) AS theta, true_positives, gt_positive, false_positives, gt_negative FROM sweep""",
)
def det_roc_sweep(spark, sf_dir):
    curve = detection.roc_sweep(views.document_scores(spark, sf_dir), 100, ("lang",))
    return curve.withColumn("theta", rounded("theta"))


@query(
    "det_rates",
    with_views(_DS, _SWEEP)
    + """
SELECT lang, round(theta, 6) AS theta, round(true_positives / nullif(gt_positive, 0), 6) AS tpr,
  round(false_positives / nullif(gt_negative, 0), 6) AS fpr,
  round(false_positives / nullif(gt_negative * 60 / 3600.0, 0), 6) AS fphr FROM sweep""",
)
def det_rates(spark, sf_dir):
    curve = detection.roc_sweep(views.document_scores(spark, sf_dir), 100, ("lang",))
    shown = detection.rates(curve, 60)
    return shown.select("lang", *[rounded(c).alias(c) for c in ("theta", "tpr", "fpr", "fphr")])


@query(
    "det_auc_trapezoid",
    with_views(_DS, _SWEEP)
    + """
SELECT lang, round(sum((t0 + 0.5 * (tpr - t0)) * (fpr - f0)), 6) AS auc FROM (
  SELECT lang, tpr, fpr, coalesce(lag(tpr) OVER w, 0.0) AS t0, coalesce(lag(fpr) OVER w, 0.0) AS f0 FROM (
    SELECT lang, theta, true_positives / nullif(gt_positive, 0) AS tpr, false_positives / nullif(gt_negative, 0) AS fpr
    FROM sweep) WINDOW w AS (PARTITION BY lang ORDER BY theta DESC))
GROUP BY 1""",
)
def det_auc_trapezoid(spark, sf_dir):
    curve = detection.roc_sweep(views.document_scores(spark, sf_dir), 100, ("lang",))
    return detection.auc_trapezoid(curve, ("lang",)).select("lang", rounded("auc").alias("auc"))


@query(
    "det_auc_by_group",
    with_views(_DS)
    + """
SELECT t.lang, round(avg(CASE WHEN t.score > n.score THEN 1.0 WHEN t.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM (SELECT * FROM ds WHERE is_target) t JOIN (SELECT * FROM ds WHERE NOT is_target) n USING (lang) GROUP BY 1""",
)
def det_auc_by_group(spark, sf_dir):
    scores = views.document_scores(spark, sf_dir)
    areas = detection.auc(scores, ("lang",)).filter(F.col("auc").isNotNull())
    return areas.select("lang", rounded("auc").alias("auc"))


_CLINIC = """
red AS (SELECT patient_num, sec AS idx, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM rc)"""


def _clinic_sql() -> str:
    # truth is epochised once for the reader and again when targets are taken
    return with_views(
        "signal", "reviewers", _CLINIC, _EPOCHS, _event_bounds(), _runs(3),
        epochs_sql("once", "runs", EPOCH, "0.0", "(SELECT n - 1 FROM len)"),
        epochs_sql("truth", "once", EPOCH, "0.0", _TOP), invert_sql("quiet", "truth", "eends"), _SCORES,
        _roc_sql("scores"),
    )


@query(
    "det_clinician",
    _clinic_sql() + "SELECT round(theta, 6) AS theta, round(pfa, 6) AS pfa, round(pmiss, 6) AS pmiss FROM roc",
)
def det_clinician(spark, sf_dir):
    scores = clinician_scores(
        views.reviewer_counts(spark, sf_dir),
        seizures(spark, sf_dir, 3),
        views.event_recordings(spark, sf_dir),
        EPOCH,
    )
    curve = detection.roc(scores)
    return curve.select(*[rounded(c).alias(c) for c in ("theta", "pfa", "pmiss")])


@query(
    "det_all_patients",
    _pipeline(_roc_sql("scores"))
    + f"""
SELECT ({_AUC.format(s="scores")}) AS auc,
  (SELECT round(1 - arg_min(pmiss, coalesce(theta, -1e300)), 6) FROM roc WHERE pfa * 60 <= 5.7) AS tpr57,
  (SELECT round(arg_min(pfa, coalesce(theta, -1e300)) * 60, 6) FROM roc WHERE pmiss >= 1 - 0.8::DOUBLE) AS fphr80""",
)
def det_all_patients(spark, sf_dir):
    """Area and operating points of the whole detection run."""
    points = evaluate(event_scores(spark, sf_dir))
    return points.select(*[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")])


def _sweep_rows() -> str:
    parts = []
    for target, source in (("seizure", "scores"), ("patient", "pscores")):
        parts.append(f"""
SELECT '{target}' AS target, ({_AUC.format(s=source)}) AS auc,
  (SELECT round(1 - arg_min(pmiss, coalesce(theta, -1e300)), 6) FROM roc_{target} WHERE pfa * 60 <= 5.7) AS tpr57,
  (SELECT round(arg_min(pfa, coalesce(theta, -1e300)) * 60, 6) FROM roc_{target} WHERE pmiss >= 1 - 0.8::DOUBLE) AS fphr80""")
    return " UNION ALL ".join(parts)


@query(
    "rel_sweep",
    _pipeline(_PATIENT, _roc_sql("scores", "roc_seizure"), _roc_sql("pscores", "roc_patient")) + _sweep_rows(),
)
def rel_sweep(spark, sf_dir):
    """One row per target definition, from one pass over all of them."""
    scores = event_scores(spark, sf_dir).withColumn("target", F.lit("seizure"))
    best = scores.filter("is_target").groupBy("patient_num").agg(F.max("score").alias("score"))
    best = best.select("patient_num", "score", F.lit(True).alias("is_target"), F.lit("patient").alias("target"))
    quiet = scores.filter(~F.col("is_target")).withColumn("target", F.lit("patient"))
    points = evaluate(scores.unionByName(best).unionByName(quiet), ("target",))
    return points.select("target", *[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")])


def _mu_sigma_sql() -> str:
    parts = []
    for name, stat in (("mean", "avg"), ("std", "stddev_samp")):
        sweep = f"""
lim AS (SELECT patient_num, min(value) - {2.0**-26!r} AS lo, max(value) + {2.0**-26!r} AS hi FROM red GROUP BY 1),
th AS (SELECT patient_num, lo + i * ((hi - lo) / 99) AS theta FROM (SELECT *, unnest(range(0, 100)) AS i FROM lim)),
sweep AS (
  SELECT t.patient_num, t.theta,
    CAST(count(*) FILTER (WHERE is_target AND score >= theta) AS BIGINT) AS true_positives,
    CAST(count(*) FILTER (WHERE is_target) AS BIGINT) AS gt_positive,
    CAST(count(*) FILTER (WHERE NOT is_target AND score >= theta) AS BIGINT) AS false_positives,
    CAST(count(*) FILTER (WHERE NOT is_target) AS BIGINT) AS gt_negative
  FROM th t LEFT JOIN scores USING (patient_num) GROUP BY 1, 2)"""
        body = _pipeline(sweep, reviewers=2, reduced=reduced_sql(stat))
        parts.append(f"SELECT * FROM ({body} SELECT '{name}' AS rolling, * REPLACE (round(theta, 6) AS theta) FROM sweep)")
    return " UNION ALL ".join(parts)


@query("det_mu_sigma", _mu_sigma_sql())
def det_mu_sigma(spark, sf_dir):
    """Sweeps of each patient's rolled mean and rolled spread over the signal's own range."""
    curves = mu_sigma_sweeps(
        views.event_signal(spark, sf_dir), seizures(spark, sf_dir, 2), views.event_recordings(spark, sf_dir),
        WINDOW, "maxanyabs", EPOCH, exclude=UNUSED, poison=1,
    )
    return curves.withColumn("theta", rounded("theta"))


# Signal kind, rolling statistic and channel reduction of the sensitivity runs.
KINDS = (("mu", "mean", "avg", "maxanyabs", "abs(z)"), ("sigma", "std", "stddev_samp", "maxany", "z"))


def _sensitivity_sql() -> str:
    parts = []
    for kind, _, stat, _, value in KINDS:
        for standardization in ("within", "across"):
            for reviewers in (3, 2, 1):
                body = _pipeline(
                    _PATIENT, _roc_sql("scores", "roc_seizure"), _roc_sql("pscores", "roc_patient"),
                    reviewers=reviewers, reduced=reduced_sql(stat, standardization, value),
                )
                head = f"'{kind}' AS signal, '{standardization}' AS standardization, {reviewers} AS min_reviewers_per_seizure"
                parts.append(f"SELECT {head}, * FROM ({body} {_sweep_rows()})")
    return " UNION ALL ".join(parts)


@query("det_sensitivity", _sensitivity_sql())
def det_sensitivity(spark, sf_dir):
    """All settings: two signals, two standardisations, three consensus levels, two targets."""
    signal = views.event_signal(spark, sf_dir)
    traces = []
    for kind, stat, _, reduction, _ in KINDS:
        for standardization in ("within", "across"):
            trace = detector_signal(signal, WINDOW, standardization, reduction, stat, UNUSED, 1)
            traces.append(trace.withColumns({"signal": F.lit(kind), "standardization": F.lit(standardization)}))
    table = sensitivity(
        union_all(traces), views.reviewer_counts(spark, sf_dir), views.event_recordings(spark, sf_dir), EPOCH
    )
    return table.select(
        "target", "signal", "standardization", "min_reviewers_per_seizure",
        *[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")],
    )
