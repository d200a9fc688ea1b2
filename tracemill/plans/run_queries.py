"""Whole runs on the order recordings: contributions and amplitude margins through the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.operators import annotations, detection, dsp, intervals, tricorr
from tracemill.plans import views
from tracemill.plans.case_queries import LOUD, RATE, order_flags, order_recordings
from tracemill.plans.detector import (
    SETTINGS,
    detector_signal,
    epoch_differences,
    epoch_samples,
    evaluate,
    mask_grades,
    sensitivity,
    setting_traces,
)
from tracemill.plans.registry import query
from tracemill.plans.statistics_queries import _delta_sql, _kde_sql, _ks_sql
from tracemill.plans.tricorr_queries import _LONGEST, _SMOOTH, _TAPS, _brute, _pass_sql, _response_sql
from tracemill.plans.views import invert_sql, merge_sql, runs_sql, with_views
from tracemill.session import cut_lineage

LAGS = (1, 1)
WINDOW, EPOCH = 3, 2
QUIET, BUSY = 0.9, 1.15  # shares of the usual shipment, below and above which a second is an artifact
REDUCTIONS = {"tricorr": "maxanyabs", "aEEG": "maxany"}
GRADE_SETS = ((), (1,), (1, 2))
REVIEWERS = (3, 2, 1)


def contribution_signal(spark, sf_dir) -> DataFrame:
    """Class contributions of every second as a signal of 14 channels."""
    found = tricorr.class_contributions(views.order_steps(spark, sf_dir), RATE, LAGS)
    return found.select("patient_num", F.col("channel").cast("string").alias("channel"), "idx", "value")


def margin_signal(spark, sf_dir) -> DataFrame:
    """Lower amplitude margin of every second and channel."""
    envelopes = dsp.envelope(views.order_steps(spark, sf_dir), 256.0, keys=("patient_num",))
    lower = dsp.lower_margin(dsp.margins(envelopes, RATE, keys=("patient_num",)))
    return lower.select("patient_num", F.col("channel").cast("string").alias("channel"), "idx", "value")


def order_counts(spark, sf_dir) -> DataFrame:
    # one row a second, where the recording has thousands; what follows reads it many times
    return cut_lineage(annotations.count_flags(order_flags(spark, sf_dir)))


def lengths(spark, sf_dir) -> DataFrame:
    return cut_lineage(order_recordings(spark, sf_dir))


def consensus(spark, sf_dir, reviewers: int) -> DataFrame:
    flags = order_counts(spark, sf_dir).select("patient_num", F.col("sec").alias("idx"), (F.col("n") >= reviewers).alias("flag"))
    return cut_lineage(intervals.runs(flags))


def graded_artifacts(spark, sf_dir) -> DataFrame:
    """Seconds that ship little (grade 1) or much (grade 2), as intervals."""
    sums = views.order_seconds(spark, sf_dir, RATE).drop("group")
    usual = sums.groupBy("patient_num").agg(F.avg("q").alias("m"))
    grade = F.explode(F.array(F.lit(1), F.lit(2))).alias("grade")
    marked = sums.join(usual, "patient_num").select("*", grade)
    flag = F.when(F.col("grade") == 1, F.col("q") < QUIET * F.col("m")).otherwise(F.col("q") > BUSY * F.col("m"))
    return cut_lineage(
        intervals.runs(marked.select("grade", "patient_num", "idx", flag.alias("flag")), keys=("grade", "patient_num"))
    )


def patient_sets(recordings: DataFrame) -> DataFrame:
    """All recordings, and those of an even number."""
    known = recordings.select("patient_num")
    sets = F.array(F.lit("all"), F.when(F.col("patient_num") % 2 == 0, F.lit("even")))
    return known.select("patient_num", F.explode(F.array_compact(sets)).alias("patient_set"))


_TRUTH = f"""
ends AS (SELECT patient_num, (max(idx) + 1) // {RATE} AS seconds FROM osig GROUP BY 1),
sums AS (SELECT patient_num, idx // {RATE} AS sec, channel % 3 AS g, sum(value) AS q FROM osig GROUP BY ALL),
usual AS (SELECT patient_num, g, avg(q) AS m FROM sums GROUP BY ALL),
rc AS (
  SELECT patient_num, sec, CAST(count(*) FILTER (WHERE q > {LOUD} * m) AS INT) AS n
  FROM sums JOIN usual USING (patient_num, g) GROUP BY 1, 2),
whole AS (SELECT patient_num, sec AS idx, sum(q) AS q FROM sums GROUP BY 1, 2),
graded_flags AS (
  SELECT CAST(grade AS INT) AS grade, patient_num, idx, CASE grade WHEN 1 THEN q < {QUIET} * m ELSE q > {BUSY} * m END AS flag
  FROM (SELECT *, avg(q) OVER (PARTITION BY patient_num) AS m FROM whole) CROSS JOIN (SELECT unnest([1, 2]) AS grade))"""

_TRICORR = [
    f"""
zcut AS MATERIALIZED (
  SELECT patient_num, snippet, r, t, (v - avg(v) OVER s) / stddev_samp(v) OVER s AS v FROM (
    SELECT patient_num * 1000000 + idx // {RATE} AS snippet, patient_num, channel AS r, idx % {RATE} AS t, value AS v
    FROM osig JOIN ends USING (patient_num) WHERE idx // {RATE} < seconds)
  WINDOW s AS (PARTITION BY snippet))""",
    _brute(*LAGS, True, "zcut", (views.ORDER_CHANNELS, RATE)),
    """
tricorr AS MATERIALIZED (
  SELECT 'tricorr' AS signal, patient_num, CAST(channel AS VARCHAR) AS channel, idx % 1000000 AS idx, value FROM brute)""",
]

_MARGINS = [
    f"""
fir AS (
  SELECT patient_num, channel, idx, abs({" + ".join(f"coalesce(lag(value, {k}) OVER w, 0.0) * {h!r}" for k, h in enumerate(_TAPS))}) AS value
  FROM osig WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx)),
series AS (SELECT patient_num, channel, list(value ORDER BY idx) AS xs FROM fir GROUP BY 1, 2)""",
    _response_sql("smooth", _SMOOTH, _LONGEST),
    _pass_sql("enveloped", "series", "smooth", None),
    f"""
points AS (SELECT patient_num, channel, unnest(range(0, len(xs))) AS idx, unnest(xs) AS v FROM enveloped),
aeeg AS MATERIALIZED (
  SELECT 'aEEG' AS signal, patient_num, CAST(channel AS VARCHAR) AS channel, idx // {RATE} AS idx,
    list_sort(list(v))[{int(0.09 * RATE)}] AS value
  FROM points GROUP BY ALL HAVING count(*) = {RATE})""",
]

_KEYS = "signal, grades, patient_set, standardization"


def _runs_by_settings(signals: str, grade_sets, patients: str, standardizations, levels) -> str:
    """Expressions from the signals `allsig` to `points_of`: area and operating points by all settings and targets."""
    grades = ", ".join(f"('{','.join(map(str, g))}', [{', '.join(map(str, g))}]::INT[])" for g in grade_sets)
    scales = {
        "within": "SELECT 'within' AS standardization, r.*, avg(value) OVER c AS mu, stddev_samp(value) OVER c AS sd FROM insets r"
        " WINDOW c AS (PARTITION BY signal, grades, patient_set, channel, patient_num)",
        "across": "SELECT 'across' AS standardization, r.*, avg(value) OVER c AS mu, stddev_samp(value) OVER c AS sd FROM insets r"
        " WINDOW c AS (PARTITION BY signal, grades, patient_set, channel)",
    }
    return f"""
allsig AS ({signals}),
gs(grades, members) AS (VALUES {grades}),
covered AS (
  SELECT DISTINCT grades, c.patient_num, c.idx FROM (SELECT DISTINCT patient_num, idx FROM allsig) c
  JOIN bad b ON b.patient_num = c.patient_num AND b.on_s <= c.idx AND c.idx < b.off_s JOIN gs ON list_contains(members, b.grade)),
graded AS (
  SELECT s.signal, g.grades, s.patient_num, s.channel, s.idx, CASE WHEN v.idx IS NULL THEN s.value END AS value
  FROM allsig s CROSS JOIN gs g LEFT JOIN covered v ON v.grades = g.grades AND v.patient_num = s.patient_num AND v.idx = s.idx),
rolled AS (
  SELECT signal, grades, patient_num, channel, idx, CASE WHEN count(value) OVER w = {WINDOW} THEN avg(value) OVER w END AS value
  FROM graded WINDOW w AS (PARTITION BY signal, grades, patient_num, channel ORDER BY idx
    ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)),
members AS ({patients}),
insets AS (SELECT * FROM rolled JOIN members USING (patient_num)),
scaled AS ({" UNION ALL ".join(scales[s] for s in standardizations)}),
red AS (
  SELECT {_KEYS}, patient_num, idx, CASE WHEN count(*) = count(z) THEN max(z) END AS value FROM (
    SELECT *, CASE signal WHEN 'tricorr' THEN abs((value - mu) / nullif(sd, 0.0)) ELSE (value - mu) / nullif(sd, 0.0) END AS z FROM scaled)
  GROUP BY ALL),
ep AS MATERIALIZED (
  SELECT {_KEYS}, patient_num, idx // {EPOCH} AS bin, CASE WHEN count(*) = count(value) THEN max(value) END AS value FROM red GROUP BY ALL),
levels AS (SELECT CAST(unnest({list(levels)}) AS INT) AS level),
lends AS (
  SELECT level, patient_num, 0.0::DOUBLE AS start_s, CAST(max(bin) * {EPOCH} AS DOUBLE) AS stop_s FROM ep CROSS JOIN levels GROUP BY 1, 2),
level_flags AS (SELECT level, patient_num, sec AS idx, n >= level AS flag FROM rc CROSS JOIN levels),
{runs_sql("runs", "level_flags", "idx", "flag", "level, patient_num")},
wide AS (
  SELECT level, patient_num, start_s, stop_s, greatest(on_s - {EPOCH}, start_s) AS on_s, least(off_s + {EPOCH}, stop_s) AS off_s
  FROM runs JOIN lends USING (level, patient_num)),
snapped AS (
  SELECT level, patient_num, greatest(start_s, floor(on_s / {EPOCH}) * {EPOCH}.0) AS on_s,
    least(stop_s, ceil(off_s / {EPOCH}) * {EPOCH}.0) AS off_s FROM wide),
{merge_sql("truth", "snapped", "level, patient_num")},
{invert_sql("quiet", "truth", "lends", "level, patient_num")},
stretches AS (SELECT *, TRUE AS is_target FROM truth UNION ALL SELECT *, FALSE FROM quiet),
placed AS (
  SELECT {_KEYS}, t.level, t.patient_num, t.on_s, t.is_target, e.value FROM stretches t JOIN lends n USING (level, patient_num)
  JOIN ep e ON e.patient_num = t.patient_num AND (e.bin + 1) * {EPOCH} > t.on_s AND e.bin * {EPOCH} < t.off_s
  WHERE t.on_s < n.stop_s AND e.value IS NOT NULL),
hits AS (SELECT {_KEYS}, level, patient_num, on_s, max(value) AS score FROM placed WHERE is_target GROUP BY ALL),
best AS (SELECT {_KEYS}, level, patient_num, max(score) AS score FROM hits GROUP BY ALL),
misses AS (SELECT {_KEYS}, level, value AS score FROM placed WHERE NOT is_target),
scores AS MATERIALIZED (
  SELECT 'seizure' AS target, {_KEYS}, level, score, TRUE AS is_target FROM hits
  UNION ALL SELECT 'patient', {_KEYS}, level, score, TRUE FROM best
  UNION ALL SELECT unnest(['seizure', 'patient']), {_KEYS}, level, score, FALSE FROM misses),
sizes AS (
  SELECT target, {_KEYS}, level, count(*) FILTER (WHERE is_target) AS tar, count(*) FILTER (WHERE NOT is_target) AS non
  FROM scores GROUP BY ALL),
roc AS (
  SELECT target, {_KEYS}, level, d.score AS theta,
    1 - count(*) FILTER (WHERE NOT s.is_target AND s.score <= d.score) / nullif(any_value(non), 0) AS pfa,
    count(*) FILTER (WHERE s.is_target AND s.score <= d.score) / nullif(any_value(tar), 0) AS pmiss
  FROM (SELECT DISTINCT target, {_KEYS}, level, score FROM scores) d JOIN scores s USING (target, {_KEYS}, level)
  JOIN sizes USING (target, {_KEYS}, level) GROUP BY ALL),
areas AS (
  SELECT target, {_KEYS}, level, avg(CASE WHEN t.score > n.score THEN 1.0 WHEN t.score = n.score THEN 0.5 ELSE 0.0 END) AS auc
  FROM (SELECT * FROM scores WHERE is_target) t JOIN (SELECT * FROM scores WHERE NOT is_target) n USING (target, {_KEYS}, level)
  GROUP BY ALL),
operating AS (
  SELECT target, {_KEYS}, level, 1 - arg_min(pmiss, theta) FILTER (WHERE pfa * 60 <= 5.7) AS tpr57,
    arg_min(pfa, theta) FILTER (WHERE pmiss >= 1 - 0.8::DOUBLE) * 60 AS fphr80
  FROM roc GROUP BY ALL),
points_of AS (
  SELECT target, {_KEYS}, level, round(auc, 6) AS auc, round(tpr57, 6) AS tpr57, round(fphr80, 6) AS fphr80
  FROM sizes LEFT JOIN areas USING (target, {_KEYS}, level) LEFT JOIN operating USING (target, {_KEYS}, level))"""


def _run_sql(parts, signals, grade_sets, patients, standardizations, levels) -> str:
    expressions = ["lines", _TRUTH, runs_sql("bad", "graded_flags", "idx", "flag", "grade, patient_num"), *parts]
    expressions.append(_runs_by_settings(signals, grade_sets, patients, standardizations, levels))
    return with_views(*expressions).replace("WITH ", "WITH RECURSIVE ", 1)


_ALL = "SELECT patient_num, 'all' AS patient_set FROM ends"


@query(
    "det_tricorr_patients",
    _run_sql(_TRICORR, "SELECT * FROM tricorr", ((),), _ALL, ("across",), (2,))
    + "SELECT auc, tpr57, fphr80 FROM points_of WHERE target = 'patient'",
)
def det_tricorr_patients(spark, sf_dir):
    """Contributions of all recordings, standardised across them, scored by recording."""
    trace = detector_signal(contribution_signal(spark, sf_dir), WINDOW, "across", REDUCTIONS["tricorr"])
    scores = detection.TARGETS["patient"](trace, consensus(spark, sf_dir, 2), lengths(spark, sf_dir), EPOCH, 1)
    return evaluate(scores).select(*[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")])


@query(
    "det_aeeg_patients",
    _run_sql(_MARGINS, "SELECT * FROM aeeg", ((),), _ALL, ("within",), (2,))
    + "SELECT auc, tpr57, fphr80 FROM points_of WHERE target = 'seizure'",
)
def det_aeeg_patients(spark, sf_dir):
    """Lower margins of all recordings, standardised within each, scored by seizure."""
    trace = detector_signal(margin_signal(spark, sf_dir), WINDOW, "within", REDUCTIONS["aEEG"])
    scores = detection.TARGETS["seizure"](trace, consensus(spark, sf_dir, 2), lengths(spark, sf_dir), EPOCH, 1)
    return evaluate(scores).select(*[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")])


_SETS = _ALL + " UNION ALL SELECT patient_num, 'even' FROM ends WHERE patient_num % 2 = 0"


@query(
    "det_sensitivity_grid",
    _run_sql(
        [*_TRICORR, *_MARGINS], "SELECT * FROM tricorr UNION ALL SELECT * FROM aeeg", GRADE_SETS, _SETS, ("within", "across"), REVIEWERS
    )
    + """
SELECT target, standardization, signal, CASE signal WHEN 'tricorr' THEN 'maxanyabs' ELSE 'maxany' END AS reduction,
  level AS min_reviewers_per_seizure, patient_set, grades AS excluded_artifact_grades, auc, tpr57, fphr80 FROM points_of""",
)
def det_sensitivity_grid(spark, sf_dir):
    """Every setting: signal, standardisation, target, consensus, set of recordings, excluded grades."""
    kinds = {"tricorr": contribution_signal, "aEEG": margin_signal}
    both = None
    for name, make in kinds.items():
        one = make(spark, sf_dir).withColumn("signal", F.lit(name))
        both = one if both is None else both.unionByName(one)
    recordings = lengths(spark, sf_dir)
    masked = mask_grades(both, graded_artifacts(spark, sf_dir), GRADE_SETS)
    traces = setting_traces(masked, patient_sets(recordings), REDUCTIONS, WINDOW)
    table = sensitivity(
        traces, order_counts(spark, sf_dir), recordings, EPOCH, REVIEWERS,
        by=(*SETTINGS, "standardization", "reduction"),
    )
    return table.select(
        "target", "standardization", "signal", "reduction", "min_reviewers_per_seizure", "patient_set",
        "excluded_artifact_grades", *[rounded(c).alias(c) for c in ("auc", "tpr57", "fphr80")],
    )


_COMPARED = [
    "lines", _TRUTH, runs_sql("bad", "graded_flags", "idx", "flag", "grade, patient_num"), *_TRICORR,
    "flags AS (SELECT patient_num, sec AS idx, n >= 2 AS flag FROM rc)", runs_sql("runs", "flags", "idx", "flag"),
    f"""
bounds AS (SELECT patient_num, 0.0::DOUBLE AS start_s, CAST(seconds AS DOUBLE) AS stop_s FROM ends),
wide AS (
  SELECT r.patient_num, greatest(on_s - {EPOCH}, 0.0) AS on_s, least(off_s + {EPOCH}, stop_s - 1) AS off_s, stop_s - 1 AS top
  FROM (SELECT * FROM runs UNION ALL SELECT patient_num, on_s, off_s FROM bad WHERE grade = 1) r JOIN bounds USING (patient_num)),
busy AS (
  SELECT patient_num, greatest(0.0, floor(on_s / {EPOCH}) * {EPOCH}.0) AS on_s, least(top, ceil(off_s / {EPOCH}) * {EPOCH}.0) AS off_s FROM wide)""",
    merge_sql("taken", "busy"), invert_sql("free", "taken", "bounds"),
    """
present AS (SELECT patient_num, channel, idx + 1 AS t, value FROM tricorr WHERE value IS NOT NULL),
samples AS (
  SELECT c.patient_num, channel, value, TRUE AS is_seizure FROM present c JOIN runs r ON r.patient_num = c.patient_num AND on_s <= t AND t < off_s
  UNION ALL
  SELECT c.patient_num, channel, value, FALSE FROM present c
  JOIN (SELECT * FROM free SEMI JOIN runs USING (patient_num)) r ON r.patient_num = c.patient_num AND on_s <= t AND t < off_s),
enough AS (
  SELECT patient_num FROM samples GROUP BY 1
  HAVING count(*) FILTER (WHERE is_seizure) >= 14 * 5 AND count(*) FILTER (WHERE NOT is_seizure) > 0),
held AS (SELECT * FROM samples SEMI JOIN enough USING (patient_num))""",
]


@query(
    "st_epoch_differences_classes",
    with_views(*_COMPARED, _ks_sql("held", "patient_num, channel"), _kde_sql("held", "patient_num, channel", 2048))
    + f"""
SELECT patient_num, channel, round(js, 4) AS js, round(p, 6) AS p, d_mu, d_sigma FROM js
JOIN ks USING (patient_num, channel)
JOIN ({_delta_sql("held", "patient_num, channel")}) USING (patient_num, channel)""",
)
def st_epoch_differences_classes(spark, sf_dir):
    """Seizure against control contributions of each recording and motif class."""
    quiet = graded_artifacts(spark, sf_dir).filter("grade = 1").drop("grade")
    # fourteen values a second, read by the masks and by the count of channels
    samples = epoch_samples(
        cut_lineage(contribution_signal(spark, sf_dir)), consensus(spark, sf_dir, 2), quiet, lengths(spark, sf_dir), EPOCH, 5, block_s=16.0
    )
    return epoch_differences(samples).select(
        "patient_num", "channel", rounded("js", 4).alias("js"), *[rounded(c).alias(c) for c in ("p", "d_mu", "d_sigma")]
    )
