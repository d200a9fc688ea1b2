"""Queries on two-sample statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from tracemill.functions.nulls import join_on

from tracemill.functions.nulls import rounded
from tracemill.functions.scalar import significance
from tracemill.functions.special import kolmogorov_sql, two_sided_normal_sql
from tracemill.operators import annotations, intervals, statistics
from tracemill.plans import views
from tracemill.plans.detector import epoch_differences, epoch_samples
from tracemill.plans.interval_queries import _event_bounds, _runs, document_events, epochs_sql, seizures
from tracemill.plans.registry import query
from tracemill.plans.views import invert_sql, merge_sql, runs_sql, with_views

POINTS = 512

_PS = """
ps AS (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, value, event_type = 'purchase' AS is_seizure FROM events)"""


def _delta_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, round(avg(value) FILTER (WHERE is_seizure) - avg(value) FILTER (WHERE NOT is_seizure), 6) AS d_mu,
  round(stddev_samp(value) FILTER (WHERE is_seizure) - stddev_samp(value) FILTER (WHERE NOT is_seizure), 6) AS d_sigma
FROM {source} GROUP BY ALL"""


@query("st_delta", with_views(_PS) + _delta_sql("ps", "patient_num"))
def st_delta(spark, sf_dir):
    shifts = statistics.deltas(views.purchase_samples(spark, sf_dir), ["patient_num"])
    return shifts.select("patient_num", rounded("d_mu").alias("d_mu"), rounded("d_sigma").alias("d_sigma"))


def _ks_sql(source: str, keys: str, name: str = "ks") -> str:
    """Expressions for the KS distance and p-value of each group."""
    return f"""
{name}_size AS (
  SELECT {keys}, count(*) FILTER (WHERE is_seizure) AS m1, count(*) FILTER (WHERE NOT is_seizure) AS m0
  FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
{name}_cdf AS (
  SELECT {keys}, value,
    sum(count(*) FILTER (WHERE is_seizure)) OVER (PARTITION BY {keys} ORDER BY value) AS c1,
    sum(count(*) FILTER (WHERE NOT is_seizure)) OVER (PARTITION BY {keys} ORDER BY value) AS c0
  FROM {source} WHERE value IS NOT NULL GROUP BY {keys}, value),
{name}_d AS (
  SELECT {keys}, max(abs(c1 / m1 - c0 / m0)) AS d, any_value(m1) AS m1, any_value(m0) AS m0
  FROM {name}_cdf JOIN {name}_size USING ({keys}) WHERE m1 > 0 AND m0 > 0 GROUP BY ALL),
{name}_x AS (SELECT *, d * sqrt(CAST(m1 AS DOUBLE) * m0 / (m1 + m0)) AS x FROM {name}_d),
{name} AS (SELECT {keys}, d, {kolmogorov_sql("x")} AS p FROM {name}_x)"""


@query(
    "st_ks",
    with_views(_PS, _ks_sql("ps", "patient_num"))
    + "SELECT patient_num, round(d, 6) AS d, round(p, 6) AS p FROM ks",
)
def st_ks(spark, sf_dir):
    tests = statistics.kolmogorov_smirnov(views.purchase_samples(spark, sf_dir), ["patient_num"])
    return tests.select("patient_num", rounded("d").alias("d"), rounded("p").alias("p"))


@query(
    "st_mannwhitney",
    with_views(
        _PS,
        """
rk AS (
  SELECT patient_num, value, is_seizure, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r, count(*) OVER t AS ties
  FROM ps WINDOW w AS (PARTITION BY patient_num ORDER BY value), t AS (PARTITION BY patient_num, value)),
mw AS (
  SELECT patient_num, sum(r) FILTER (WHERE is_seizure) - count(*) FILTER (WHERE is_seizure)
      * (count(*) FILTER (WHERE is_seizure) + 1) / 2.0 AS u,
    CAST(count(*) FILTER (WHERE is_seizure) AS DOUBLE) AS m1, CAST(count(*) FILTER (WHERE NOT is_seizure) AS DOUBLE) AS m0,
    sum(CAST(ties AS DOUBLE) * ties - 1) AS tie,
    avg(value) FILTER (WHERE is_seizure) - avg(value) FILTER (WHERE NOT is_seizure) AS effect
  FROM rk GROUP BY 1),
zs AS (
  SELECT *, abs(u - m1 * m0 / 2 - 0.5 * sign(u - m1 * m0 / 2))
    / sqrt(m1 * m0 / 12 * (m1 + m0 + 1 - tie / ((m1 + m0) * (m1 + m0 - 1)))) AS z FROM mw)""",
    )
    + f"""
SELECT patient_num, round(u, 3) AS u, round({two_sided_normal_sql("z")}, 6) AS p, round(effect, 6) AS mean_effect FROM zs""",
)
def st_mannwhitney(spark, sf_dir):
    tests = statistics.mann_whitney(views.purchase_samples(spark, sf_dir), ["patient_num"])
    return tests.select(
        "patient_num", rounded("u", 3).alias("u"), rounded("p").alias("p"), rounded("mean_effect").alias("mean_effect")
    )


@query(
    "st_quantiles",
    """
SELECT event_type, round(quantile_cont(value, 0.09), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1,
  round(quantile_cont(value, 0.93), 6) AS q2 FROM events GROUP BY 1""",
)
def st_quantiles(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_type", "value")
    found = statistics.quantiles(events, ["event_type"], [0.09, 0.5, 0.93])
    return found.select("event_type", *[rounded(f"q{i}").alias(f"q{i}") for i in range(3)])


@query(
    "st_box_table",
    """
SELECT l_returnflag, round(min(l_extendedprice), 6) AS low, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75,
  round(max(l_extendedprice), 6) AS high FROM lineitem GROUP BY 1""",
)
def st_box_table(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    boxes = statistics.box_table(lines, ["l_returnflag"], "l_extendedprice")
    return boxes.select("l_returnflag", *[rounded(c).alias(c) for c in ("low", "q25", "median", "q75", "high")])


def _width(alias: str) -> str:
    return f"""CASE WHEN {alias}.n <= 1 THEN 0.9 ELSE 0.9 * (
      CASE WHEN least({alias}.sd, {alias}.iqr) = 0 THEN CASE WHEN {alias}.sd = 0 THEN 1.0 ELSE {alias}.sd END
      ELSE least({alias}.sd, {alias}.iqr) END) * pow({alias}.n, -0.2) END"""


def _kde_sql(source: str, keys: str, points: int = POINTS) -> str:
    """Expressions for both densities of each group on the group's periodic grid."""
    moments = """count(*) AS n, coalesce(stddev_samp(value), 0.0) AS sd, min(value) AS lo, max(value) AS hi,
    (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr"""
    return f"""
kd AS (SELECT * FROM {source} WHERE value IS NOT NULL),
pool AS (SELECT {keys}, {moments} FROM kd GROUP BY ALL),
grid AS (
  SELECT {keys}, p.lo - 4.0 * {_width("p")} AS x0, (p.hi - p.lo + 2 * 4.0 * {_width("p")}) / {points - 1} AS step FROM pool p),
side AS (SELECT {keys}, is_seizure, n, {_width("s")} AS h
  FROM (SELECT {keys}, is_seizure, {moments} FROM kd GROUP BY ALL) s),
cells AS (
  SELECT {keys}, is_seizure, cell, sum(w) AS w FROM (
    SELECT {keys}, is_seizure, floor((value - x0) / step) AS cell,
      1 - ((value - x0) / step - floor((value - x0) / step)) AS w FROM kd JOIN grid USING ({keys})
    UNION ALL
    SELECT {keys}, is_seizure, floor((value - x0) / step) + 1,
      (value - x0) / step - floor((value - x0) / step) FROM kd JOIN grid USING ({keys}))
  GROUP BY ALL),
dens AS (
  SELECT {keys}, is_seizure, g.i, any_value(x0) + g.i * any_value(step) AS x,
    sum(w * ({" + ".join(f"exp(-0.5 * pow((g.i - cell + {k * points}) * step / h, 2))" for k in (-1, 0, 1))}))
      / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM cells JOIN side USING ({keys}, is_seizure) JOIN grid USING ({keys})
  CROSS JOIN (SELECT unnest(range(0, {points})) AS i) g
  GROUP BY {keys}, is_seizure, g.i),
prob AS (SELECT *, density / sum(density) OVER (PARTITION BY {keys}, is_seizure) AS p FROM dens),
js AS (
  SELECT {keys}, sqrt(sum(
    (CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END)
    + (CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END)) / 2) AS js
  FROM (SELECT * FROM prob WHERE is_seizure) a JOIN (SELECT * FROM prob WHERE NOT is_seizure) b USING ({keys}, i)
  GROUP BY ALL)"""


@query(
    "st_kde",
    with_views(_PS, _kde_sql("ps", "patient_num"))
    + "SELECT patient_num, is_seizure, round(x, 6) + 0.0 AS x, round(density, 6) + 0.0 AS density FROM dens",
)
def st_kde(spark, sf_dir):
    found = statistics.kernel_densities(views.purchase_samples(spark, sf_dir), ["patient_num"], points=POINTS)
    return found.select("patient_num", "is_seizure", rounded("x").alias("x"), rounded("density").alias("density"))


@query("st_jsd", with_views(_PS, _kde_sql("ps", "patient_num")) + "SELECT patient_num, round(js, 6) AS js FROM js")
def st_jsd(spark, sf_dir):
    found = statistics.js_distance(views.purchase_samples(spark, sf_dir), ["patient_num"], points=POINTS)
    return found.select("patient_num", rounded("js").alias("js"))


@query(
    "st_signif",
    with_views(_PS, _ks_sql("ps", "patient_num"))
    + """
SELECT patient_num, CASE WHEN p > 0.05 / 8 THEN 'NS' WHEN p > 0.01 / 8 THEN '* 0.05/8'
  WHEN p > 0.001 / 8 THEN '** 0.01/8' WHEN p > 0.0001 / 8 THEN '*** 0.001/8' ELSE '**** 0.0001/8' END AS significance
FROM ks""",
)
def st_signif(spark, sf_dir):
    tests = statistics.kolmogorov_smirnov(views.purchase_samples(spark, sf_dir), ["patient_num"])
    return tests.select("patient_num", significance("p", 8).alias("significance"))


_DIFFERENCES = [
    "signal", "reviewers", "artifacts", _runs(2), runs_sql("bad", "art", "idx", "flag"), _event_bounds(),
    epochs_sql("wide_z", "runs", 2, "0.0", "(SELECT n - 1 FROM len)"),
    epochs_sql("wide_a", "bad", 2, "0.0", "(SELECT n - 1 FROM len)"),
    "busy AS (SELECT * FROM wide_z UNION ALL SELECT * FROM wide_a)", merge_sql("taken", "busy"),
    invert_sql("free", "taken", "ends"),
    """
samples AS (
  SELECT patient_num, channel, value, TRUE AS is_seizure FROM sig s WHERE value IS NOT NULL AND EXISTS (
    SELECT 1 FROM runs r WHERE r.patient_num = s.patient_num AND r.on_s <= s.idx + 1 AND s.idx + 1 < r.off_s)
  UNION ALL
  SELECT patient_num, channel, value, FALSE FROM sig s WHERE value IS NOT NULL AND EXISTS (
    SELECT 1 FROM free r WHERE r.patient_num = s.patient_num AND r.on_s <= s.idx + 1 AND s.idx + 1 < r.off_s)),
enough AS (
  SELECT patient_num FROM samples GROUP BY 1
  HAVING count(*) FILTER (WHERE is_seizure) >= 5 * 10 AND count(*) FILTER (WHERE NOT is_seizure) > 0),
held AS (SELECT * FROM samples SEMI JOIN enough USING (patient_num))""",
]


def comparison_samples(spark, sf_dir):
    return epoch_samples(
        views.event_signal(spark, sf_dir),
        seizures(spark, sf_dir, 2),
        intervals.runs(views.artifact_flags(spark, sf_dir)),
        views.event_recordings(spark, sf_dir),
        epoch_s=2,
        min_snippets=10,
        block_s=16.0,
    )


@query(
    "st_epoch_differences",
    with_views(*_DIFFERENCES, _ks_sql("held", "patient_num, channel"), _kde_sql("held", "patient_num, channel", 2048))
    + f"""
SELECT patient_num, channel, round(js, 4) AS js, round(p, 6) AS p, d_mu, d_sigma FROM js
JOIN ks USING (patient_num, channel)
JOIN ({_delta_sql("held", "patient_num, channel")}) USING (patient_num, channel)""",
)
def st_epoch_differences(spark, sf_dir):
    """Seizure against control per patient and channel: JS, KS p, shifts of mean and spread."""
    found = epoch_differences(comparison_samples(spark, sf_dir))
    return found.select(
        "patient_num", "channel", rounded("js", 4).alias("js"),
        *[rounded(c).alias(c) for c in ("p", "d_mu", "d_sigma")],
    )


_SHIFTS = """
shifts AS (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, event_type AS channel, avg(value) AS d_mu, stddev_samp(value) AS d_sigma
  FROM events GROUP BY 1, 2)"""


def event_shifts(spark, sf_dir):
    return (
        views.table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 8).cast("int").alias("patient_num"), F.col("event_type").alias("channel"))
        .agg(F.avg("value").alias("d_mu"), F.stddev_samp("value").alias("d_sigma"))
    )


@query(
    "rel_group_norm",
    with_views(_SHIFTS)
    + """
SELECT patient_num, channel, round(d_mu / stddev_samp(d_mu) OVER c, 5) AS d_mu_z,
  round(d_sigma / stddev_samp(d_sigma) OVER c, 5) AS d_sigma_z
FROM shifts WINDOW c AS (PARTITION BY channel)""",
)
def rel_group_norm(spark, sf_dir):
    scaled = statistics.normalize_by_group(event_shifts(spark, sf_dir), "channel", ["d_mu", "d_sigma"])
    return scaled.select(
        "patient_num", "channel", rounded("d_mu_z", 5).alias("d_mu_z"), rounded("d_sigma_z", 5).alias("d_sigma_z")
    )


@query(
    "rel_group_summary",
    with_views(_SHIFTS)
    + """
SELECT channel, round(stddev_samp(d_mu), 6) AS d_mu_std, round(stddev_samp(d_sigma), 6) AS d_sigma_std,
  round(avg(d_mu), 6) AS d_mu_mean, round(avg(d_sigma), 6) AS d_sigma_mean FROM shifts GROUP BY 1""",
)
def rel_group_summary(spark, sf_dir):
    values = ("d_mu", "d_sigma")
    return event_shifts(spark, sf_dir).groupBy("channel").agg(
        *[rounded(F.stddev_samp(v)).alias(f"{v}_std") for v in values],
        *[rounded(F.avg(v)).alias(f"{v}_mean") for v in values],
    )


_TESTED = [
    """
ps AS (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, event_type AS channel, value, epoch_us(ts) % 3 = 0 AS is_seizure
  FROM events)"""
]


def channel_samples(spark, sf_dir):
    """Event values per channel, those at every third microsecond against the rest."""
    return views.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("patient_num"),
        F.col("event_type").alias("channel"),
        "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) % 3 == 0).alias("is_seizure"),
    )


@query(
    "st_significance_table",
    with_views(*_TESTED, _ks_sql("ps", "patient_num, channel"), f"dl AS ({_delta_sql('ps', 'patient_num, channel')})")
    + """
SELECT patient_num, channel, round(d_mu / stddev_samp(d_mu) OVER c, 3) AS d_mu_z,
  round(d_sigma / stddev_samp(d_sigma) OVER c, 3) AS d_sigma_z,
  CASE WHEN p > 0.05 / 5 THEN 'NS' WHEN p > 0.01 / 5 THEN '* 0.05/5'
    WHEN p > 0.001 / 5 THEN '** 0.01/5' WHEN p > 0.0001 / 5 THEN '*** 0.001/5' ELSE '**** 0.0001/5' END AS significance,
  round(log10(abs(log10(p))), 5) + 0.0 AS height
FROM ks JOIN dl USING (patient_num, channel) WINDOW c AS (PARTITION BY channel)""",
)
def st_significance_table(spark, sf_dir):
    samples = channel_samples(spark, sf_dir)
    groups = ["patient_num", "channel"]
    tests = join_on(statistics.kolmogorov_smirnov(samples, groups), statistics.deltas(samples, groups), groups)
    tests = tests.withColumns({c: rounded(c) for c in ("d_mu", "d_sigma")})
    shown = statistics.significance_table(tests)
    return shown.select(
        *groups, rounded("d_mu_z", 3).alias("d_mu_z"), rounded("d_sigma_z", 3).alias("d_sigma_z"),
        "significance", rounded("height", 5).alias("height"),
    )


_EFFECTS = [
    *_TESTED, _ks_sql("ps", "channel"), f"dl AS ({_delta_sql('ps', 'channel')})",
    """
eff AS (
  SELECT channel, row_number() OVER (ORDER BY channel) AS class, p, d_mu FROM ks JOIN dl USING (channel))""",
]


def class_effects(spark, sf_dir):
    samples = channel_samples(spark, sf_dir)
    tests = statistics.kolmogorov_smirnov(samples, ["channel"]).join(statistics.deltas(samples, ["channel"]), "channel")
    # one row per channel
    return tests.withColumn("class", F.row_number().over(Window.orderBy("channel")))


@query(
    "st_class_weights",
    with_views(*_EFFECTS)
    + """
SELECT channel, round(w / sqrt(sum(w * w) OVER ()), 6) + 0.0 AS weight FROM (
  SELECT channel, CASE WHEN row_number() OVER (ORDER BY p, d_mu, class) <= 3 THEN sign(d_mu) ELSE 0.0 END AS w FROM eff)""",
)
def st_class_weights(spark, sf_dir):
    weights = statistics.class_weights(class_effects(spark, sf_dir), 3)
    return weights.select("channel", rounded("weight").alias("weight"))


@query(
    "st_first_class_weights",
    with_views(*_EFFECTS)
    + "SELECT channel, CASE WHEN class = 1 THEN CAST(sign(d_mu) AS DOUBLE) ELSE 0.0 END AS weight FROM eff",
)
def st_first_class_weights(spark, sf_dir):
    weights = statistics.first_class_weights(class_effects(spark, sf_dir))
    return weights.select("channel", rounded("weight").alias("weight"))


@query("rel_distinct_labels", "SELECT DISTINCT lower(text) AS label FROM documents")
def rel_distinct_labels(spark, sf_dir):
    return annotations.distinct_labels(document_events(spark, sf_dir))
