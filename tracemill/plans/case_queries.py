"""Control against seizure snippets, cut from recordings at sampled starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.operators import annotations, intervals, signal, statistics, tables, tricorr
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.tricorr_queries import _brute
from tracemill.session import cut_lineage
from tracemill.plans.views import invert_sql, merge_sql, runs_sql, with_views

RATE = 50  # orders per second of the order recordings
SAMPLES = 5
LOUD = 1.1


def order_flags(spark, sf_dir):
    """Three reviewers, each minding every third part group, mark seconds that ship more than usual."""
    sums = views.order_seconds(spark, sf_dir, RATE, 3).withColumnsRenamed({"idx": "sec", "group": "reviewer"})
    usual = sums.groupBy("patient_num", "reviewer").agg(F.avg("q").alias("m"))
    flag = (F.col("q") > LOUD * F.col("m")).cast("int").alias("flag")
    return sums.join(usual, ["patient_num", "reviewer"]).select("patient_num", "reviewer", "sec", flag)


def order_seizures(spark, sf_dir):
    counts = annotations.count_flags(order_flags(spark, sf_dir))
    return intervals.runs(counts.select("patient_num", F.col("sec").alias("idx"), (F.col("n") >= 2).alias("flag")))


def order_artifacts(spark, sf_dir):
    """Seconds that ship under half of the usual."""
    sums = views.order_seconds(spark, sf_dir, RATE).drop("group")
    usual = sums.groupBy("patient_num").agg(F.avg("q").alias("m"))
    flags = sums.join(usual, "patient_num").select("patient_num", "idx", (F.col("q") < F.col("m") / 2).alias("flag"))
    return intervals.runs(flags)


def order_recordings(spark, sf_dir):
    return views.order_tops(spark, sf_dir).select(
        "patient_num", F.lit(RATE).alias("sample_rate"), F.lit(0.0).alias("start_s"),
        F.floor((F.col("top") + 1) / RATE).cast("double").alias("duration_s"),
    )


def sampled_starts(spark, sf_dir):
    """`SAMPLES` control and up to as many seizure starts of each recording that has enough controls."""
    # a few intervals a recording, read from several branches of what follows
    seizing, quiet = (cut_lineage(f(spark, sf_dir)) for f in (order_seizures, order_artifacts))
    free = cut_lineage(intervals.control_bounds(seizing, quiet, order_recordings(spark, sf_dir), 1))

    def starts(df):
        found = intervals.snippet_starts(df, 1).select("patient_num", F.col("start_s").cast("bigint").alias("start_s"))
        return found.distinct()

    return tables.control_and_seizure_starts(starts(seizing), starts(free), SAMPLES, ["patient_num"])


def case_contributions(spark, sf_dir, measure: str = "A_znorm"):
    """Class contributions of the sampled snippets of a second: patient, case, start, class."""
    starts = sampled_starts(spark, sf_dir).withColumn("first", F.col("start_s") * RATE)
    cut = signal.snippets_at(views.order_steps(spark, sf_dir), starts, RATE, identity=["case"])
    return tricorr.contributions_of(tricorr.dealt(cut, ["patient_num", "case"]), (1, 2), measure, keys=("patient_num", "case"))


_CASES = [
    "lines",
    f"""
sums AS (SELECT patient_num, idx // {RATE} AS sec, channel % 3 AS g, sum(value) AS q FROM osig GROUP BY ALL),
usual AS (SELECT patient_num, g, avg(q) AS m FROM sums GROUP BY ALL),
marks AS (
  SELECT patient_num, sec AS idx, count(*) FILTER (WHERE q > {LOUD} * m) >= 2 AS flag FROM sums JOIN usual USING (patient_num, g) GROUP BY 1, 2)""",
    runs_sql("runs", "marks", "idx", "flag"),
    """
whole AS (SELECT patient_num, sec AS idx, sum(q) AS q FROM sums GROUP BY 1, 2),
quiet AS (SELECT patient_num, idx, q < avg(q) OVER (PARTITION BY patient_num) / 2 AS flag FROM whole)""",
    runs_sql("bad", "quiet", "idx", "flag"),
    f"""
ends AS (SELECT patient_num, 0.0::DOUBLE AS start_s, CAST((max(idx) + 1) // {RATE} AS DOUBLE) AS stop_s, max(idx) AS top FROM osig GROUP BY 1),
busy AS (
  SELECT patient_num, greatest(on_s, start_s) AS on_s, least(off_s, stop_s) AS off_s FROM (
    SELECT patient_num, on_s - 1 AS on_s, off_s + 1 AS off_s FROM runs UNION ALL SELECT * FROM bad)
  JOIN ends USING (patient_num) WHERE off_s > start_s AND on_s < stop_s)""",
    merge_sql("merged", "busy"),
    invert_sql("free", "merged", "ends"),
    f"""
zs AS (SELECT DISTINCT patient_num, CAST(on_s AS BIGINT) + unnest(range(0, CAST(off_s - on_s AS BIGINT) + 1)) AS start_s FROM runs),
cs AS (SELECT DISTINCT patient_num, CAST(on_s AS BIGINT) + unnest(range(0, CAST(off_s - on_s AS BIGINT) + 1)) AS start_s FROM free),
fit AS (SELECT patient_num FROM cs GROUP BY 1 HAVING count(*) > {SAMPLES}),
both_cases AS (SELECT *, 1 AS "case" FROM cs UNION ALL SELECT *, 2 FROM zs),
picked AS (
  SELECT patient_num, start_s, "case" FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_num, "case"
      ORDER BY md5(CASE "case" WHEN 1 THEN '1:' ELSE '0:' END || patient_num || ':' || start_s)) AS k
    FROM both_cases SEMI JOIN fit USING (patient_num)) WHERE k <= {SAMPLES}),
cut AS (
  SELECT p.patient_num, p."case" * 1000000 + p.start_s * {RATE} AS snippet, o.channel AS r, o.idx - p.start_s * {RATE} AS t, o.value AS v
  FROM picked p JOIN ends e ON e.patient_num = p.patient_num
  JOIN osig o ON o.patient_num = p.patient_num AND o.idx // {RATE} = p.start_s
  WHERE (p.start_s + 1) * {RATE} <= e.top + 1),
named AS (SELECT patient_num * 100000000 + snippet AS snippet, patient_num, r, t, v FROM cut),
zcut AS (
  SELECT patient_num, snippet, r, t, (v - avg(v) OVER s) / stddev_samp(v) OVER s AS v FROM named WINDOW s AS (PARTITION BY snippet))""",
    _brute(1, 2, True, "zcut", (views.ORDER_CHANNELS, RATE)),
    """
found AS (
  SELECT patient_num, (idx % 100000000) // 1000000 AS "case", idx % 1000000 AS first, CAST(channel AS INT) AS class, value FROM brute)""",
]


@query(
    "st_case_snippets",
    with_views(*_CASES) + 'SELECT patient_num, CAST("case" AS INT) AS "case", first, class, round(value, 4) + 0.0 AS value FROM found',
)
def st_case_snippets(spark, sf_dir):
    """Contributions of every sampled snippet, control and seizure."""
    found = case_contributions(spark, sf_dir)
    return found.select("patient_num", "case", F.col("idx").alias("first"), F.col("channel").alias("class"), rounded("value", 4).alias("value"))


# U of every choice of m of the first m + n whole numbers stands for the null distribution without ties.
_EXACT = f"""
sized AS (
  SELECT patient_num, class, count(*) FILTER (WHERE "case" = 2) AS m, count(*) FILTER (WHERE "case" = 1) AS n,
    count(DISTINCT round(value, 9)) AS k, avg(value) FILTER (WHERE "case" = 2) - avg(value) FILTER (WHERE "case" = 1) AS effect
  FROM found GROUP BY 1, 2),
us AS (
  SELECT a.patient_num, a.class, CAST(sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS DOUBLE) AS u
  FROM found a JOIN found b USING (patient_num, class) WHERE a."case" = 2 AND b."case" = 1 GROUP BY 1, 2),
shapes AS (SELECT DISTINCT m, n FROM sized),
choices AS (SELECT m, n, bits FROM shapes, range(0, {1 << (2 * SAMPLES)}) q(bits) WHERE bits < (1 << CAST(m + n AS INT)) AND bit_count(bits) = m),
null_u AS (
  SELECT m, n, bits, sum(CASE WHEN (bits >> CAST(i AS INT)) & 1 = 1 THEN i + 1 ELSE 0 END) - m * (m + 1) / 2.0 AS u
  FROM choices, range(0, {2 * SAMPLES}) q(i) GROUP BY m, n, bits)
SELECT patient_num, class, u, round(CAST(least(1.0, 2 * least(
    (SELECT avg(CASE WHEN e.u <= us.u THEN 1.0 ELSE 0.0 END) FROM null_u e WHERE e.m = sized.m AND e.n = sized.n),
    (SELECT avg(CASE WHEN e.u >= us.u THEN 1.0 ELSE 0.0 END) FROM null_u e WHERE e.m = sized.m AND e.n = sized.n))) AS DOUBLE), 6) AS p,
  round(effect, 4) + 0.0 AS mean_effect, true AS exact
FROM sized JOIN us USING (patient_num, class)"""


@query("st_case_contributions", with_views(*_CASES).rstrip() + "," + _EXACT)
def st_case_contributions(spark, sf_dir):
    """Seizure against control contributions of each recording and class; few values, so p is exact."""
    cases = case_contributions(spark, sf_dir).select(
        "patient_num", F.col("channel").alias("class"), "value", (F.col("case") == 2).alias("is_seizure")
    )
    # a few values a recording and class, read by every part of the test
    cases = cut_lineage(cases)
    tests = statistics.mann_whitney(cases, ["patient_num", "class"])
    return tests.select("patient_num", "class", "u", rounded("p").alias("p"), rounded("mean_effect", 4).alias("mean_effect"), "exact")
