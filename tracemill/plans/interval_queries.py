"""Queries on annotation intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.functions.scalar import contains_any, parse_duration, parse_grade, parse_start
from tracemill.operators import annotations, intervals, signal
from tracemill.operators.detection import negative_hours
from tracemill.operators.tables import union_all
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.views import collapse_sql, invert_sql, merge_sql, runs_sql, with_views

BOUNDS = ("patient_num", "on_s", "off_s")


def _runs(at_least: int, name: str = "runs") -> str:
    source = f"flags_{name} AS (SELECT patient_num, sec AS idx, n >= {at_least} AS flag FROM rc)"
    return source + "," + runs_sql(name, f"flags_{name}", "idx", "flag")


def _event_bounds() -> str:
    return """
ends AS (SELECT DISTINCT patient_num, 0.0::DOUBLE AS start_s, (SELECT n FROM len)::DOUBLE AS stop_s FROM ev)"""


def event_ends(spark, sf_dir):
    return views.event_recordings(spark, sf_dir).select(
        "patient_num", "start_s", F.col("duration_s").alias("stop_s")
    )


def seizures(spark, sf_dir, at_least: int = 2):
    flags = views.reviewer_counts(spark, sf_dir).select(
        "patient_num", F.col("sec").alias("idx"), (F.col("n") >= at_least).alias("flag")
    )
    return intervals.runs(flags)


@query("iv_reviewer_counts", with_views("signal", "reviewers") + "SELECT patient_num, sec, n FROM rc")
def iv_reviewer_counts(spark, sf_dir):
    return views.reviewer_counts(spark, sf_dir)


@query("iv_unanimous", with_views("signal", "reviewers") + "SELECT patient_num, sec, n = 3 AS unanimous FROM rc")
def iv_unanimous(spark, sf_dir):
    return annotations.unanimous_flags(views.reviewer_flags(spark, sf_dir))


@query("iv_runs", with_views("signal", "reviewers", _runs(1)) + "SELECT patient_num, on_s, off_s FROM runs")
def iv_runs(spark, sf_dir):
    return seizures(spark, sf_dir, 1)


_SNAPPED = """
snapped AS (
  SELECT patient_num, greatest(0.0, floor(on_s / 3) * 3.0) AS on_s,
    least((SELECT n FROM len), ceil(off_s / 3) * 3.0) AS off_s FROM runs)"""


@query(
    "iv_consensus",
    with_views("signal", "reviewers", _runs(2), _SNAPPED, merge_sql("merged", "snapped"))
    + "SELECT patient_num, on_s, off_s FROM merged",
)
def iv_consensus(spark, sf_dir):
    return annotations.consensus_intervals(
        views.reviewer_counts(spark, sf_dir), 2, 3, event_ends(spark, sf_dir)
    )


@query(
    "iv_buffer",
    """
SELECT o_orderkey, CAST(o_orderkey - 1 AS DOUBLE) AS on_s, CAST(o_orderkey + d + 1 AS DOUBLE) AS off_s
FROM (SELECT o_orderkey, floor(o_totalprice / 100000) AS d FROM orders)""",
)
def iv_buffer(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    duration = F.floor(F.col("o_totalprice") / 100_000).cast("double")
    bounds = intervals.buffered(F.col("o_orderkey").cast("double"), duration)
    return orders.select("o_orderkey", bounds.alias("b")).select("o_orderkey", "b.on_s", "b.off_s")


@query(
    "iv_collapse",
    with_views("orders", collapse_sql("joined", "oi")) + "SELECT patient_num, on_s, off_s FROM joined",
)
def iv_collapse(spark, sf_dir):
    return intervals.collapse(views.order_intervals(spark, sf_dir))


@query("iv_merge", with_views("orders", merge_sql("merged", "oi")) + "SELECT patient_num, on_s, off_s FROM merged")
def iv_merge(spark, sf_dir):
    return intervals.merge(views.order_intervals(spark, sf_dir))


@query(
    "iv_merge_null_keys",
    with_views(
        "orders",
        "nk AS (SELECT CASE WHEN patient_num % 5 <> 0 THEN patient_num END AS patient_num, on_s, off_s FROM oi)",
        merge_sql("merged", "nk"),
    )
    + "SELECT patient_num, on_s, off_s FROM merged",
)
def iv_merge_null_keys(spark, sf_dir):
    """Intervals whose recording is unknown are merged among themselves, not lost."""
    known = F.when(F.col("patient_num") % 5 != 0, F.col("patient_num"))
    return intervals.merge(views.order_intervals(spark, sf_dir).withColumn("patient_num", known))


@query(
    "iv_merge_sets",
    with_views(
        "signal", "reviewers", "artifacts", _runs(2), runs_sql("bad", "art", "idx", "flag"),
        "both_sets AS (SELECT * FROM runs UNION ALL SELECT * FROM bad)", merge_sql("merged", "both_sets"),
    )
    + "SELECT patient_num, on_s, off_s FROM merged",
)
def iv_merge_sets(spark, sf_dir):
    bad = intervals.runs(views.artifact_flags(spark, sf_dir))
    return intervals.merge_sets(seizures(spark, sf_dir), bad)


@query(
    "iv_invert",
    with_views(
        "orders", merge_sql("merged", "oi"),
        "ends AS (SELECT DISTINCT patient_num, 0.0::DOUBLE AS start_s, 2500.0::DOUBLE AS stop_s FROM oi)",
        invert_sql("gaps", "merged", "ends"),
    )
    + "SELECT patient_num, on_s, off_s FROM gaps",
)
def iv_invert(spark, sf_dir):
    merged = intervals.merge(views.order_intervals(spark, sf_dir))
    ends = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("patient_num")).distinct()
    ends = ends.select("patient_num", F.lit(0.0).alias("start_s"), F.lit(2500.0).alias("stop_s"))
    return intervals.invert(merged, ends)


@query(
    "iv_restrict",
    with_views("orders")
    + """
SELECT patient_num, greatest(on_s, 700.0) AS on_s, least(off_s, 702.0) AS off_s FROM oi
WHERE on_s BETWEEN 700 AND 702 OR off_s BETWEEN 700 AND 702""",
)
def iv_restrict(spark, sf_dir):
    return intervals.restrict(views.order_intervals(spark, sf_dir), F.lit(700.0), F.lit(702.0))


@query(
    "iv_restrict_strict",
    with_views("orders")
    + """
SELECT patient_num, greatest(on_s, 700.0) AS on_s, least(off_s, 702.0) AS off_s FROM oi
WHERE on_s <= 702 AND off_s >= 700""",
)
def iv_restrict_strict(spark, sf_dir):
    return intervals.restrict(views.order_intervals(spark, sf_dir), F.lit(700.0), F.lit(702.0), strict=True)


@query(
    "iv_discretize",
    with_views("orders")
    + """
SELECT patient_num, greatest(10.0, floor(on_s / 7) * 7.0) AS on_s, least(2000.0, ceil(off_s / 7) * 7.0) AS off_s
FROM oi""",
)
def iv_discretize(spark, sf_dir):
    return intervals.discretize(views.order_intervals(spark, sf_dir), 7, F.lit(10.0), F.lit(2000.0))


def epochs_sql(name: str, source: str, epoch: int, start: str, stop: str) -> str:
    """Expressions for epochised intervals between two scalar expressions."""
    return f"""
wide_{name} AS (
  SELECT patient_num, greatest(on_s - {epoch}, {start}) AS on_s, least(off_s + {epoch}, {stop}) AS off_s
  FROM {source}),
snap_{name} AS (
  SELECT patient_num, greatest({start}, floor(on_s / {epoch}) * {epoch}.0) AS on_s,
    least({stop}, ceil(off_s / {epoch}) * {epoch}.0) AS off_s FROM wide_{name}),""" + merge_sql(name, f"snap_{name}")


@query(
    "iv_epochize",
    with_views("signal", "reviewers", _runs(3), epochs_sql("epoched", "runs", 4, "0.0", "(SELECT n FROM len)"))
    + "SELECT patient_num, on_s, off_s FROM epoched",
)
def iv_epochize(spark, sf_dir):
    return intervals.epochize(seizures(spark, sf_dir, 3), event_ends(spark, sf_dir), 4)


_BINS = """
grid AS (SELECT DISTINCT patient_num, CAST(ceil((SELECT n FROM len) / 4.0) AS BIGINT) AS nb FROM ev),
starts AS (SELECT patient_num, nb, unnest(range(0, nb)) AS bin FROM grid),
hits AS (
  SELECT r.patient_num, r.on_s, r.off_s, any_value(s.nb) AS nb,
    coalesce(max(s.bin) FILTER (WHERE s.bin * 4.0 <= r.on_s), 0) AS first_bin,
    coalesce(min(s.bin) FILTER (WHERE s.bin * 4.0 >= r.off_s), any_value(s.nb)) - 1 AS last_bin
  FROM runs r JOIN starts s USING (patient_num) GROUP BY 1, 2, 3)"""


def event_grid(spark, sf_dir):
    return event_ends(spark, sf_dir).select(
        "patient_num", F.lit(0.0).alias("first_s"), F.ceil(F.col("stop_s") / 4).cast("bigint").alias("n_bins")
    )


@query(
    "iv_containing_bins",
    with_views("signal", "reviewers", _runs(1), _BINS)
    + "SELECT patient_num, on_s, off_s, first_bin, last_bin FROM hits WHERE first_bin <> nb - 1",
)
def iv_containing_bins(spark, sf_dir):
    return intervals.containing_bins(seizures(spark, sf_dir, 1), event_grid(spark, sf_dir), 4)


@query(
    "iv_bin_rows",
    with_views("signal", "reviewers", _runs(1), _BINS)
    + """
SELECT patient_num, on_s, off_s, unnest(range(first_bin, last_bin + 1)) AS bin FROM hits WHERE first_bin <> nb - 1""",
)
def iv_bin_rows(spark, sf_dir):
    bins = intervals.containing_bins(seizures(spark, sf_dir, 1), event_grid(spark, sf_dir), 4)
    return intervals.bin_rows(bins)


@query(
    "iv_snippet_starts",
    with_views("orders")
    + """
SELECT patient_num, on_s, off_s, on_s + unnest(range(0, CAST(floor((off_s - on_s) / 2) AS BIGINT) + 1)) * 2.0
  AS start_s FROM oi""",
)
def iv_snippet_starts(spark, sf_dir):
    return intervals.snippet_starts(views.order_intervals(spark, sf_dir), 2)


_CONTROL = [
    "signal", "reviewers", "artifacts", _runs(2), runs_sql("bad", "art", "idx", "flag"), _event_bounds(),
    """
busy AS (
  SELECT patient_num, greatest(on_s, start_s) AS on_s, least(off_s, stop_s) AS off_s FROM (
    SELECT patient_num, on_s - 1 AS on_s, off_s + 1 AS off_s FROM runs UNION ALL SELECT * FROM bad)
  JOIN ends USING (patient_num) WHERE off_s > start_s AND on_s < stop_s)""",
    merge_sql("merged", "busy"), invert_sql("free", "merged", "ends"),
]


def controls(spark, sf_dir):
    return intervals.control_bounds(
        seizures(spark, sf_dir),
        intervals.runs(views.artifact_flags(spark, sf_dir)),
        views.event_recordings(spark, sf_dir),
        1,
    )


@query("iv_control_bounds", with_views(*_CONTROL) + "SELECT patient_num, on_s, off_s FROM free")
def iv_control_bounds(spark, sf_dir):
    return controls(spark, sf_dir)


@query(
    "iv_control_starts",
    with_views(*_CONTROL)
    + """
SELECT patient_num, on_s, off_s, on_s + unnest(range(0, CAST(off_s - on_s AS BIGINT) + 1)) * 1.0 AS start_s
FROM free""",
)
def iv_control_starts(spark, sf_dir):
    return intervals.snippet_starts(controls(spark, sf_dir), 1)


@query(
    "iv_mask_seizure",
    with_views("signal", "reviewers", _runs(2))
    + """
SELECT patient_num, channel, idx, EXISTS (
  SELECT 1 FROM runs r WHERE r.patient_num = s.patient_num AND r.on_s <= s.idx + 1 AND s.idx + 1 < r.off_s) AS hit
FROM sig s""",
)
def iv_mask_seizure(spark, sf_dir):
    """Snippet mask `on <= t + 1 < off`, any interval."""
    timed = views.event_signal(spark, sf_dir).withColumn("t", F.col("idx").cast("double"))
    held = intervals.shifted(seizures(spark, sf_dir))
    return annotations.mark(timed, held, "hit", block_s=16.0, disjoint=True).select("patient_num", "channel", "idx", "hit")


_MASK_CONTROL = """
ons AS (
  SELECT patient_num, p, row_number() OVER (PARTITION BY patient_num ORDER BY p) AS k FROM (
    SELECT patient_num, off_s AS p FROM runs UNION ALL SELECT patient_num, start_s FROM ends)),
offs AS (
  SELECT patient_num, p, row_number() OVER (PARTITION BY patient_num ORDER BY p) AS k FROM (
    SELECT patient_num, on_s AS p FROM runs UNION ALL SELECT patient_num, stop_s FROM ends)),
free AS (SELECT patient_num, ons.p AS on_s, offs.p AS off_s FROM ons JOIN offs USING (patient_num, k))"""


@query(
    "iv_mask_control",
    with_views("signal", "reviewers", _runs(2), _event_bounds(), _MASK_CONTROL)
    + """
SELECT patient_num, channel, idx, EXISTS (
  SELECT 1 FROM free r WHERE r.patient_num = s.patient_num AND r.on_s + 1 <= s.idx + 1 AND s.idx + 1 < r.off_s - 1)
  AS hit FROM sig s""",
)
def iv_mask_control(spark, sf_dir):
    free = intervals.control_bounds_with_artifacts(
        seizures(spark, sf_dir), views.event_recordings(spark, sf_dir)
    )
    timed = views.event_signal(spark, sf_dir).withColumn("t", F.col("idx").cast("double"))
    held = intervals.shifted(free, 1)
    return annotations.mark(timed, held, "hit", block_s=16.0, disjoint=True).select("patient_num", "channel", "idx", "hit")


_EVENTS = """
tal AS (
  SELECT doc_id % 8 AS patient_num, CAST(doc_id // 8 AS DOUBLE) * 4 AS onset, CAST(n_chars % 7 AS DOUBLE) AS dur
  FROM documents WHERE contains(lower(text), 'seizure') OR contains(lower(text), 'epi') OR contains(lower(text), 'ment')),
hits AS (
  SELECT patient_num, CASE WHEN dur > 0 THEN onset ELSE onset - 1 END AS on_s,
    CASE WHEN dur > 0 THEN onset + dur ELSE onset + 1 END AS off_s FROM tal)"""


def document_events(spark, sf_dir):
    """Documents as time-stamped annotation lists."""
    return views.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 8).alias("patient_num"),
        (F.floor(F.col("doc_id") / 8).cast("double") * 4).alias("onset_s"),
        (F.col("n_chars") % 7).cast("double").alias("duration_s"),
        F.array("text").alias("annotations"),
    )


@query(
    "iv_keyword",
    with_views(_EVENTS, collapse_sql("joined", "hits")) + "SELECT patient_num, on_s, off_s FROM joined",
)
def iv_keyword(spark, sf_dir):
    events = annotations.relevant(document_events(spark, sf_dir))
    return annotations.keyword_intervals(events, ("seizure", "epi", "ment"))


_NOTES = """
notes AS (
  SELECT o_custkey % 8 AS patient_num, o_orderkey,
    'Grade ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'II' WHEN '2-HIGH' THEN '2' ELSE '1' END AS txt,
    o_orderkey % 86000 AS s, CAST(floor(o_totalprice / 100000) AS INT) AS d FROM orders),
kept AS (SELECT patient_num, CAST(s - 1 AS DOUBLE) AS on_s, CAST(s + d + 1 AS DOUBLE) AS off_s
  FROM notes WHERE NOT contains(lower(txt), 'grade 2')),
snapped AS (SELECT patient_num, greatest(0.0, floor(on_s / 15) * 15.0) AS on_s,
  least(90000.0, ceil(off_s / 15) * 15.0) AS off_s FROM kept)"""


def order_notes(spark, sf_dir):
    """Orders as artifact notes with a grade, a clock time and a duration in words."""
    grade = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("II"))
    grade = grade.when(F.col("o_orderpriority") == "2-HIGH", F.lit("2")).otherwise("1")
    second = F.col("o_orderkey") % 86_000
    clock = F.concat_ws(
        ":",
        F.lpad(F.floor(second / 3600).cast("string"), 2, "0"),
        F.lpad((F.floor(second / 60) % 60).cast("string"), 2, "0"),
        F.lpad((second % 60).cast("string"), 2, "0"),
    )
    return views.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 8).alias("patient_num"),
        "o_orderkey",
        F.concat(F.lit("Grade "), grade).alias("text"),
        F.concat(F.lit("d1 "), clock).alias("time"),
        F.concat(F.floor(F.col("o_totalprice") / 100_000).cast("string"), F.lit(" sec")).alias("duration"),
    )


@query(
    "iv_artifacts",
    with_views(_NOTES, collapse_sql("joined", "snapped")) + "SELECT patient_num, on_s, off_s FROM joined",
)
def iv_artifacts(spark, sf_dir):
    """Notes of grade 1 (which "Grade II" is read as), buffered, snapped to 15 s, collapsed."""
    notes = order_notes(spark, sf_dir)
    ends = notes.select("patient_num").distinct().select(
        "patient_num", F.lit("00:00:00").alias("start_clock"), F.lit(0.0).alias("start_s"), F.lit(90_000.0).alias("stop_s")
    )
    return annotations.artifact_intervals(notes, ends, (1,), 15)


@query(
    "fn_note_fields",
    """
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 1 END AS grade,
  CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 1 END AS INT) AS strict_grade,
  CAST(o_orderkey % 86000 - 60 AS DOUBLE) AS start_s,
  CAST(floor(o_totalprice / 100000) AS INT) AS duration_s FROM orders""",
)
def fn_note_fields(spark, sf_dir):
    return order_notes(spark, sf_dir).select(
        "o_orderkey",
        parse_grade("text").alias("grade"),
        parse_grade("text", strict=True).alias("strict_grade"),
        parse_start("time", F.lit("00:01:00")).alias("start_s"),
        parse_duration("duration").alias("duration_s"),
    )


@query(
    "iv_negepoch_hours",
    with_views("signal", "reviewers", _runs(1), _BINS)
    + """
SELECT g.patient_num, round((any_value(g.nb) - coalesce(sum(h.last_bin - h.first_bin + 1), 0)) * 4.0 / 3600.0, 6) AS hours
FROM grid g LEFT JOIN (SELECT * FROM hits WHERE first_bin <> nb - 1) h USING (patient_num) GROUP BY 1""",
)
def iv_negepoch_hours(spark, sf_dir):
    hours = negative_hours(seizures(spark, sf_dir, 1), event_grid(spark, sf_dir), 4)
    return hours.select("patient_num", rounded("non_seizure_hours").alias("hours"))


_EACH = """
each AS (
  SELECT e.patient_num, e.stop_s - e.start_s AS dur,
    (SELECT count(*) FROM bad a WHERE a.patient_num = e.patient_num) AS na,
    (SELECT coalesce(sum(off_s - on_s), 0.0) FROM bad a WHERE a.patient_num = e.patient_num) AS sa,
    (SELECT count(*) FROM runs a WHERE a.patient_num = e.patient_num) AS nz,
    (SELECT coalesce(sum(off_s - on_s), 0.0) FROM runs a WHERE a.patient_num = e.patient_num) AS sz
  FROM ends e)"""


@query(
    "iv_summary",
    with_views("signal", "reviewers", "artifacts", _runs(3), runs_sql("bad", "art", "idx", "flag"), _event_bounds(), _EACH)
    + """
SELECT CAST(count(*) AS BIGINT) AS n_patients, CAST(count(*) FILTER (WHERE na > 0) AS BIGINT) AS n_artifact_patients,
  CAST(sum(na) AS BIGINT) AS n_artifacts, round(stddev_samp(na), 6) AS std_n_artifacts,
  round(sum(sa), 6) AS artifacts_duration, round(stddev_samp(sa), 6) AS std_artifacts_duration,
  CAST(count(*) FILTER (WHERE nz > 0) AS BIGINT) AS n_seizing_patients, CAST(sum(nz) AS BIGINT) AS n_seizures,
  round(stddev_samp(nz) FILTER (WHERE nz > 0), 6) AS std_n_seizures, round(sum(sz), 6) AS seizures_duration,
  round(stddev_samp(sz) FILTER (WHERE nz > 0), 6) AS std_seizures_duration,
  round(sum(dur), 6) AS total_duration, round(stddev_samp(dur), 6) AS std_total_duration FROM each""",
)
def iv_summary(spark, sf_dir):
    stats = intervals.summary(
        views.event_recordings(spark, sf_dir),
        seizures(spark, sf_dir, 3),
        intervals.runs(views.artifact_flags(spark, sf_dir)),
    )
    doubles = [f.name for f in stats.schema.fields if f.dataType.simpleString() == "double"]
    return stats.withColumns({c: rounded(c) for c in doubles})


@query(
    "fn_contains_any",
    "SELECT doc_id, contains(lower(text), 'seizure') OR contains(lower(text), 'tion') AS hit FROM documents",
)
def fn_contains_any(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", contains_any("text", ("Seizure", "TION")).alias("hit"))


def _snip_tables(spark, sf_dir):
    return signal.snip(
        views.event_signal(spark, sf_dir),
        seizures(spark, sf_dir),
        views.reviewer_counts(spark, sf_dir),
        views.event_recordings(spark, sf_dir),
        20,
        500,
    )


@query(
    "iv_snip",
    with_views("signal", "reviewers", _runs(2), _event_bounds())
    + """
SELECT 'samples' AS part, patient_num, channel AS label, CAST(idx - 20 AS DOUBLE) AS a, round(value, 6) + 0.0 AS b FROM sig WHERE idx >= 20
UNION ALL
SELECT 'intervals', patient_num, NULL, greatest(on_s, 20.0), least(off_s, stop_s) FROM runs JOIN ends USING (patient_num)
WHERE on_s BETWEEN 20 AND stop_s OR off_s BETWEEN 20 AND stop_s
UNION ALL
SELECT 'reviewers', patient_num, NULL, CAST(sec AS DOUBLE), CAST(n AS DOUBLE) FROM rc WHERE sec >= 20
UNION ALL
SELECT 'recordings', patient_num, NULL, 20.0, stop_s - 20.0 FROM ends""",
)
def iv_snip(spark, sf_dir):
    """All four tables cut to the stretch from 20 on; the far end is pulled back to the data's."""
    cut = _snip_tables(spark, sf_dir)

    def part(name, a, b, label=None):
        rows = cut[name.replace("reviewers", "reviewer_counts")]
        named = F.col(label) if label else F.lit(None).cast("string")
        numbers = [F.col(a).cast("double").alias("a"), rounded(b).alias("b")]
        return rows.select(F.lit(name).alias("part"), "patient_num", named.alias("label"), *numbers)

    return union_all(
        [
            part("samples", "idx", "value", "channel"),
            part("intervals", "on_s", "off_s"),
            part("reviewers", "sec", "n"),
            part("recordings", "start_s", "duration_s"),
        ]
    )


@query(
    "iv_widen_snip",
    with_views(
        "signal", "reviewers", _runs(3),
        """
wide AS (SELECT patient_num, on_s, off_s, greatest(0.0, on_s - (20 - (off_s - on_s)) / 2) AS wide_on FROM runs),
wider AS (SELECT *, off_s + (20 - (off_s - wide_on)) AS wide_off FROM wide)""",
    )
    + """
SELECT s.patient_num, w.on_s, w.off_s, s.channel, s.idx FROM wider w
JOIN sig s ON s.patient_num = w.patient_num AND w.wide_on <= s.idx AND s.idx <= w.wide_off""",
)
def iv_widen_snip(spark, sf_dir):
    """Samples around each interval, widened to about twenty steps."""
    timed = views.event_signal(spark, sf_dir).withColumn("t", F.col("idx").cast("double"))
    found = signal.widen_and_snip(timed, seizures(spark, sf_dir, 3), 20)
    return found.select("patient_num", "on_s", "off_s", "channel", "idx")
