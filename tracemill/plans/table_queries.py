"""Queries on tables, labels and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import scalar
from tracemill.functions.nulls import rounded
from tracemill.operators import annotations, intervals, signal, statistics, tables
from tracemill.operators.scan import running, value_blocks
from tracemill.plans import views
from tracemill.plans.interval_queries import _CONTROL, _runs, controls, document_events, seizures
from tracemill.plans.registry import query
from tracemill.plans.views import with_views
from tracemill.session import cut_lineage


@query("rel_channels", with_views("signal") + "SELECT DISTINCT channel FROM sig")
def rel_channels(spark, sf_dir):
    return signal.channel_names(views.event_signal(spark, sf_dir))


@query(
    "rel_drop_channels",
    with_views("signal")
    + """
SELECT patient_num, channel, idx, round(value, 6) + 0.0 AS value FROM sig
WHERE NOT (contains(lower(channel), 'up') OR contains(lower(channel), 'err'))""",
)
def rel_drop_channels(spark, sf_dir):
    kept = signal.drop_channels(views.event_signal(spark, sf_dir), ("UP", "err"))
    return kept.select("patient_num", "channel", "idx", rounded("value").alias("value"))


@query(
    "rel_drop_listed_channels",
    with_views("signal")
    + """
SELECT patient_num, channel, idx, round(value, 6) + 0.0 AS value FROM sig
WHERE NOT contains(lower(channel), CASE WHEN patient_num < 4 THEN 'view' ELSE 'click' END)""",
)
def rel_drop_listed_channels(spark, sf_dir):
    """Patients 0 to 3 list the view channel; the rest fall back to the default."""
    listed = views.event_recordings(spark, sf_dir).filter("patient_num < 4")
    listed = listed.select("patient_num", F.array(F.lit("View")).alias("words"))
    kept = signal.drop_listed_channels(views.event_signal(spark, sf_dir), listed, ("CLICK",))
    return kept.select("patient_num", "channel", "idx", rounded("value").alias("value"))


@query(
    "rel_join_signals",
    with_views("signal", "reviewers")
    + """
SELECT s.patient_num, s.idx, r.n, round(max(s.value), 6) + 0.0 AS value FROM sig s
JOIN rc r ON r.patient_num = s.patient_num AND r.sec = s.idx GROUP BY 1, 2, 3""",
)
def rel_join_signals(spark, sf_dir):
    """Signals and reviewer counts of each patient, lined up in time."""
    counts = views.reviewer_counts(spark, sf_dir).withColumnRenamed("sec", "idx")
    lined = views.event_signal(spark, sf_dir).join(counts, ["patient_num", "idx"])
    return lined.groupBy("patient_num", "idx", "n").agg(rounded(F.max("value")).alias("value"))


@query(
    "rel_align_channels",
    with_views("signal")
    + """
SELECT a.patient_num, a.channel, a.idx, round(a.value - b.value, 6) + 0.0 AS gap FROM sig a
JOIN sig b ON a.channel = b.channel AND a.idx = b.idx AND b.patient_num = a.patient_num + 1""",
)
def rel_align_channels(spark, sf_dir):
    """Every recording aligned with the next by channel name, whatever order each lists its channels in."""
    whole = views.event_signal(spark, sf_dir)
    following = whole.select((F.col("patient_num") - 1).alias("patient_num"), "channel", "idx", F.col("value").alias("other"))
    return whole.join(following, ["patient_num", "channel", "idx"]).select(
        "patient_num", "channel", "idx", rounded(F.col("value") - F.col("other")).alias("gap")
    )


_CASES = with_views("lines").rstrip() + """,
halves AS (
  SELECT patient_num, idx, channel, value, CASE WHEN idx < 3750 THEN 1 ELSE 2 END AS "case" FROM osig)
SELECT patient_num, "case", CAST(idx AS BIGINT) AS idx, 'c' || channel AS variable, round(value, 6) AS value FROM halves"""


@query("rel_unpivot", _CASES)
def rel_unpivot(spark, sf_dir):
    """Control and seizure halves, one column per class, labelled, stacked and unpivoted."""
    wide = tables.widened(views.order_signal(spark, sf_dir), ["patient_num", "idx"], range(views.ORDER_CHANNELS))
    names = [f"c{i}" for i in range(views.ORDER_CHANNELS)]
    wide = wide.withColumnsRenamed({n[1:]: n for n in names})
    cases = tables.labelled_cases(wide.filter("idx < 3750"), wide.filter("idx >= 3750"))
    long = tables.stacked(cases, ["patient_num", "case", "idx"], names)
    return long.withColumn("value", rounded("value"))


@query(
    "rel_union_all",
    """
SELECT o_orderkey AS id, 'orders' AS source, round(o_totalprice, 6) AS value FROM orders
UNION ALL SELECT l_orderkey, 'lineitem', round(l_extendedprice, 6) FROM lineitem""",
)
def rel_union_all(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("source"), rounded("o_totalprice").alias("value")
    )
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("id"), rounded("l_extendedprice").alias("value")
    )
    return tables.union_all([orders, None, lines])


@query("rel_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def rel_distinct(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "rel_setdiff",
    "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def rel_setdiff(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id")
    return tables.set_difference(documents, views.table(spark, sf_dir, "labels").select("doc_id"))


@query(
    "rel_sort",
    """
SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS BIGINT) AS place
FROM supplier""",
)
def rel_sort(spark, sf_dir):
    """Multi-key order; the place in it comes from a distributed running count."""
    suppliers = views.table(spark, sf_dir, "supplier").withColumn("_down", -F.col("s_acctbal"))
    order = ["s_nationkey", "_down", "s_suppkey"]
    inner = value_blocks(suppliers.select(*order), ["s_nationkey"], "_down", "_inner")
    # a block number grows along all of the order: the first column, then stretches of the second
    blocks = inner.withColumn("_block", F.col("s_nationkey").cast("bigint") * 4096 + F.col("_inner"))
    placed = running(blocks, [], "_block", order, {"place": ("sum", F.lit(1))})
    return placed.select("s_nationkey", "s_suppkey", F.col("place").cast("bigint").alias("place"))


@query(
    "rel_sample",
    with_views("orders")
    + """
SELECT patient_num, on_s, off_s, start_s FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_num ORDER BY md5('7:' || patient_num || ':' || key)) AS r
  FROM (
    SELECT c_nationkey AS patient_num, o_orderkey AS key,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS on_s,
      CAST(o_totalprice AS DOUBLE) AS off_s, CAST(o_orderkey AS DOUBLE) AS start_s
    FROM orders JOIN customer ON o_custkey = c_custkey))
WHERE r <= 20""",
)
def rel_sample(spark, sf_dir):
    """Twenty orders of each nation without replacement."""
    orders = views.table(spark, sf_dir, "orders")
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("patient_num"),
        F.col("o_orderkey").alias("key"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double").alias("on_s"),
        F.col("o_totalprice").alias("off_s"),
        F.col("o_orderkey").cast("double").alias("start_s"),
    )
    picked = tables.sample_per_key(rows, 20, ["patient_num"], ["patient_num", "key"], seed=7)
    return picked.select("patient_num", "on_s", "off_s", "start_s")


_STARTS = """
zs AS (SELECT DISTINCT patient_num, on_s + unnest(range(0, CAST(off_s - on_s AS BIGINT) + 1)) * 1.0 AS start_s FROM runs),
cs AS (SELECT DISTINCT patient_num, on_s + unnest(range(0, CAST(off_s - on_s AS BIGINT) + 1)) * 1.0 AS start_s FROM free),
fit AS (SELECT patient_num FROM cs GROUP BY 1 HAVING count(*) > 5)"""


def _pick(source: str, case: int, seed: int) -> str:
    return f"""
SELECT patient_num, start_s, {case} AS "case" FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_num ORDER BY md5('{seed}:' || patient_num || ':' || CAST(start_s AS BIGINT)))
    AS r FROM {source} SEMI JOIN fit USING (patient_num)) WHERE r <= 5"""


@query("st_case_sampling", with_views(*_CONTROL, _STARTS) + _pick("cs", 1, 1) + " UNION ALL " + _pick("zs", 2, 0))
def st_case_sampling(spark, sf_dir):
    """Five control and up to five seizure snippets of each patient with enough controls."""

    def starts(df):
        found = intervals.snippet_starts(df, 1).select("patient_num", F.col("start_s").cast("bigint").alias("start_s"))
        return found.distinct()

    seizing, free = cut_lineage(seizures(spark, sf_dir)), cut_lineage(controls(spark, sf_dir))
    picked = tables.control_and_seizure_starts(starts(seizing), starts(free), 5, ["patient_num"])
    return picked.withColumn("start_s", F.col("start_s").cast("double"))


@query(
    "rel_sum_records",
    """
SELECT l_returnflag, round(sum(l_quantity), 4) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1""",
)
def rel_sum_records(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    summed = tables.summed_records(lines, ["l_quantity", "l_tax"], ["l_returnflag"])
    return summed.select("l_returnflag", *[rounded(c, 4).alias(c) for c in ("l_quantity", "l_tax")])


@query(
    "rel_ratio_records",
    """
SELECT a.l_linenumber, round(a.q / nullif(b.q, 0.0), 6) AS l_quantity, round(a.t / nullif(b.t, 0.0), 6) AS l_tax
FROM (SELECT l_linenumber, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
JOIN (SELECT l_linenumber, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b
USING (l_linenumber)""",
)
def rel_ratio_records(spark, sf_dir):
    """Mean records of one group over those of the rest."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity", "l_tax")
    fields, keys = ["l_quantity", "l_tax"], ["l_linenumber"]
    returned = tables.mean_records(lines.filter("l_returnflag = 'R'"), fields, keys)
    others = tables.mean_records(lines.filter("l_returnflag <> 'R'"), fields, keys)
    ratio = tables.divided_records(returned, others, fields, keys)
    return ratio.select(*keys, *[rounded(c).alias(c) for c in fields])


@query(
    "rel_shuffle",
    with_views("embeddings")
    + """, ranked AS (
  SELECT snippet, r * 8 + t AS idx, v, row_number() OVER (PARTITION BY snippet ORDER BY r * 8 + t) AS a,
    row_number() OVER (PARTITION BY snippet ORDER BY md5('3:' || snippet || ':' || (r * 8 + t))) AS b FROM em)
SELECT x.snippet, x.idx, round(y.v, 6) + 0.0 AS value FROM ranked x JOIN ranked y ON y.snippet = x.snippet AND y.b = x.a""",
)
def rel_shuffle(spark, sf_dir):
    """Values of each snippet in a repeatable random order."""
    cells = views.embedding_cells(spark, sf_dir).select("snippet", (F.col("row") * 8 + F.col("idx")).alias("idx"), "value")
    mixed = tables.shuffled_values(cells, ["snippet"], seed=3)
    return mixed.select("snippet", "idx", rounded("value").alias("value"))


@query(
    "rel_min_support",
    with_views("signal")
    + "SELECT patient_num, count(value) AS present FROM sig GROUP BY 1 HAVING count(value) >= 5 * 100",
)
def rel_min_support(spark, sf_dir):
    counted = views.event_signal(spark, sf_dir).groupBy("patient_num").agg(F.count("value").alias("present"))
    return counted.filter(F.col("present") >= 5 * 100)


@query(
    "rel_has_seizures",
    with_views("signal", "reviewers", _runs(3))
    + "SELECT DISTINCT patient_num FROM sig WHERE patient_num IN (SELECT patient_num FROM runs)",
)
def rel_has_seizures(spark, sf_dir):
    """Recordings that go on to a comparison: those with any seizure."""
    found = seizures(spark, sf_dir, 3)
    return views.event_recordings(spark, sf_dir).join(found, "patient_num", "left_semi").select("patient_num")


@query(
    "rel_relevant_events",
    "SELECT doc_id % 8 AS patient_num, CAST(doc_id // 8 AS DOUBLE) * 4 AS onset_s FROM documents WHERE text <> ''",
)
def rel_relevant_events(spark, sf_dir):
    return annotations.relevant(document_events(spark, sf_dir)).select("patient_num", "onset_s")


@query(
    "fn_clean_label",
    """
SELECT c_custkey, replace(replace(replace('EEG ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '-Ref' ELSE '-REF' END,
  '-Ref', ''), '-REF', ''), 'EEG ', '') AS label FROM customer""",
)
def fn_clean_label(spark, sf_dir):
    raw = F.concat(F.lit("EEG "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("-Ref")).otherwise("-REF"))
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("label"))
    return customers.withColumn("label", scalar.clean_label("label"))


def _roman_sql(n: str) -> str:
    ones = "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"
    tens = "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']"
    hundreds = "['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM']"
    return (
        f"repeat('M', CAST({n} // 1000 AS INT)) || ({hundreds})[{n} // 100 % 10 + 1] "
        f"|| ({tens})[{n} // 10 % 10 + 1] || ({ones})[{n} % 10 + 1]"
    )


@query(
    "fn_roman",
    f"""
SELECT o_orderkey, CASE WHEN n = 0 THEN '0' ELSE {_roman_sql("n")} END AS numeral
FROM (SELECT o_orderkey, o_orderkey % 5000 AS n FROM orders)""",
)
def fn_roman(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.select("o_orderkey", scalar.roman(F.col("o_orderkey") % 5000).alias("numeral"))


@query(
    "fn_motif_name",
    """
SELECT vec_id, CASE label WHEN 0 THEN '0' ELSE ['I','II','III','IV','V','VI','VII','VIII','IX','X'][label] END AS motif
FROM embeddings""",
)
def fn_motif_name(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", scalar.motif_name(F.col("label") + 1).alias("motif"))


@query(
    "fn_sigdigits",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN p >= 0 THEN round_even(v / pow(10.0, p), 0) * pow(10.0, p)
  ELSE round_even(v * pow(10.0, -p), 0) / pow(10.0, -p) END AS rounded
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CAST(floor(log10(abs(l_extendedprice))) AS INT) - 1 AS p
  FROM lineitem)""",
)
def fn_sigdigits(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", scalar.sigdigits("l_extendedprice", 2).alias("rounded"))


@query(
    "fn_lag_conditions",
    r"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber - 4 AS n1, l_orderkey % 7 - 3 AS t1, l_partkey % 9 - 4 AS n2,
    l_suppkey % 5 - 2 AS t2 FROM lineitem),
p AS (SELECT *,
  CASE WHEN sign(n1) = sign(n2) AND n1 <> 0 THEN '$\abs{n_1} ' || CASE WHEN abs(n1) < abs(n2) THEN '<'
    WHEN abs(n1) > abs(n2) THEN '>' ELSE '=' END || ' \abs{n_2}$' ELSE '' END AS cn,
  CASE WHEN sign(t1) = sign(t2) AND t1 <> 0 THEN '$\abs{t_1} ' || CASE WHEN abs(t1) < abs(t2) THEN '<'
    WHEN abs(t1) > abs(t2) THEN '>' ELSE '=' END || ' \abs{t_2}$' ELSE '' END AS ct FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN cn <> '' AND ct <> ''
  THEN '\adjustbox{raise=-0.25\height}{\shortstack{' || cn || '\\' || ct || '}}' ELSE cn || ct END AS conditions FROM p""",
)
def fn_lag_conditions(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_linenumber") - 4).alias("n1"),
        (F.col("l_orderkey") % 7 - 3).alias("t1"),
        (F.col("l_partkey") % 9 - 4).alias("n2"),
        (F.col("l_suppkey") % 5 - 2).alias("t2"),
    )
    text = scalar.lag_conditions("n1", "t1", "n2", "t2")
    return lines.select("l_orderkey", "l_linenumber", text.alias("conditions"))


@query(
    "fn_file_id",
    "SELECT doc_id, 'EEG' || CASE WHEN length(doc_id::VARCHAR) < 3 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END AS file FROM documents",
)
def fn_file_id(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", scalar.file_id("doc_id").alias("file"))


@query(
    "fn_stem",
    "SELECT page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages",
)
def fn_stem(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", scalar.stem("url").alias("stem"))


@query(
    "fn_math",
    """
SELECT event_id, round(sign(v) * log10(nullif(abs(v), 0.0)), 6) + 0.0 AS signed_log, round(v * v, 4) AS squared,
  round(sqrt(abs(v)), 6) AS root, CAST(floor(v) AS BIGINT) AS below, CAST(ceil(v) AS BIGINT) AS above
FROM (SELECT event_id, value - 30.0 AS v FROM events)""",
)
def fn_math(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", (F.col("value") - 30.0).alias("v"))
    return events.select(
        "event_id",
        rounded(scalar.signed_log10("v")).alias("signed_log"),
        rounded(F.col("v") * F.col("v"), 4).alias("squared"),
        rounded(F.sqrt(F.abs("v"))).alias("root"),
        F.floor("v").alias("below"),
        F.ceil("v").alias("above"),
    )


@query(
    "fn_prettify",
    """
SELECT lang AS target, 'within' AS standardization, 'chars' AS signal, avg(n_chars) AS "AUC",
  CAST(min(n_chars) AS DOUBLE) AS "TPR", CAST(max(n_chars) AS DOUBLE) AS "FPHr" FROM documents GROUP BY 1""",
)
def fn_prettify(spark, sf_dir):
    shown = views.table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("target")).agg(
        F.lit("within").alias("standardization"),
        F.lit("chars").alias("signal"),
        F.avg("n_chars").alias("auc"),
        F.min("n_chars").cast("double").alias("tpr57"),
        F.max("n_chars").cast("double").alias("fphr80"),
    )
    return tables.prettified(shown)
