"""Recordings, annotations and samples derived from the given tables.

Each view has a Spark form and, in `SQL`, the same view as common table expressions.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.nulls import join_on
from tracemill.operators.scan import spread
from tracemill.operators.signal import densify

ORIGIN = "2024-01-01 00:00:00"
BUCKET_S = 21_600
REVIEWERS = ("click", "error", "purchase")
ORDER_CHANNELS = 17
ORDER_RECORDING = 7_500
ORDER_PARTS = 64  # tasks over the steps of all recordings; each one costs the pages of its aggregates, however few its rows


#: The given tables, whose columns are known; so that reading one starts no job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files, whether it is one file or a folder of them."""
    # a pattern that fits the name alone: as a plain path, a single file is refused for not being a folder
    return spark.readStream.schema(SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def micros_since_origin(ts: Column) -> Column:
    # the tables carry zoneless timestamps; both sides get the session's zone
    origin = F.lit(ORIGIN).cast("timestamp_ntz").cast("timestamp")
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(origin)


def event_cells(spark: SparkSession, sf_dir: str, bucket_s: int = BUCKET_S, pooled: bool = False) -> DataFrame:
    """Mean event value per patient, channel and time bucket."""
    channel = F.lit("all") if pooled else F.col("event_type")
    bucket = F.floor(micros_since_origin(F.col("ts")) / (bucket_s * 1_000_000))
    return table(spark, sf_dir, "events").groupBy(
        (F.col("user_id") % 8).cast("int").alias("patient_num"), channel.alias("channel"), bucket.alias("idx")
    ).agg(F.avg("value").alias("value"))


def event_length(spark: SparkSession, sf_dir: str, bucket_s: int = BUCKET_S) -> Column:
    """Number of time buckets, as a scalar subquery."""
    top = F.floor(micros_since_origin(F.max("ts")) / (bucket_s * 1_000_000)) + 1
    return table(spark, sf_dir, "events").agg(top).scalar()


def event_signal(spark: SparkSession, sf_dir: str, bucket_s: int = BUCKET_S, pooled: bool = False) -> DataFrame:
    """Dense multi-channel signal; buckets without events are NULL."""
    cells = event_cells(spark, sf_dir, bucket_s, pooled)
    return densify(cells, event_length(spark, sf_dir, bucket_s))


def event_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("patient_num"))
    return users.distinct().select(
        "patient_num",
        F.lit(1).alias("sample_rate"),
        F.lit(0.0).alias("start_s"),
        event_length(spark, sf_dir).cast("double").alias("duration_s"),
    )


def reviewer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer marks a bucket whose cell lies above the mean of the patient's channel."""
    signal = event_signal(spark, sf_dir).filter(F.col("channel").isin(*REVIEWERS))
    level = signal.groupBy("patient_num", "channel").agg(F.avg("value").alias("_mean"))
    mark = F.coalesce(F.col("value") > F.col("_mean"), F.lit(False)).cast("int")
    return signal.join(level, ["patient_num", "channel"]).select(
        "patient_num", F.col("channel").alias("reviewer"), F.col("idx").alias("sec"), mark.alias("flag")
    )


def reviewer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = reviewer_flags(spark, sf_dir)
    return flags.groupBy("patient_num", "sec").agg(F.sum("flag").cast("int").alias("n"))


def artifact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket is artifactual where its view cell is absent or under half the patient's mean."""
    seen = event_signal(spark, sf_dir).filter(F.col("channel") == "view")
    level = seen.groupBy("patient_num").agg(F.avg("value").alias("_mean"))
    bad = F.col("value").isNull() | (F.col("value") < F.col("_mean") / 2)
    return seen.join(level, "patient_num").select("patient_num", "idx", bad.alias("flag"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording, step, channel and quantity of every line of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / ORDER_RECORDING).cast("int").alias("patient_num"),
        (F.col("l_orderkey") % ORDER_RECORDING).alias("idx"),
        (F.col("l_partkey") % ORDER_CHANNELS).cast("int").alias("channel"),
        F.col("l_quantity").alias("value"),
    )


def order_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last step of each recording of orders."""
    return order_lines(spark, sf_dir).groupBy("patient_num").agg(F.max("idx").alias("top")).filter("top >= 0")


def order_seconds(spark: SparkSession, sf_dir: str, rate: int, groups: int = 1) -> DataFrame:
    """Quantity `q` shipped in each `rate` steps `idx`, by `group`: the channels that leave it when divided by `groups`.

    The same sums as over the order signal, from its lines, without its samples in between.
    """
    picks = [F.sum(F.when(F.col("channel") % groups == g, F.col("value"))).alias(f"_q{g}") for g in range(groups)]
    held = order_lines(spark, sf_dir).groupBy("patient_num", F.floor(F.col("idx") / rate).alias("idx")).agg(*picks)
    every = spread(order_tops(spark, sf_dir), F.lit(0), F.floor(F.col("top") / rate), "idx").drop("top")
    sums = F.array(*[F.coalesce(f"_q{g}", F.lit(0.0)) for g in range(groups)])
    return join_on(every, held, ["patient_num", "idx"], "left").select("patient_num", "idx", F.posexplode(sums).alias("group", "q"))


def order_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped per part group along the sequence of orders, 0 where none.

    Recordings are stretches of `ORDER_RECORDING` orders, so they multiply with the data.
    """
    return order_steps(spark, sf_dir).select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order signal in wide form.

    The channels of a step are summed side by side, so steps are shuffled and not samples.
    """
    lines = order_lines(spark, sf_dir).withColumn("_step", F.lit(False))
    spans = lines.groupBy("patient_num").agg((F.max("idx") + 1).alias("_n"))
    steps = spread(spans, F.lit(0), F.col("_n") - 1, "idx").select(
        "patient_num", "idx", F.lit(None).cast("int").alias("channel"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("_step")
    )
    dealt = lines.unionByName(steps).repartition(ORDER_PARTS, "patient_num", "idx")
    sums = [F.sum(F.when(F.col("channel") == c, F.col("value"))).alias(f"_c{c}") for c in range(ORDER_CHANNELS)]
    filled = dealt.groupBy("patient_num", "idx").agg(F.max("_step").alias("_step"), *sums).filter("_step")
    values = F.array(*[F.coalesce(f"_c{c}", F.lit(0.0)) for c in range(ORDER_CHANNELS)])
    return filled.select("patient_num", "idx", values.alias("value"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one 8 x 8 snippet."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("patient_num"),
        F.col("vec_id").alias("snippet"),
        F.lit(8).cast("bigint").alias("n_channels"),
        F.lit(8).cast("bigint").alias("length"),
        F.col("embedding").cast("array<double>").alias("cells"),
    )


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: row (channel) and idx (time) of each value."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("label").alias("patient_num"),
            F.col("vec_id").alias("snippet"),
            F.posexplode("embedding").alias("_at", "_v"),
        )
        .select(
            "patient_num",
            "snippet",
            F.floor(F.col("_at") / 8).alias("row"),
            (F.col("_at") % 8).cast("bigint").alias("idx"),
            F.col("_v").cast("double").alias("value"),
        )
    )


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per order, from its day on and longer for dearer orders, by nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("c_nationkey").alias("patient_num"),
        day.alias("on_s"),
        (day + F.floor(F.col("o_totalprice") / 100_000)).cast("double").alias("off_s"),
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        "lang", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("is_target")
    )


def purchase_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values per patient, purchases against everything else."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("patient_num"),
        "value",
        (F.col("event_type") == "purchase").alias("is_seizure"),
    )


_SIG = f"""
ev AS (
  SELECT CAST(user_id % 8 AS INT) AS patient_num, event_type AS channel,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / {BUCKET_S}000000.0) AS BIGINT) AS idx, avg(value) AS value
  FROM events GROUP BY 1, 2, 3),
len AS (SELECT max(idx) + 1 AS n FROM ev),
steps AS (SELECT unnest(range(0, (SELECT n FROM len))) AS idx),
sig AS (
  SELECT k.patient_num, k.channel, s.idx, ev.value
  FROM (SELECT DISTINCT patient_num, channel FROM ev) k CROSS JOIN steps s
  LEFT JOIN ev ON ev.patient_num = k.patient_num AND ev.channel = k.channel AND ev.idx = s.idx)"""

_RC = """
lev AS (SELECT patient_num, channel, avg(value) AS m FROM sig GROUP BY 1, 2),
rc AS (
  SELECT s.patient_num, s.idx AS sec, CAST(count(*) FILTER (WHERE s.value > l.m) AS INT) AS n
  FROM sig s JOIN lev l USING (patient_num, channel)
  WHERE s.channel IN ('click', 'error', 'purchase') GROUP BY 1, 2)"""

_ART = """
alev AS (SELECT patient_num, avg(value) AS m FROM sig WHERE channel = 'view' GROUP BY 1),
art AS (
  SELECT s.patient_num, s.idx, (s.value IS NULL OR s.value < a.m / 2) AS flag
  FROM sig s JOIN alev a USING (patient_num) WHERE s.channel = 'view')"""

_ORD = """
oi AS (
  SELECT c_nationkey AS patient_num,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS on_s,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + floor(o_totalprice / 100000) AS DOUBLE)
      AS off_s
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_EMB = """
em AS (
  SELECT label AS patient_num, vec_id AS snippet, (i - 1) // 8 AS r, (i - 1) % 8 AS t,
    CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT label, vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""

_LINES = f"""
lines AS (
  SELECT CAST(l_orderkey // {ORDER_RECORDING} AS INT) AS patient_num, l_orderkey % {ORDER_RECORDING} AS idx,
    CAST(l_partkey % {ORDER_CHANNELS} AS INT) AS channel, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2, 3),
spans AS (SELECT patient_num, max(idx) AS n FROM lines GROUP BY 1),
axis AS (SELECT patient_num, unnest(range(0, n + 1)) AS idx FROM spans),
osig AS (
  SELECT a.patient_num, a.idx, c.channel, coalesce(l.value, 0.0) AS value
  FROM axis a CROSS JOIN (SELECT CAST(unnest(range(0, {ORDER_CHANNELS})) AS INT) AS channel) c
  LEFT JOIN lines l ON l.patient_num = a.patient_num AND l.idx = a.idx AND l.channel = c.channel)"""

SQL = {
    "signal": _SIG,
    "reviewers": _RC,
    "artifacts": _ART,
    "orders": _ORD,
    "embeddings": _EMB,
    "lines": _LINES,
}


def runs_sql(name: str, source: str, idx: str, flag: str, keys: str = "patient_num") -> str:
    """Expression for the 1-based runs of a flag, ending at the last sample if they reach it."""
    return f"""
{name} AS (
  SELECT {keys}, CAST(min({idx}) + 1 AS DOUBLE) AS on_s,
    CAST(CASE WHEN max({idx}) = any_value(top) THEN max({idx}) + 1 ELSE max({idx}) + 2 END AS DOUBLE) AS off_s
  FROM (
    SELECT *, {idx} - row_number() OVER (PARTITION BY {keys} ORDER BY {idx}) AS grp
    FROM (SELECT *, max({idx}) OVER (PARTITION BY {keys}) AS top FROM {source}) WHERE {flag})
  GROUP BY {keys}, grp)"""


def merge_sql(name: str, source: str, keys: str = "patient_num") -> str:
    """Expression for the union of intervals, touching ones joined."""
    return f"""
{name} AS (
  SELECT {keys}, min(on_s) AS on_s, max(off_s) AS off_s FROM (
    SELECT *, sum(CASE WHEN seen IS NULL OR on_s > seen THEN 1 ELSE 0 END)
      OVER (PARTITION BY {keys} ORDER BY on_s, off_s ROWS UNBOUNDED PRECEDING) AS grp
    FROM (SELECT *, max(off_s) OVER (PARTITION BY {keys} ORDER BY on_s, off_s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM (SELECT DISTINCT {keys}, on_s, off_s FROM {source})))
  GROUP BY {keys}, grp)"""


def invert_sql(name: str, source: str, bounds: str, keys: str = "patient_num") -> str:
    """Expression for the gaps of disjoint intervals inside `bounds(start_s, stop_s)`."""
    return f"""
{name} AS (
  SELECT {keys}, seen AS on_s, on_s AS off_s FROM (
    SELECT {keys}, on_s, lag(off_s) OVER (PARTITION BY {keys} ORDER BY ord, on_s) AS seen FROM (
      SELECT {keys}, 0 AS ord, NULL::DOUBLE AS on_s, start_s AS off_s FROM {bounds}
      UNION ALL SELECT {keys}, 1, on_s, off_s FROM {source}
      UNION ALL SELECT {keys}, 2, stop_s, NULL FROM {bounds}))
  WHERE on_s - seen > 0)"""


def with_views(*names: str) -> str:
    """`WITH` clause holding the named views or ready-made expressions."""
    return "WITH " + ",".join(SQL.get(n, n) for n in names) + "\n"


def collapse_sql(name: str, source: str) -> str:
    """Expression for intervals joined with their neighbours, ending at the latest starting one."""
    return f"""
{name} AS (
  SELECT patient_num, min(on_s) AS on_s, max(off_s) FILTER (WHERE on_s = top) AS off_s FROM (
    SELECT *, max(on_s) OVER (PARTITION BY patient_num, g) AS top FROM (
      SELECT *, sum(CASE WHEN seen IS NULL OR on_s > seen THEN 1 ELSE 0 END)
        OVER (PARTITION BY patient_num ORDER BY on_s, off_s ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT *, lag(off_s) OVER (PARTITION BY patient_num ORDER BY on_s, off_s) AS seen
        FROM (SELECT DISTINCT patient_num, on_s, off_s FROM {source}))))
  GROUP BY patient_num, g)"""
