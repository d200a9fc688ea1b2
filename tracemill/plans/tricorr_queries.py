"""Queries on triple correlation and amplitude margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tracemill.functions.nulls import rounded
from tracemill.functions.scalar import signed_log10
from tracemill.operators import dsp, intervals, signal, tricorr
from tracemill.plans import views
from tracemill.plans.registry import query
from tracemill.plans.views import runs_sql, with_views

SECOND = 250  # orders per snippet of the order recordings

# Class of a lag quadruple by sorting its distinct points, for the SQL below.
_CLASS = """CASE
  WHEN n1 = 0 AND t1 = 0 AND n2 = 0 AND t2 = 0 THEN 1
  WHEN (n1 = 0 AND t1 = 0) OR (n2 = 0 AND t2 = 0) OR (n1 = n2 AND t1 = t2) THEN
    CASE WHEN n1 = 0 AND n2 = 0 THEN 2 WHEN t1 = 0 AND t2 = 0 THEN 4 ELSE 5 END
  WHEN n1 = 0 AND n2 = 0 THEN 3
  WHEN n1 = n2 THEN
    CASE WHEN least(t1, t2) = 0 THEN 6 WHEN greatest(t1, t2) = 0 THEN 7 WHEN least(t1, t2) > 0 THEN 8
      WHEN greatest(t1, t2) > 0 THEN 9 ELSE 10 END
  WHEN n1 = 0 THEN
    CASE WHEN t2 = least(0, t1) THEN 6 WHEN t2 = greatest(0, t1) THEN 7 WHEN t2 < least(0, t1) THEN 8
      WHEN t2 < greatest(0, t1) THEN 9 ELSE 10 END
  WHEN n2 = 0 THEN
    CASE WHEN t1 = least(0, t2) THEN 6 WHEN t1 = greatest(0, t2) THEN 7 WHEN t1 < least(0, t2) THEN 8
      WHEN t1 < greatest(0, t2) THEN 9 ELSE 10 END
  WHEN t1 = 0 AND t2 = 0 THEN 11
  WHEN (t1 = 0 AND t2 > 0) OR (t2 = 0 AND t1 > 0) OR (t1 = t2 AND t1 < 0) THEN 12
  WHEN (t1 = 0 AND t2 < 0) OR (t2 = 0 AND t1 < 0) OR (t1 = t2 AND t1 > 0) THEN 13
  ELSE 14 END"""


def _brute(reach_n: int, reach_t: int, periodic: bool, source: str = "em", shape: tuple[int, int] = (8, 8)) -> str:
    """Class sums from every lag quadruple of the box, on snippets of `shape` channels and times."""
    wrap = "(({0} + {1}) % {2} + {2}) % {2}" if periodic else "{0} + {1}"
    return f"""
lag1 AS (SELECT n.n, t.t FROM (SELECT unnest(range(-{reach_n}, {reach_n + 1})) AS n) n
  CROSS JOIN (SELECT unnest(range(-{reach_t}, {reach_t + 1})) AS t) t),
lags AS (
  SELECT a.n AS n1, a.t AS t1, b.n AS n2, b.t AS t2 FROM lag1 a CROSS JOIN lag1 b),
cl AS (SELECT n1, t1, n2, t2, {_CLASS} AS class FROM lags),
pairs AS (
  SELECT x.patient_num, x.snippet, x.r, x.t, x.v, l.n, l.t AS dt, y.v AS w FROM {source} x CROSS JOIN lag1 l
  JOIN {source} y ON y.snippet = x.snippet AND y.r = {wrap.format("x.r", "l.n", shape[0])} AND y.t = {wrap.format("x.t", "l.t", shape[1])}),
brute AS (
  SELECT a.patient_num, a.snippet AS idx, cl.class AS channel, sum(a.v * a.w * b.w) AS value
  FROM pairs a JOIN cl ON cl.n1 = a.n AND cl.t1 = a.dt
  JOIN pairs b ON b.snippet = a.snippet AND b.r = a.r AND b.t = a.t AND b.n = cl.n2 AND b.dt = cl.t2
  GROUP BY 1, 2, 3)"""


_SHOW = "SELECT patient_num, idx, CAST(channel AS INT) AS channel, round(value, 4) + 0.0 AS value FROM brute"


def _shown(df, digits: int = 4):
    return df.select("patient_num", "idx", "channel", rounded("value", digits).alias("value"))


@query("tc_class_small", with_views("embeddings", _brute(1, 1, False)) + _SHOW)
def tc_class_small(spark, sf_dir):
    """Zero-padded class sums by window functions."""
    return _shown(tricorr.class_contributions_windowed(views.embedding_cells(spark, sf_dir), (1, 1)))


@query("tc_class_factored", with_views("embeddings", _brute(1, 2, True)) + _SHOW)
def tc_class_factored(spark, sf_dir):
    """Periodic class sums by the factorised kernel."""
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 2), "A"))


_ZSCORED = """
zem AS (
  SELECT patient_num, snippet, r, t, (v - avg(v) OVER s) / stddev_samp(v) OVER s AS v FROM em
  WINDOW s AS (PARTITION BY snippet))"""

_UNIT = """
uem AS (
  SELECT patient_num, snippet, r, t, (v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s) AS v FROM em
  WINDOW s AS (PARTITION BY snippet))"""


@query("tc_zscore", with_views("embeddings", _ZSCORED, _brute(1, 1, True, "zem")) + _SHOW)
def tc_zscore(spark, sf_dir):
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A_znorm"))


@query("tc_unit_range", with_views("embeddings", _UNIT, _brute(1, 1, True, "uem")) + _SHOW)
def tc_unit_range(spark, sf_dir):
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A_01norm"))


_UNIT_Z = """
uzem AS (
  SELECT patient_num, snippet, r, t, (v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s) AS v FROM zem
  WINDOW s AS (PARTITION BY snippet))"""


@query("tc_zscore_unit", with_views("embeddings", _ZSCORED, _UNIT_Z, _brute(1, 1, True, "uzem")) + _SHOW)
def tc_zscore_unit(spark, sf_dir):
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A_z01norm"))


_Z_UNIT = """
zuem AS (
  SELECT patient_num, snippet, r, t, (v - avg(v) OVER s) / stddev_samp(v) OVER s AS v FROM uem
  WINDOW s AS (PARTITION BY snippet))"""


@query("tc_unit_zscore", with_views("embeddings", _UNIT, _Z_UNIT, _brute(1, 1, True, "zuem")) + _SHOW)
def tc_unit_zscore(spark, sf_dir):
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A_01znorm"))


# Variance per cell of each class for independent normal samples at lags (1, 1): every
# product of the box is expanded and equal products are added before squaring.
_VARIANCE = """
mono AS (
  SELECT class,
    list_sort([(0, 0), (n1, t1), (n2, t2)]) AS pts FROM cl),
shifted AS (
  SELECT class, [pts[2][1] - pts[1][1], pts[2][2] - pts[1][2], pts[3][1] - pts[1][1], pts[3][2] - pts[1][2]] AS shape
  FROM mono),
shapes AS (SELECT class, shape, count(*) AS c FROM shifted GROUP BY 1, 2),
three AS (
  SELECT class, sum(c * c) AS var FROM shapes WHERE class NOT IN (1, 2, 4, 5) GROUP BY 1),
two AS (
  SELECT class, 9.0 * (3 * k + k * (k - 1)) AS var FROM (VALUES (2, 2), (4, 2), (5, 4)) AS q(class, k)),
spread AS (SELECT * FROM three UNION ALL SELECT * FROM two UNION ALL SELECT 1, 15.0)"""


@query(
    "tc_zscore_std",
    with_views("embeddings", _ZSCORED, _brute(1, 1, True, "zem"), _VARIANCE)
    + """
SELECT patient_num, idx, CAST(channel AS INT) AS channel, round(value / sqrt(var * 64), 5) + 0.0 AS value
FROM brute JOIN spread ON class = channel""",
)
def tc_zscore_std(spark, sf_dir):
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A_znorm_std"), 5)


def _drawn(draws: int, source: str = "em", times: int = 8, normal: bool = False) -> str:
    """Snippets of `source` as snippet x 10, and their surrogates in order of md5 as the numbers after it."""
    chance = f"md5('0:' || d || ':' || patient_num || ':' || snippet || ':' || (r * {times} + t))"
    unit = "(CAST('0x' || substr(c, {0}, 8) AS BIGINT) + 0.5) / 4294967296.0"
    made = "x.v" if normal else "y.v"
    value = f"sqrt(-2 * ln({unit.format(1)})) * cos(2 * pi() * {unit.format(9)})" if normal else "v"
    return f"""
marked AS (SELECT patient_num, snippet, r, t, v, d, {chance} AS c FROM {source} CROSS JOIN range(0, {draws}) q(d)),
placed AS (
  SELECT patient_num, snippet, d, r, t, {value} AS v, row_number() OVER (PARTITION BY patient_num, snippet, d ORDER BY c) - 1 AS b FROM marked),
every AS (
  SELECT patient_num, snippet * 10 AS snippet, r, t, v FROM {source} UNION ALL
  SELECT x.patient_num, x.snippet * 10 + 1 + x.d, x.r, x.t, {made} FROM placed x
  JOIN placed y ON y.patient_num = x.patient_num AND y.snippet = x.snippet AND y.d = x.d AND y.b = x.r * {times} + x.t)"""


def _scaled(how: str) -> str:
    level = {"unit": "(v - min(v) OVER s) / (max(v) OVER s - min(v) OVER s)", "zscore": "(v - avg(v) OVER s) / stddev_samp(v) OVER s"}
    return f"""
scaled AS (SELECT patient_num, snippet, r, t, {level[how]} AS v FROM every WINDOW s AS (PARTITION BY patient_num, snippet))"""


def _against_noise(how: str) -> str:
    return f"""
SELECT patient_num, idx // 10 AS idx, CAST(channel AS INT) AS channel,
  round(max(value) FILTER (WHERE idx % 10 = 0) {how} avg(value) FILTER (WHERE idx % 10 > 0){" - 1" if how == "/" else ""}, 4) + 0.0 AS value
FROM brute GROUP BY 1, 2, 3"""


_SQUARES = "sq AS (SELECT patient_num, snippet, r, t, v * v AS v FROM em)"


def _noise_query(name: str, measure: str, drawn: Sequence[str], how: str) -> None:
    @query(name, with_views("embeddings", *drawn, _brute(1, 2, True, "scaled")) + _against_noise(how))
    def run(spark, sf_dir):
        """Measured against surrogates in order of md5."""
        return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 2), measure))


_noise_query("tc_noise_ratio", "AN_01norm", [_drawn(2), _scaled("unit")], "/")
_noise_query("tc_noise_ratio_power", "AN_01norm_power", [_SQUARES, _drawn(1, "sq"), _scaled("unit")], "/")
_noise_query("tc_noise_difference", "AN_znorm", [_drawn(5), _scaled("zscore")], "-")


@query(
    "tc_noise_normal",
    with_views("embeddings", _drawn(1, normal=True), _scaled("unit"), _brute(1, 2, True, "scaled")) + _against_noise("/").replace(" - 1,", ","),
)
def tc_noise_normal(spark, sf_dir):
    """Over the sums of normal noise drawn by md5."""
    return _shown(tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 2), "AN_01norm_normal"))


@query(
    "tc_segments",
    with_views(
        "embeddings",
        "seg AS (SELECT patient_num, snippet * 2 + t // 4 AS snippet, r, t % 4 AS t, v FROM em)",
        _brute(1, 1, False, "seg"),
    )
    + _SHOW,
)
def tc_segments(spark, sf_dir):
    """Class sums of consecutive time segments, each zero-padded on its own."""
    cells = views.embedding_cells(spark, sf_dir).select(
        "patient_num",
        (F.col("snippet") * 2 + F.floor(F.col("idx") / 4)).alias("vec"),
        F.col("row").alias("channel"),
        (F.col("idx") % 4).alias("idx"),
        "value",
    )
    segments = signal.snippets(cells, 4, ("patient_num", "vec")).withColumn("snippet", F.col("vec"))
    return _shown(tricorr.contributions_of(segments, (1, 1), "A", "zeropad"))


@query(
    "tc_segments_noise",
    with_views(
        "embeddings",
        _UNIT,
        "seg AS (SELECT patient_num, snippet * 2 + t // 4 AS snippet, r, t % 4 AS t, v FROM uem)",
        _drawn(2, "seg", 4),
        _brute(1, 1, False, "every"),
    )
    + _against_noise("/"),
)
def tc_segments_noise(spark, sf_dir):
    """Zero-padded segments of unit-range snippets against their own shuffles."""
    unit = tricorr.unit_range(views.embedding_cells(spark, sf_dir), ["patient_num", "snippet"])
    cells = unit.select(
        "patient_num",
        (F.col("snippet") * 2 + F.floor(F.col("idx") / 4)).alias("vec"),
        F.col("row").alias("channel"),
        (F.col("idx") % 4).alias("idx"),
        "value",
    )
    segments = signal.snippets(cells, 4, ("patient_num", "vec")).withColumn("snippet", F.col("vec"))
    return _shown(tricorr.contributions_of(segments, (1, 1), "AN", "zeropad"))


@query("tc_recording")
def tc_recording(spark, sf_dir):
    """Published setting, lags (8, 25) on whole recordings of 17 channels."""
    found = tricorr.class_contributions(views.order_steps(spark, sf_dir), SECOND, (8, 25))
    return tricorr.named_classes(found).select(
        "patient_num", "idx", "channel", "motif", rounded("value").alias("value")
    )


@query(
    "tc_norm01",
    with_views("embeddings", _UNIT)
    + "SELECT patient_num, snippet, r AS row, t AS idx, round(v, 6) + 0.0 AS value FROM uem",
)
def tc_norm01(spark, sf_dir):
    unit = tricorr.unit_range(views.embedding_cells(spark, sf_dir), ["patient_num", "snippet"])
    return unit.select("patient_num", "snippet", "row", "idx", rounded("value").alias("value"))


def _lag_sql(channels: bool) -> str:
    """Time-lag sums over inner base points of 8 x 8 snippets, reach 1 and 2."""
    own = "0" if not channels else "a.a"
    other = "0" if not channels else "c.a"
    return f"""
ra AS (SELECT unnest(range(-1, 2)) AS a), rb AS (SELECT unnest(range(-2, 3)) AS b)
SELECT x.patient_num, x.snippet, p.b AS b1, q.b AS b2, round(sum(x.v * y.v * z.v), 4) + 0.0 AS value
FROM em x CROSS JOIN ra a CROSS JOIN ra c CROSS JOIN rb p CROSS JOIN rb q
JOIN em y ON y.snippet = x.snippet AND y.r = x.r + {own} AND y.t = x.t + p.b
JOIN em z ON z.snippet = x.snippet AND z.r = x.r + {other} AND z.t = x.t + q.b
WHERE x.r BETWEEN 1 AND 6 AND x.t BETWEEN 2 AND 5 GROUP BY 1, 2, 3, 4"""


def _lag_query(name: str, channels: bool) -> None:
    @query(name, with_views("embeddings").rstrip() + "," + _lag_sql(channels))
    def run(spark, sf_dir):
        found = tricorr.lag_kernel(views.embedding_rows(spark, sf_dir), 1, 2, channels)
        return found.select("patient_num", "snippet", "b1", "b2", rounded("value", 4).alias("value"))


_lag_query("tc_lag_kernel", False)
_lag_query("tc_lag_kernel_space", True)


def _marginal_sql(which: str) -> str:
    first, second = {"time": ("t1", "t2"), "space": ("n1", "n2"), "space_time": ("n1", "t1")}[which]
    return f"""
SELECT a.patient_num, a.snippet, cl.{first} AS lag1, cl.{second} AS lag2, round(sum(a.v * a.w * b.w), 4) + 0.0 AS value
FROM pairs a JOIN cl ON cl.n1 = a.n AND cl.t1 = a.dt
JOIN pairs b ON b.snippet = a.snippet AND b.r = a.r AND b.t = a.t AND b.n = cl.n2 AND b.dt = cl.t2
GROUP BY 1, 2, 3, 4"""


def _marginal_query(which: str) -> None:
    @query(f"tc_marginal_{which}", with_views("embeddings", _brute(1, 1, False)) + _marginal_sql(which))
    def run(spark, sf_dir):
        found = tricorr.lag_marginals(views.embedding_rows(spark, sf_dir), (1, 1), which, shuffles=0)
        return found.select("patient_num", "snippet", "lag1", "lag2", rounded("value", 4).alias("value"))


_marginal_query("time")
_marginal_query("space")
_marginal_query("space_time")


@query(
    "tc_marginal_noise",
    with_views("embeddings", _drawn(2), _brute(1, 2, False, "every"))
    + f"""
SELECT patient_num, snippet // 10 AS snippet, lag1, lag2,
  round(max(value) FILTER (WHERE snippet % 10 = 0) / avg(value) FILTER (WHERE snippet % 10 > 0), 4) + 0.0 AS value
FROM ({_marginal_sql("time").replace("round(sum(a.v * a.w * b.w), 4) + 0.0", "sum(a.v * a.w * b.w)")}) GROUP BY 1, 2, 3, 4""",
)
def tc_marginal_noise(spark, sf_dir):
    """Time marginal over the mean of two shuffles in order of md5."""
    found = tricorr.lag_marginals(views.embedding_rows(spark, sf_dir), (1, 2), "time", shuffles=2)
    return found.select("patient_num", "snippet", "lag1", "lag2", rounded("value", 4).alias("value"))


@query(
    "tc_signed_log",
    with_views("embeddings", _brute(1, 1, True))
    + """
SELECT patient_num, idx, CAST(channel AS INT) AS channel,
  round(sign(value) * log10(nullif(abs(value), 0.0)), 6) + 0.0 AS value FROM brute WHERE abs(value) > 1e-6""",
)
def tc_signed_log(spark, sf_dir):
    found = tricorr.contributions_of(views.embedding_rows(spark, sf_dir), (1, 1), "A").filter(F.abs("value") > 1e-6)
    return _shown(found.withColumn("value", signed_log10("value")), 6)


_TAPS = [float(v) for v in dsp.fir_bandpass(50, 2.0, 20.0, 256.0)]


@query(
    "dsp_fir",
    with_views("lines")
    + f"""
SELECT patient_num, channel, idx,
  round({" + ".join(f"coalesce(lag(value, {k}) OVER w, 0.0) * {h!r}" for k, h in enumerate(_TAPS))}, 4) + 0.0 AS value
FROM osig WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx)""",
)
def dsp_fir(spark, sf_dir):
    found = dsp.fir(views.order_signal(spark, sf_dir), _TAPS)
    return found.select("patient_num", "channel", "idx", rounded("value", 4).alias("value"))


@query(
    "dsp_fir_gaps",
    with_views("lines").rstrip()
    + f""",
holed AS (SELECT patient_num, channel, idx, CASE WHEN idx % 997 <> 500 THEN value END AS value FROM osig)
SELECT patient_num, channel, idx, CASE WHEN count(*) OVER r = count(value) OVER r THEN
  round({" + ".join(f"coalesce(lag(value, {k}) OVER w, 0.0) * {h!r}" for k, h in enumerate(_TAPS))}, 4) + 0.0 END AS value
FROM holed WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx),
  r AS (PARTITION BY patient_num, channel ORDER BY idx ROWS BETWEEN {len(_TAPS) - 1} PRECEDING AND CURRENT ROW)""",
)
def dsp_fir_gaps(spark, sf_dir):
    """Absent rows are missing samples: they spoil the steps that they reach and shift none."""
    holed = views.order_signal(spark, sf_dir).filter("idx % 997 <> 500")
    found = dsp.fir(holed, _TAPS)
    return found.select("patient_num", "channel", "idx", rounded("value", 4).alias("value"))


def _response_sql(name: str, sections, steps: int) -> str:
    """Impulse response of a cascade by recursion over its sections, as reversed list `rev` and running sums `cum`."""
    zero = ", ".join(f"0.0::DOUBLE AS p{i}, 0.0::DOUBLE AS q{i}" for i in range(len(sections)))
    signal_in, states = "u", []
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        out = f"({b0!r} * {signal_in} + p{i})"
        states += [f"{b1!r} * {signal_in} - ({a1!r}) * {out} + q{i}", f"{b2!r} * {signal_in} - ({a2!r}) * {out}"]
        signal_in = out
    names = ", ".join(f"p{i}, q{i}" for i in range(len(sections)))
    return f"""
{name}_steps(k, u, y, {names}) AS (
  SELECT -1, 1.0::DOUBLE, 0.0::DOUBLE, {zero} UNION ALL
  SELECT k + 1, 0.0::DOUBLE, {signal_in}, {", ".join(states)} FROM {name}_steps WHERE k < {steps}),
{name}_h AS (
  SELECT list(y ORDER BY k DESC) AS rev, list(c ORDER BY k) AS cum, count(*) AS n
  FROM (SELECT k, y, sum(y) OVER (ORDER BY k) AS c FROM {name}_steps WHERE k >= 0))"""


def _pass_sql(name: str, source: str, response: str, settled: float | None) -> str:
    """`xs` of every series through a filter: from rest, or from the settled state of its first value."""
    start = "" if settled is None else f" + xs[1] * ({settled!r} - cum[t])"
    return f"""
{name} AS (
  SELECT patient_num, channel, list_transform(range(1, len(xs) + 1),
    lambda t: list_inner_product(xs[1:t], rev[n - t + 1:n]){start}) AS xs FROM {source}, {response}_h)"""


def _zero_phase_sql(name: str, source: str, sections) -> str:
    pad = 6 * len(sections)
    gain = 1.0
    for b0, b1, b2, a1, a2 in sections:
        gain *= (b0 + b1 + b2) / (1 + a1 + a2)
    return f"""
{name}_wide AS (
  SELECT patient_num, channel, list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * xs[1] - xs[i + 1]),
    list_concat(xs, list_transform(range(1, {pad} + 1), lambda i: 2 * xs[len(xs)] - xs[len(xs) - i]))) AS xs FROM {source}),
{_pass_sql(name + "_there", name + "_wide", name, gain)},
{name}_turned AS (SELECT patient_num, channel, list_reverse(xs) AS xs FROM {name}_there),
{_pass_sql(name + "_back", name + "_turned", name, gain)},
{name} AS (SELECT patient_num, channel, (list_reverse(xs))[{pad} + 1:len(xs) - {pad}] AS xs FROM {name}_back)"""


_LONGEST = views.ORDER_RECORDING + 100
_BAND, _NOTCH = dsp.sections(2, "bandpass", (0.1, 70.0), 256.0), dsp.sections(6, "bandstop", (45.0, 55.0), 256.0)
_SERIES = "series AS (SELECT patient_num, channel, list(value ORDER BY idx) AS xs FROM osig GROUP BY 1, 2)"


@query(
    "dsp_clean",
    with_views("lines", _SERIES, _response_sql("band", _BAND, _LONGEST), _zero_phase_sql("band", "series", _BAND),
               _response_sql("notch", _NOTCH, _LONGEST), _zero_phase_sql("notch", "band", _NOTCH)).replace("WITH ", "WITH RECURSIVE ", 1)
    + """
SELECT patient_num, channel, idx, round(v / nullif(stddev_samp(v) OVER (PARTITION BY patient_num, channel), 0.0), 3) + 0.0 AS value
FROM (SELECT patient_num, channel, CAST(unnest(range(0, len(xs))) AS BIGINT) AS idx, unnest(xs) AS v FROM notch)""",
)
def dsp_clean(spark, sf_dir):
    """Zero-phase band-pass and mains removal of whole recordings."""
    found = dsp.clean_channels(views.order_steps(spark, sf_dir), 256.0, keys=("patient_num",))
    found = found.select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))
    return found.select("patient_num", "channel", "idx", rounded("value", 3).alias("value"))


@query(
    "dsp_clean_null_keys",
    with_views("lines", _SERIES, _response_sql("band", _BAND, _LONGEST), _zero_phase_sql("band", "series", _BAND),
               _response_sql("notch", _NOTCH, _LONGEST), _zero_phase_sql("notch", "band", _NOTCH)).replace("WITH ", "WITH RECURSIVE ", 1)
    + """
SELECT nullif(patient_num, 0) AS patient_num, channel, idx,
  round(v / nullif(stddev_samp(v) OVER (PARTITION BY patient_num, channel), 0.0), 3) + 0.0 AS value
FROM (SELECT patient_num, channel, CAST(unnest(range(0, len(xs))) AS BIGINT) AS idx, unnest(xs) AS v FROM notch)""",
)
def dsp_clean_null_keys(spark, sf_dir):
    """A recording without a number is one like any other; short blocks carry their states on."""
    recording = views.order_steps(spark, sf_dir).withColumn("patient_num", F.expr("nullif(patient_num, 0)"))
    found = dsp.clean_channels(recording, 256.0, block_len=1000, keys=("patient_num",))
    found = found.select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))
    return found.select("patient_num", "channel", "idx", rounded("value", 3).alias("value"))


@query(
    "aeeg_margins",
    with_views("lines")
    + f"""
SELECT patient_num, channel, idx // {SECOND} AS idx,
  round(list_sort(list(value))[{int(0.09 * SECOND)}], 6) AS lower, round(list_sort(list(value))[{int(0.93 * SECOND)}], 6) AS upper
FROM osig GROUP BY 1, 2, 3 HAVING count(*) = {SECOND}""",
)
def aeeg_margins(spark, sf_dir):
    """Order statistics of tumbling windows, on the plain signal."""
    found = dsp.margins(views.order_steps(spark, sf_dir), SECOND, keys=("patient_num",))
    return found.select(
        "patient_num", "channel", "idx", rounded("lower").alias("lower"), rounded("upper").alias("upper")
    )


@query(
    "aeeg_margins_missing",
    with_views("signal")
    + """
SELECT patient_num, channel, idx // 12 AS idx,
  CASE WHEN count(value) = 12 THEN round(list_sort(list(value))[1], 6) END AS lower,
  CASE WHEN count(value) = 12 THEN round(list_sort(list(value))[11], 6) END AS upper
FROM sig GROUP BY 1, 2, 3 HAVING count(*) = 12""",
)
def aeeg_margins_missing(spark, sf_dir):
    """Windows with a missing sample have no margins."""
    found = dsp.margins(views.event_signal(spark, sf_dir), 12)
    return found.select(
        "patient_num", "channel", "idx", rounded("lower").alias("lower"), rounded("upper").alias("upper")
    )


_SMOOTH = dsp.sections(5, "lowpass", (0.32,), 256.0)
_LOUD = 1.05


def _loud_seconds(spark, sf_dir):
    """Seconds in which a recording ships more than usual, as intervals."""
    sums = views.order_seconds(spark, sf_dir, 256).drop("group")
    usual = sums.groupBy("patient_num").agg(F.avg("q").alias("m"))
    return intervals.runs(sums.join(usual, "patient_num").select("patient_num", "idx", (F.col("q") > _LOUD * F.col("m")).alias("flag")))


@query(
    "aeeg_lower_margin",
    with_views(
        "lines",
        f"""
fir AS (
  SELECT patient_num, channel, idx, abs({" + ".join(f"coalesce(lag(value, {k}) OVER w, 0.0) * {h!r}" for k, h in enumerate(_TAPS))}) AS value
  FROM osig WINDOW w AS (PARTITION BY patient_num, channel ORDER BY idx)),
series AS (SELECT patient_num, channel, list(value ORDER BY idx) AS xs FROM fir GROUP BY 1, 2)""",
        _response_sql("smooth", _SMOOTH, _LONGEST),
        _pass_sql("enveloped", "series", "smooth", None),
        f"""
sums AS (SELECT patient_num, idx // 256 AS idx, sum(value) AS q FROM osig GROUP BY 1, 2),
loud AS (SELECT patient_num, idx, q > {_LOUD} * avg(q) OVER (PARTITION BY patient_num) AS flag FROM sums)""",
        runs_sql("runs", "loud", "idx", "flag"),
    ).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
points AS (SELECT patient_num, channel, unnest(range(0, len(xs))) AS idx, unnest(xs) AS v FROM enveloped),
masked AS (
  SELECT p.patient_num, channel, idx, CASE WHEN count(r.on_s) = 0 THEN any_value(v) END AS v FROM points p
  LEFT JOIN runs r ON r.patient_num = p.patient_num AND r.on_s <= idx / 256.0 AND idx / 256.0 < r.off_s GROUP BY 1, 2, 3)
SELECT patient_num, channel, idx // {SECOND} AS idx,
  CASE WHEN count(v) = {SECOND} THEN round(list_sort(list(v))[{int(0.09 * SECOND)}], 5) + 0.0 END AS value
FROM masked GROUP BY 1, 2, 3 HAVING count(*) = {SECOND}""",
)
def aeeg_lower_margin(spark, sf_dir):
    """Lower margin of the filtered amplitude envelope, artifacts masked after filtering."""
    envelopes = dsp.envelope(views.order_steps(spark, sf_dir), 256.0, keys=("patient_num",)).withColumn("t", F.col("idx") / 256.0)
    masked = signal.mask_covered(envelopes, _loud_seconds(spark, sf_dir))
    lower = dsp.lower_margin(dsp.margins(masked, SECOND, keys=("patient_num",)))
    return lower.select("patient_num", "channel", "idx", rounded("value", 5).alias("value"))
