"""Wide signals give what long ones give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.operators import dsp, rolling, signal, tricorr
from tracemill.plans import views

KEY = ("patient_num",)


@pytest.fixture(scope="module")
def both(spark):
    """Two recordings, one without a number, of two channels; samples are missing in one channel or in both."""
    steps = spark.range(640).selectExpr("nullif(cast(id % 2 AS int), 0) AS patient_num", "id div 2 AS idx")
    value = "CASE WHEN {hole} THEN NULL ELSE cast(hash(patient_num, idx, {c}) % 100 AS double) END"
    holes = {0: "idx = 250", 1: "idx = 40 AND patient_num IS NULL"}
    wide = steps.select("patient_num", "idx", F.array(*[F.expr(value.format(hole=h, c=c)) for c, h in holes.items()]).alias("value"))
    return wide.cache(), wide.select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))


def test_snippets(both, rows):
    wide, long = both
    absent = "patient_num IS NULL OR idx NOT IN (3, 77)"
    columns = ("patient_num", "snippet", "n_channels", "length", "cells")
    for cut in (lambda s: signal.snippets(s, 50, full_only=False), lambda s: signal.snippets(s, 64, offset=10)):
        assert rows(cut(wide.filter(absent)), *columns) == rows(cut(long.filter(absent)), *columns)
    starts = wide.filter("idx IN (0, 60, 270, 271)").select("patient_num", F.col("idx").alias("first"))
    at = [rows(signal.snippets_at(s.filter(absent), starts, 50), *columns, "first") for s in both]
    assert at[0] == at[1] and len(at[0]) == 6


def test_masks_margins_and_windows(both, rows):
    wide, long = both
    covered = wide.sparkSession.createDataFrame([(1, 90.0, 170.0)], "patient_num int, on_s double, off_s double")
    masked = [signal.mask_covered(s.withColumn("t", F.col("idx").cast("double")), covered) for s in both]
    columns = ("patient_num", "channel", "idx", "lower", "upper")
    found = rows(dsp.margins(masked[0], 20, keys=KEY), *columns)
    assert found == rows(dsp.margins(masked[1], 20), *columns) and len(found) == 64
    columns = ("patient_num", "channel", "idx", "value")
    found = rows(rolling.rolling_by(wide, 7, rolling.median, KEY, block_len=70), *columns)
    assert found == rows(rolling.rolling_by(long, 7, rolling.median, block_len=70), *columns) and len(found) == 1280


@pytest.mark.parametrize("block_len", [100, 106, 1 << 16])  # the last block is short, one of the tail, the only one
def test_filters(both, rows, block_len):
    wide, long = both
    whole = F.coalesce("value", F.lit(0.0))
    for run in (lambda s, keys: dsp.envelope(s, 256.0, keys=keys, block_len=block_len), lambda s, keys: dsp.clean_channels(s, 256.0, keys=keys, block_len=block_len)):
        filled = wide.withColumn("value", F.transform("value", lambda v: F.coalesce(v, F.lit(0.0))))
        found = run(filled, KEY).select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))
        a, b = (rows(d, "patient_num", "channel", "idx", "value") for d in (found, run(long.withColumn("value", whole), dsp.KEYS)))
        assert [r[:3] for r in a] == [r[:3] for r in b] and len(a) == 1280
        assert [r[3] for r in a] == pytest.approx([r[3] for r in b], abs=1e-9)
    # missing samples: the same steps are missing in both forms
    found = dsp.envelope(wide, 256.0, keys=KEY, block_len=block_len).select("patient_num", "idx", F.posexplode("value").alias("channel", "value"))
    gone = [rows(d.filter("value IS NULL"), "patient_num", "channel", "idx") for d in (found, dsp.envelope(long, 256.0, block_len=block_len))]
    assert gone[0] == gone[1] and (None, 0, 250) in gone[0] and (None, 0, 249) not in gone[0] and (1, 1, 40) not in gone[0]


def test_seconds_of_orders_are_the_sums_of_the_order_signal(spark, tmp_path, rows):
    lines = [(0, 3, 2.0), (0, 18, 5.0), (7, 17, 1.0), (23, None, 9.0), (None, 1, 4.0), (2, 5, None), (7501, 18, 3.0), (-3, 1, 8.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    every = views.order_signal(spark, str(tmp_path))
    for groups in (1, 3):
        sums = every.groupBy("patient_num", F.floor(F.col("idx") / 10).alias("idx"), (F.col("channel") % groups).alias("group")).agg(F.sum("value").alias("q"))
        found = rows(views.order_seconds(spark, str(tmp_path), 10, groups), "patient_num", "idx", "group", "q")
        assert found == rows(sums, "patient_num", "idx", "group", "q") and len(found) == 4 * groups
    tops = every.groupBy("patient_num").agg(F.max("idx").alias("top"))
    assert rows(views.order_tops(spark, str(tmp_path)), "patient_num", "top") == rows(tops, "patient_num", "top")


def test_snippets_are_dealt_to_a_given_number_of_tasks(both):
    found = tricorr.class_contributions(both[0], 50, (0, 1))
    assert found.rdd.getNumPartitions() == tricorr.SNIPPET_PARTS
