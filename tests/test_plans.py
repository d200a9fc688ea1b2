"""Physical plans: no cross joins, no row-at-a-time Python, pruned scans, few exchanges."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as entry
from tracemill.operators import dsp, tables
from tracemill.operators.rolling import rolling
from tracemill.operators.scan import PARTS
from tracemill.plans import views

SF_DIR = os.path.join(compare.DATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    "sig_rolling_long sig_standardize_across iv_mask_seizure det_roc_sweep det_auc_by_group st_ks tc_recording rel_sample".split(),
)
def test_no_pairs_and_no_row_udfs(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(entry.queries()["st_delta"](spark, SF_DIR))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text


def test_filters_reach_the_scan(spark):
    orders = views.table(spark, SF_DIR, "orders").filter("o_totalprice > 400000").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plan(orders)


def test_long_windows_share_one_exchange(spark):
    df = spark.range(10).selectExpr("id % 2 AS patient_num", "id % 3 AS channel", "id AS idx", "double(id) AS value")
    assert plan(rolling(df, 100)).count("Exchange hashpartitioning") == 1


def test_bulk_steps_keep_their_number_of_tasks(spark):
    """Few bytes a row must not put more rows into one task."""
    df = spark.range(10).selectExpr("id % 2 AS patient_num", "id % 3 AS channel", "id AS idx", "double(id) AS value")
    for found in (rolling(df, 100), rolling(df, 100, "std"), dsp.fir(df, [0.5, 0.5])):
        assert found.rdd.getNumPartitions() == PARTS
    fir = plan(dsp.fir(df, [0.5, 0.5]))
    assert "FlatMapGroupsInArrow" in fir and " MapInArrow" not in fir and "collect_list" not in fir


def test_the_order_signal_shuffles_steps_and_widens_without_another_shuffle(spark):
    signal = views.order_signal(spark, SF_DIR)
    wide = tables.widened(signal, ["patient_num", "idx"], range(views.ORDER_CHANNELS))
    assert "Join" not in plan(signal)
    assert plan(wide).count("Exchange hashpartitioning") == plan(signal).count("Exchange hashpartitioning")
    assert "pivotfirst" not in plan(wide)


def test_the_order_signal_of_odd_rows(spark, tmp_path):
    rows = [(0, 3, 2.0), (0, 3, 5.0), (0, 17, 1.0), (2, None, 9.0), (None, 1, 4.0), (2, 5, None), (7501, 18, 3.0)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r.patient_num, r.idx, r.channel): r.value for r in views.order_signal(spark, str(tmp_path)).collect()}
    assert len(found) == (3 + 2) * views.ORDER_CHANNELS
    assert {k: v for k, v in found.items() if v} == {(0, 0, 3): 7.0, (0, 0, 0): 1.0, (1, 1, 1): 3.0}


LAZY = (
    "iv_runs iv_merge iv_collapse iv_invert st_ks st_mannwhitney st_box_table st_jsd sig_rolling_long tc_recording dsp_clean rel_sort"
).split()


def test_building_a_query_starts_no_job(spark):
    started = {}
    for name in LAZY:
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        entry.queries()[name](spark, SF_DIR)
        started[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {n: k for n, k in started.items() if k} == {}
