"""Registered queries against their SQL. TRACEMILL_FULL=1 runs all of them."""

from __future__ import annotations

import os

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = os.path.join(compare.DATA, "sf0.01")
QUICK = (
    "sig_dense sig_rolling_std sig_standardize_within sig_reduce_distance sig_coarse_bool sig_artifact_mask "
    "iv_runs iv_collapse iv_merge iv_invert iv_containing_bins iv_keyword det_posseizure det_roc_sweep det_auc_by_group "
    "st_ks st_mannwhitney st_jsd tc_class_small tc_class_factored tc_zscore_std tc_lag_kernel_space dsp_fir aeeg_margins "
    "rel_unpivot rel_sample fn_roman fn_sigdigits stream_tumbling"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.database(SF_DIR)


NAMES = sorted(entry.oracle_sql()) if os.environ.get("TRACEMILL_FULL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare.difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["patient_num", "idx", "value"]
    assert found.filter("value IS NOT NULL").count() > 0
