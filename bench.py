"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tracemill.plans.catalog import QUERIES
from tracemill.session import local_session

HEADLINE = (
    "tc_recording tc_class_factored tc_class_small tc_noise_difference sig_rolling_long sig_rolling_long_std "
    "sig_standardize_across sig_rms_classes iv_merge iv_collapse iv_runs det_all_patients det_roc_sweep st_ks st_mannwhitney "
    "st_jsd aeeg_lower_margin dsp_clean dsp_fir aeeg_margins"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start the workers and warm the reader before the first measurement
    QUERIES["tc_class_factored"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)})
    )


if __name__ == "__main__":
    main()
