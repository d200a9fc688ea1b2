"""Stateful rolling statistics over several micro-batches."""

from __future__ import annotations

import statistics as stats

import pytest

from tracemill.streaming import windows

SCHEMA = "patient_num int, channel string, idx bigint, value double"


@pytest.mark.parametrize("k,block", [(1, 4), (4, 8), (5, 5)])
def test_rolling_over_batches(spark, tmp_path, k, block):
    values = [None if i == 17 else float((i * 37) % 11) for i in range(40)]
    for b in range(4):
        part = [(p, "a", i, values[i] if p else 1.0) for p in (0, 1) for i in range(b * 10, b * 10 + 10)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{b}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    found = windows.run_to_table(windows.rolling(stream, k, block), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.patient_num, r.idx): (r.mean, r.std) for r in found.collect()}
    assert len(got) == 80
    for i in range(40):
        window = values[max(0, i - k + 1) : i + 1]
        if i < k - 1 or None in window:
            assert got[1, i] == (None, None)
        else:
            assert got[1, i][0] == pytest.approx(stats.fmean(window))
            if k > 1:
                assert got[1, i][1] == pytest.approx(stats.stdev(window))


def test_block_must_hold_a_window(spark):
    with pytest.raises(ValueError):
        windows.rolling(None, 5, block_len=4)


EVENTS = "patient_num int, channel string, ts timestamp, value double"


def test_a_finite_stream_gives_all_its_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(p, "a", start + timedelta(minutes=10 * i), float(i)) for p in (1, None) for i in range(12)]
    for b in range(3):
        part = rows[b::3]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))

    def finished(name, operator):
        return windows.run_to_end(stream, operator, *[str(tmp_path / name / d) for d in ("out", "state", "marks")]).collect()

    bins = finished("bins", lambda s: windows.tumbling(s, "1 hour", "1 day"))
    assert sorted((r.patient_num or 0, r.n, r.value) for r in bins) == [(0, 6, 5.0), (0, 6, 11.0), (1, 6, 5.0), (1, 6, 11.0)]
    bursts = finished("bursts", lambda s: windows.sessions(s, "15 minutes", "1 day"))
    assert sorted((r.patient_num or 0, r.n) for r in bursts) == [(0, 12), (1, 12)]


def test_an_empty_stream_ends_without_windows(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    folders = [str(tmp_path / d) for d in ("out", "state", "marks")]
    assert windows.run_to_end(stream, lambda s: windows.tumbling(s, "1 hour", "1 day"), *folders).count() == 0


@pytest.mark.parametrize("files", [None, 3])
def test_a_table_in_one_file_or_many_streams_whole(spark, tmp_path, files):
    from tracemill.plans import views
    from tracemill.plans.streaming_queries import stream_rolling

    rows = [(i, [float((i * j) % 7) for j in range(64)], i % 2) for i in range(12)]
    table = spark.createDataFrame(rows, views.SCHEMAS["embeddings"]).repartition(files or 1)
    place = tmp_path / ("tables" if files else "parts")
    table.write.parquet(str(place / "embeddings.parquet"))
    if not files:
        (part,) = (place / "embeddings.parquet").glob("part-*.parquet")
        (tmp_path / "tables").mkdir()
        (tmp_path / "tables" / "embeddings.parquet").write_bytes(part.read_bytes())
    found = stream_rolling(spark, str(tmp_path / "tables"))
    assert found.count() == 12 * 64
    assert found.filter("idx >= 7 AND mean IS NULL").count() == 0
