"""Streaming forms of the windowed operators.

Streams have `patient_num, channel, ts, value`. Windows are keyed by recording, channel and
window, so one busy channel is spread over the state store's partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions.nulls import complete

KEYS = ("patient_num", "channel")


def tumbling(
    stream: DataFrame,
    width: str,
    lateness: str,
    reduce: Callable[[Column], Column] = F.max,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
) -> DataFrame:
    """Coarse-grained bins of a stream; a NULL poisons its bin, later rows are dropped."""
    bins = stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("_w"))
    found = bins.agg(complete(reduce(F.col("value")), "value").alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("_w.start").alias("start"), "n", "value")


def sliding(
    stream: DataFrame,
    width: str,
    step: str,
    lateness: str,
    expected: int | None = None,
    stat: Callable[[Column], Column] = F.avg,
    keys: Sequence[str] = KEYS,
    ts: str = "ts",
) -> DataFrame:
    """Rolling statistic as overlapping windows, NULL unless `expected` values are present."""
    windows = stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width, step).alias("_w"))
    value = stat(F.col("value"))
    if expected is not None:
        value = F.when(F.count("value") == expected, value)
    found = windows.agg(value.alias("value"), F.count("value").alias("n"))
    return found.select(*keys, F.col("_w.end").alias("end"), "n", "value")


def sessions(
    stream: DataFrame, gap: str, lateness: str, keys: Sequence[str] = ("patient_num",), ts: str = "ts"
) -> DataFrame:
    """Events closer than `gap` joined into one interval."""
    joined = stream.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("_w"))
    found = joined.agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def rolling(stream: DataFrame, k: int, block_len: int = 4096) -> DataFrame:
    """Mean and standard deviation of the last `k` samples, updated as samples arrive.

    The stream has `patient_num, channel, idx, value`; the samples of a channel arrive in
    the order of `idx`. A channel is cut into blocks that also see the `k - 1` samples
    before them, so its state moves on and is dropped block by block. A missing value or
    step gives NULL for the windows that touch it.
    """
    if block_len < k:
        raise ValueError("a block must hold a whole window")
    i = F.col("idx")
    reach = F.sequence(F.floor(i / block_len), F.floor((i + k - 1) / block_len))
    halo = stream.withColumn("block", F.explode(reach))

    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        patient, channel, block = key
        held_idx, held = state.get if state.exists else ([], [])
        rows = pd.concat(batches).sort_values("idx")
        idx = np.concatenate([np.asarray(held_idx, "int64"), rows["idx"].to_numpy("int64")])
        values = np.concatenate([np.asarray(held, float), rows["value"].to_numpy(float)])
        end = (block + 1) * block_len
        if len(idx) and idx[-1] >= end - 1:
            state.remove()
        else:
            state.update((idx[-(k - 1) :].tolist() if k > 1 else [], values[-(k - 1) :].tolist() if k > 1 else []))
        first_new = len(held)
        padded = np.concatenate([np.full(k - 1, np.nan), values])
        windows = np.lib.stride_tricks.sliding_window_view(padded, k)
        starts = np.concatenate([np.full(k - 1, -1, "int64"), idx])[: len(idx)]
        gapless = (idx - starts == k - 1) & (np.arange(len(idx)) >= k - 1)
        with np.errstate(invalid="ignore"):
            mean = np.where(gapless, windows.mean(axis=1), np.nan)
            std = np.where(gapless, windows.std(axis=1, ddof=1) if k > 1 else np.nan, np.nan)
        out = pd.DataFrame(
            {"patient_num": patient, "channel": channel, "idx": idx, "mean": mean, "std": std}
        )[first_new:]
        yield out[out["idx"] // block_len == block]

    return halo.groupBy("patient_num", "channel", "block").applyInPandasWithState(
        update,
        "patient_num int, channel string, idx bigint, mean double, std double",
        "idx array<bigint>, held array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and, beside it, the folder that `end_stream` later writes to.

    A windowed operator holds its last windows until its clock passes them, so the end of a
    finite input has to be told. The mark is a row with NULL in all columns but the time.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    marks = stream.sparkSession.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(marks)


def end_stream(stream: DataFrame, folder: str, at: str = "9000-01-01", ts: str = "ts") -> None:
    """Write the end mark of `stream`, later than any event; it is in a window of its own that never closes."""
    columns = [
        (F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields
    ]
    stream.sparkSession.range(1).select(*columns).write.mode("append").parquet(folder)


def run_to_end(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, marks: str, ts: str = "ts"
) -> DataFrame:
    """Run a finite stream through a windowed operator until all its windows are out.

    First everything that the stream holds is taken in, then the end mark; both runs share one
    checkpoint, so a run that is lost goes on where it was.
    """
    ended = operator(with_end(stream, marks))
    run_to_table(ended, path, checkpoint)
    end_stream(stream, marks, ts=ts)
    return run_to_table(ended, path, checkpoint)


def run_to_table(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a finite stream to its end into Parquet and read that back."""
    running = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    running.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
