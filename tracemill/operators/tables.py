"""Small relational steps of the analysis: reshaping, sampling, sets, record arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tracemill.functions.nulls import join_on

SALTS = 64


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack the frames by column name; absent ones (None) are passed over."""
    kept = [f for f in frames if f is not None]
    if not kept:
        raise ValueError("nothing to stack")
    out = kept[0]
    for frame in kept[1:]:
        out = out.unionByName(frame)
    return out


def labelled_cases(control: DataFrame, seizure: DataFrame) -> DataFrame:
    """Both samples in one table, `case` 1 for control and 2 for seizure."""
    return control.withColumn("case", F.lit(1)).unionByName(seizure.withColumn("case", F.lit(2)))


def stacked(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unpivot to (ids, variable, value)."""
    return wide.unpivot(list(ids), list(columns), "variable", "value")


def widened(long: DataFrame, ids: Sequence[str], classes: Sequence[int], by: str = "channel") -> DataFrame:
    """One column per class; the classes are given, so no extra pass finds them."""
    # side by side in one aggregate: a pivot first groups by class as well, with a row per value
    picks = [F.first(F.when(F.col(by) == c, F.col("value")), ignorenulls=True).alias(str(c)) for c in classes]
    return long.groupBy(*ids).agg(*picks)


def priority(seed: int, *parts: str) -> Column:
    """Repeatable pseudo-random order of rows by their identifying columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def sample_per_key(df: DataFrame, n: int, keys: Sequence[str], identity: Sequence[str], seed: int = 0) -> DataFrame:
    """`n` rows of each key without replacement (all rows of a key with fewer).

    Each of several slices of a key keeps its own first `n` by priority, so no task sorts
    a whole key.
    """
    ranked = df.withColumn("_p", priority(seed, *identity))
    sliced = ranked.withColumn("_salt", F.pmod(F.hash("_p"), F.lit(SALTS)))
    near = Window.partitionBy(*keys, "_salt").orderBy("_p")
    near_rows = sliced.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= n)
    last = Window.partitionBy(*keys).orderBy("_p")
    picked = near_rows.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    return picked.drop("_p", "_salt", "_r")


def control_and_seizure_starts(
    seizure_starts: DataFrame,
    control_starts: DataFrame,
    n: int,
    keys: Sequence[str],
    seed: int = 0,
) -> DataFrame:
    """Up to `n` seizure and exactly `n` control snippets per key, with their `case`.

    A key with no more than `n` control snippets is left out.
    """
    identity = [*keys, "start_s"]
    enough = control_starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n)
    enough = enough.select(*keys)
    seizure = sample_per_key(join_on(seizure_starts, enough, keys, "left_semi"), n, keys, identity, seed)
    control = sample_per_key(join_on(control_starts, enough, keys, "left_semi"), n, keys, identity, seed + 1)
    return labelled_cases(control.select(*identity), seizure.select(*identity))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that `right` lacks."""
    return left.select(*right.columns).subtract(right)


def summed_records(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Field-wise sum of records; absent ones count as nothing."""
    return df.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in fields])


def mean_records(df: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in fields])


def divided_records(first: DataFrame, second: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Field-wise ratio of two tables of records."""
    other = second.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    ratios = [(F.col(f) / F.nullif(f"_{f}", F.lit(0.0))).alias(f) for f in fields]
    return join_on(first, other, keys).select(*keys, *ratios)


def shuffled_values(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Permute `value` among the rows (by `idx`) of each bounded group, repeatably."""
    by_place = Window.partitionBy(*keys).orderBy("idx")
    by_chance = Window.partitionBy(*keys).orderBy(priority(seed, *keys, "idx"))
    ranked = df.withColumns({"_r": F.row_number().over(by_place), "_s": F.row_number().over(by_chance)})
    places = ranked.select(*keys, "idx", F.col("_r"))
    values = ranked.select(*keys, F.col("_s").alias("_r"), "value")
    return join_on(places, values, [*keys, "_r"]).drop("_r")


def prettified(sensitivity: DataFrame) -> DataFrame:
    """Columns of the sensitivity table under their display names."""
    return sensitivity.select(
        "target",
        "standardization",
        "signal",
        F.col("auc").alias("AUC"),
        F.col("tpr57").alias("TPR"),
        F.col("fphr80").alias("FPHr"),
    )
