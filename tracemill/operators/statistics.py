"""Two-sample statistics per group, by way of counts per distinct value.

Ranks, distribution functions and quantiles all come from one ordered scan over distinct
values (see `scan`), so a group of any size is spread over tasks. Kernel densities are
taken over a fixed grid onto which the samples are first added up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracemill.functions.scalar import significance
from tracemill.functions.ranksum import two_sided
from tracemill.functions.special import kolmogorov_tail, two_sided_normal
from tracemill.functions.nulls import join_on
from tracemill.operators.scan import running, value_blocks

GRID_POINTS = 2048
GRID_MARGIN = 4.0  # bandwidths beyond the data on each side


def deltas(samples: DataFrame, keys: Sequence[str], value: str = "value", case: str = "is_seizure") -> DataFrame:
    """Differences of mean and standard deviation, seizure minus control."""
    inside = F.when(F.col(case), F.col(value))
    outside = F.when(~F.col(case), F.col(value))
    return samples.groupBy(*keys).agg(
        (F.avg(inside) - F.avg(outside)).alias("d_mu"),
        (F.stddev_samp(inside) - F.stddev_samp(outside)).alias("d_sigma"),
    )


def ranked_values(samples: DataFrame, keys: Sequence[str], value: str, case: str) -> DataFrame:
    """Counts of both samples at and below each distinct value of the group."""
    present = samples.filter(F.col(value).isNotNull() & F.col(case).isNotNull())
    counted = present.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(case)).alias("n1"), F.count_if(~F.col(case)).alias("n0")
    )
    sums = {"upto1": ("sum", F.col("n1")), "upto0": ("sum", F.col("n0"))}
    return running(value_blocks(counted, keys, "v"), keys, "_block", ["v"], sums).drop("_block")


def _sizes(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.sum("n1").alias("m1"), F.sum("n0").alias("m0"))


def kolmogorov_smirnov(
    samples: DataFrame, keys: Sequence[str], value: str = "value", case: str = "is_seizure"
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance with its asymptotic p-value."""
    ranked = ranked_values(samples, keys, value, case)
    gaps = join_on(ranked, _sizes(ranked, keys), keys).filter("m1 > 0 AND m0 > 0")
    gap = F.abs(F.col("upto1") / F.col("m1") - F.col("upto0") / F.col("m0"))
    tests = gaps.groupBy(*keys).agg(
        F.max(gap).alias("d"), F.first("m1").alias("m1"), F.first("m0").alias("m0")
    )
    reach = F.col("d") * F.sqrt(F.col("m1").cast("double") * F.col("m0") / (F.col("m1") + F.col("m0")))
    return tests.withColumn("_x", reach).select(*keys, "d", kolmogorov_tail("_x").alias("p"))


#: Values of both cases up to which Mann-Whitney is exact, without and with ties.
EXACT, EXACT_TIED = 50, 10


@F.pandas_udf(DoubleType())
def _exact_p(u: pd.Series, m: pd.Series, groups: pd.Series) -> pd.Series:
    """Exact p-values; NULL where `groups`, the sizes of ties in ascending order, is NULL."""
    found = [None if g is None else two_sided(a, int(b), tuple(g.tolist())) for a, b, g in zip(u, m, groups, strict=True)]
    return pd.Series(found, dtype="float64")


def mann_whitney(
    samples: DataFrame, keys: Sequence[str], value: str = "value", case: str = "is_seizure"
) -> DataFrame:
    """Mann-Whitney U of each group, with a two-sided p-value.

    `exact` tells how p was found: from the exact null distribution for up to `EXACT` values
    without ties or `EXACT_TIED` with, else by the tie-corrected normal approximation with
    continuity correction. A group without values of both cases has no row.
    """
    ranked = ranked_values(samples, keys, value, case)
    n = (F.col("n1") + F.col("n0")).cast("double")
    small = F.when(F.col("upto1") + F.col("upto0") <= EXACT, F.struct("v", (F.col("n1") + F.col("n0")).cast("int").alias("t")))
    tests = ranked.groupBy(*keys).agg(
        F.sum(F.col("n1") * (F.col("upto0") - F.col("n0") / 2.0)).alias("u"),
        F.sum(n * n * n - n).alias("_ties"),
        F.sum("n1").cast("double").alias("_m1"),
        F.sum("n0").cast("double").alias("_m0"),
        F.sum(F.col("v") * F.col("n1")).alias("_s1"),
        F.sum(F.col("v") * F.col("n0")).alias("_s0"),
        F.sort_array(F.collect_list(small))["t"].alias("_groups"),  # EXACT entries at most
    )
    total = F.col("_m1") + F.col("_m0")
    ties = F.col("_ties") / (total * (total - 1))
    tests = tests.filter("_m1 > 0 AND _m0 > 0").withColumns(
        {
            "_off": F.col("u") - F.col("_m1") * F.col("_m0") / 2,
            "_sigma": F.sqrt(F.col("_m1") * F.col("_m0") / 12 * (total + 1 - ties)),
        }
    )
    z = F.abs(F.col("_off") - 0.5 * F.signum("_off")) / F.nullif("_sigma", F.lit(0.0))
    exact = (total <= EXACT_TIED) | ((total <= EXACT) & (F.col("_ties") == 0))
    tests = tests.withColumns({"_z": z, "exact": exact})
    counted = _exact_p("u", F.col("_m1").cast("int"), F.when(F.col("exact"), F.col("_groups")))
    normal = F.when(F.col("_sigma") == 0, F.lit(1.0)).otherwise(two_sided_normal("_z"))
    return tests.select(
        *keys,
        "u",
        F.coalesce(counted, normal).alias("p"),
        "exact",
        (F.col("_s1") / F.col("_m1") - F.col("_s0") / F.col("_m0")).alias("mean_effect"),
    )


def quantiles(samples: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation, one column `q{i}` per share."""
    present = samples.filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(value_blocks(counted, keys, "v"), keys, "_block", ["v"], {"upto": ("sum", F.col("n"))})
    sizes = ranked.groupBy(*keys).agg(F.sum("n").alias("_m"))
    if keys:
        placed = join_on(ranked, sizes, keys)
    else:
        placed = ranked.withColumn("_m", sizes.scalar())

    def holds(position: Column) -> Column:
        # 0-based position falls among the copies of this value
        return (position >= F.col("upto") - F.col("n")) & (position < F.col("upto"))

    picks = []
    for i, share in enumerate(shares):
        at = (F.col("_m") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when(holds(low), F.col("v"))).alias(f"_a{i}"),
            F.max(F.when(holds(high), F.col("v"))).alias(f"_b{i}"),
            F.max(at - low).alias(f"_w{i}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_a{i}") + F.col(f"_w{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}")
            for i in range(len(shares))
        ],
    )


def box_table(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Five-number summary behind a box plot."""
    names = ["low", "q25", "median", "q75", "high"]
    five = quantiles(samples, keys, [0.0, 0.25, 0.5, 0.75, 1.0], value)
    return five.select(*keys, *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def bandwidth(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Silverman's rule with factor 0.9, plus sample size and extent, per group."""
    moments = samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"),
        F.min(value).cast("double").alias("lo"),
        F.max(value).cast("double").alias("hi"),
    )
    spread = join_on(moments, quantiles(samples, keys, [0.25, 0.75], value), keys)
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    width = F.least("_sd", iqr)
    width = F.when(width == 0, F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))).otherwise(width)
    h = F.when(F.col("n") <= 1, F.lit(0.9)).otherwise(0.9 * width * F.pow(F.col("n"), F.lit(-0.2)))
    return spread.select(*keys, "n", "lo", "hi", h.alias("h"))


def binned(
    samples: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    case: str = "is_seizure",
    points: int = GRID_POINTS,
) -> DataFrame:
    """Both samples of each group shared out linearly over one common grid.

    Rows are `keys, case, cell, weight, n, h, x0, step`: at most `points` cells per group
    and case, however many samples there are.
    """
    grid = bandwidth(samples, keys, value).select(
        *keys,
        (F.col("lo") - GRID_MARGIN * F.col("h")).alias("x0"),
        ((F.col("hi") - F.col("lo") + 2 * GRID_MARGIN * F.col("h")) / (points - 1)).alias("step"),
    )
    own = bandwidth(samples, [*keys, case], value).select(*keys, case, "n", "h")
    placed = join_on(samples.filter(F.col(value).isNotNull()), grid, keys)
    at = (F.col(value) - F.col("x0")) / F.col("step")
    cell = F.floor(at)
    placed = placed.withColumns({"_cell": cell, "_right": at - cell})
    shares = F.array(
        F.struct(F.col("_cell").alias("cell"), (1 - F.col("_right")).alias("weight")),
        F.struct((F.col("_cell") + 1).alias("cell"), F.col("_right").alias("weight")),
    )
    spread = placed.select(*keys, case, F.inline(shares))
    cells = spread.groupBy(*keys, case, "cell").agg(F.sum("weight").alias("weight"))
    return join_on(join_on(cells, own, [*keys, case]), grid, keys)


def _smooth(cells: pd.DataFrame, points: int) -> np.ndarray:
    """Gaussian density on the grid from binned weights, by a periodic convolution."""
    weights = np.zeros(points)
    np.add.at(weights, cells["cell"].to_numpy(), cells["weight"].to_numpy())
    n, h, step = (float(cells[c].iloc[0]) for c in ("n", "h", "step"))
    turn = 2 * np.pi * np.fft.rfftfreq(points, step) * h
    density = np.fft.irfft(np.fft.rfft(weights / (n * step)) * np.exp(-0.5 * turn * turn), points)
    return np.clip(density, 0.0, None)


def kernel_densities(
    samples: DataFrame, keys: Sequence[str], value: str = "value", case: str = "is_seizure", points: int = GRID_POINTS
) -> DataFrame:
    """Long table `keys, case, x, density` over the group's common grid."""
    cells = binned(samples, keys, value, case, points)
    key_fields = [f for f in cells.schema.fields if f.name in (*keys, case)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)

    def densities(group: pd.DataFrame) -> pd.DataFrame:
        x0, step = float(group["x0"].iloc[0]), float(group["step"].iloc[0])
        out = pd.DataFrame({"x": x0 + step * np.arange(points), "density": _smooth(group, points)})
        for f in key_fields:
            out.insert(0, f.name, group[f.name].iloc[0])
        return out[[*(f.name for f in key_fields), "x", "density"]]

    return cells.groupBy(*keys, case).applyInPandas(densities, f"{schema}, x double, density double")


def js_distance(
    samples: DataFrame, keys: Sequence[str], value: str = "value", case: str = "is_seizure", points: int = GRID_POINTS
) -> DataFrame:
    """Jensen-Shannon distance of the two estimated densities (natural logarithm)."""
    cells = binned(samples, keys, value, case, points)
    key_fields = [f for f in cells.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)

    def distance(group: pd.DataFrame) -> pd.DataFrame:
        sides = [_smooth(part, points) for _, part in group.groupby(case)]
        row = {f.name: [group[f.name].iloc[0]] for f in key_fields}
        if len(sides) < 2:
            return pd.DataFrame(row | {"js": [None]})
        p, q = (side / side.sum() for side in sides)
        middle = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log(p / middle), 0) + np.where(q > 0, q * np.log(q / middle), 0)
        return pd.DataFrame(row | {"js": [float(np.sqrt(max(terms.sum() / 2, 0.0)))]})

    return cells.groupBy(*keys).applyInPandas(distance, f"{schema}, js double")


def normalize_by_group(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Divide each value by its group's standard deviation, as `{value}_z`."""
    spread = df.groupBy(group).agg(*[F.stddev_samp(v).alias(f"_{v}") for v in values])
    scaled = {f"{v}_z": F.col(v) / F.nullif(f"_{v}", F.lit(0.0)) for v in values}
    return join_on(df, spread, [group]).withColumns(scaled).drop(*[f"_{v}" for v in values])


def significance_table(differences: DataFrame, channel: str = "channel") -> DataFrame:
    """Per-channel scaled effects, star category and the plotted height of each p-value."""
    n = differences.select(F.count_distinct(channel)).scalar()
    scaled = normalize_by_group(differences, channel, ["d_mu", "d_sigma"]).withColumn("_n", n)
    height = F.log10(F.abs(F.log10(F.col("p"))))
    return scaled.withColumns({"significance": significance("p", F.col("_n")), "height": height}).drop("_n")


def class_weights(effects: DataFrame, n_nonzero: int, effect: str = "d_mu", keys: Sequence[str] = ()) -> DataFrame:
    """Unit-length weights: the sign of the effect for the most significant classes.

    One row per class and key, ordered by (p, effect, class).
    """
    order = Window.partitionBy(*keys).orderBy("p", effect, "class")
    picked = effects.withColumn(
        "weight", F.when(F.row_number().over(order) <= n_nonzero, F.signum(effect)).otherwise(F.lit(0.0))
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keys)))
    return picked.withColumn("weight", F.col("weight") / F.nullif(norm, F.lit(0.0)))


def first_class_weights(effects: DataFrame, effect: str = "d_mu", first: int = 1) -> DataFrame:
    """Weights that use the first class alone, by the sign of its effect."""
    return effects.withColumn(
        "weight", F.when(F.col("class") == first, F.signum(effect)).otherwise(F.lit(0.0))
    )
