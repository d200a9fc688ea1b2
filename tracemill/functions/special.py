"""Special functions as SQL text, so that they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 60
FRACTION_TERMS = 60


def erfc_sql(x: str) -> str:
    """erfc of a non-negative SQL expression to about 1e-13.

    Below 2 the all-positive series of erf is nested by Horner's rule; above, the
    continued fraction of erfc is unrolled.
    """
    square = f"({x})*({x})"
    series = "1.0E0"
    for n in range(SERIES_TERMS, 0, -1):
        series = f"(1.0E0 + {square}*{2.0 / (2 * n + 1)!r}E0*{series})"
    small = f"(1.0E0 - {2.0 / math.sqrt(math.pi)!r}E0*({x})*exp(-{square})*{series})"
    fraction = f"({x})"
    for n in range(FRACTION_TERMS, 0, -1):
        fraction = f"(({x}) + {n / 2.0!r}E0/{fraction})"
    large = f"(exp(-{square})/{math.sqrt(math.pi)!r}E0/{fraction})"
    return f"CASE WHEN ({x}) < 2.0E0 THEN {small} ELSE {large} END"


def two_sided_normal_sql(z: str) -> str:
    """P(|Z| >= z) for a standard normal Z."""
    return erfc_sql(f"(abs({z})/{math.sqrt(2.0)!r}E0)")


def kolmogorov_sql(x: str, terms: int = 20) -> str:
    """Upper tail of the Kolmogorov distribution.

    The alternating series converges for arguments above 1, its theta-function dual
    below; each is cut where its terms are far under double precision.
    """
    upper = " + ".join(
        f"{2.0 * (-1) ** (k - 1)!r}E0*exp({-2.0 * k * k!r}E0*({x})*({x}))" for k in range(1, terms + 1)
    )
    lower = " + ".join(
        f"exp({-((2 * k - 1) ** 2) * math.pi**2 / 8.0!r}E0/(({x})*({x})))" for k in range(1, terms + 1)
    )
    lower = f"1.0E0 - {math.sqrt(2.0 * math.pi)!r}E0/({x})*({lower})"
    return (
        f"CASE WHEN ({x}) <= 0.0E0 THEN 1.0E0 "
        f"WHEN ({x}) < 1.0E0 THEN greatest(0.0E0, least(1.0E0, {lower})) "
        f"ELSE greatest(0.0E0, least(1.0E0, {upper})) END"
    )


def two_sided_normal(column: str) -> Column:
    return F.expr(two_sided_normal_sql(column))


def kolmogorov_tail(column: str) -> Column:
    return F.expr(kolmogorov_sql(column))
