"""Scalar column functions: text parsing, labels, numerals, significance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.nulls import ColumnOrName, col

# Channel-name parts removed from labels, in order of removal.
LABEL_NOISE = ("-Ref", "-REF", "EEG ")

# Default words that mark a channel as unusable in each collection.
DEFAULT_EXCLUDED_CHANNELS = ("ECG", "Resp", "Cz", "Fz")
DEFAULT_EXCLUDED_CHANNELS_SECOND_SITE = (
    "ECG", "Stimuli", "Stimulus", "Test", "Unspec", "Buf", "EOG", "EKG",
)
DEFAULT_EVENT_KEYWORDS = ("seizure", "epi", "eppi")


def contains_any(text: ColumnOrName, words: Iterable[str]) -> Column:
    """Case-insensitive substring test against any of `words` (false for no words)."""
    lowered = F.lower(col(text))
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word.lower())
    return hit


def clean_label(label: ColumnOrName, noise: Iterable[str] = LABEL_NOISE) -> Column:
    out = col(label)
    for part in noise:
        out = F.replace(out, F.lit(part), F.lit(""))
    return out


def parse_grade(text: ColumnOrName, strict: bool = False, on_error: str = "raise") -> Column:
    """Artifact grade 1 or 2 out of free text.

    The default keeps the historical reading in which "grade ii" is caught by the
    test for "grade i" and yields 1; `strict=True` reads the Roman numeral as 2.
    """
    low = F.lower(col(text))
    one = low.contains("grade i") | low.contains("grade 1")
    two = low.contains("grade ii") | low.contains("grade 2")
    if strict:
        one = one & ~low.contains("grade ii")
    failure = (
        F.raise_error(F.concat(F.lit("Could not parse grade: "), low)).cast("int")
        if on_error == "raise"
        else F.lit(None).cast("int")
    )
    return F.when(one, F.lit(1)).when(two, F.lit(2)).otherwise(failure)


def clock_seconds(clock: ColumnOrName) -> Column:
    """Seconds since midnight of an `HH:MM:SS` string."""
    part = F.split(col(clock), ":")
    return (
        F.element_at(part, 1).cast("int") * 3600
        + F.element_at(part, 2).cast("int") * 60
        + F.element_at(part, 3).cast("int")
    )


def parse_start(text: ColumnOrName, recording_start: ColumnOrName) -> Column:
    """Seconds from the recording start of a `d1 HH:MM:SS` note; other days are an error."""
    part = F.split(F.trim(col(text)), r"\s+")
    day, clock = F.element_at(part, 1), F.element_at(part, 2)
    offset = (clock_seconds(clock) - clock_seconds(recording_start)).cast("double")
    return F.when(day == "d1", offset).otherwise(
        F.raise_error(F.concat(F.lit("expected day d1, got "), day)).cast("double")
    )


def parse_duration(text: ColumnOrName) -> Column:
    """Whole seconds of an `N sec` note; another unit is an error."""
    part = F.split(F.trim(col(text)), r"\s+")
    unit = F.lower(F.element_at(part, 2))
    return F.when(unit == "sec", F.element_at(part, 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("expected sec, got "), unit)).cast("int")
    )


def file_id(number: ColumnOrName, prefix: str = "EEG", width: int = 3) -> Column:
    """`prefix` and the number with zeros up to `width` digits; longer numbers stay whole."""
    digits = col(number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def stem(path: ColumnOrName) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(col(path), r"([^/]*?)(\.[^./]*)?$", 1)


def roman(number: ColumnOrName, zero: str | None = "0") -> Column:
    """Roman numeral of 0..4999; zero is spelt `zero`, or refused when that is None."""
    n = col(number).cast("int")
    digits = []
    for place, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")),
                                    (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        d = F.floor(n / place) % 10
        if place == 1000:
            digits.append(F.repeat(F.lit(one), d.cast("int")))
            continue
        digits.append(
            F.when(d == 9, F.lit(one + ten))
            .when(d >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), (d - 5).cast("int"))))
            .when(d == 4, F.lit(one + five))
            .otherwise(F.repeat(F.lit(one), d.cast("int")))
        )
    low = 0 if zero is not None else 1
    spelled = F.concat(*digits)
    if zero is not None:
        spelled = F.when(n == 0, F.lit(zero)).otherwise(spelled)
    return F.when((n >= low) & (n <= 4999), spelled).otherwise(
        F.raise_error(F.concat(F.lit("numeral out of range: "), n.cast("string")))
    )


def motif_name(one_based_class: ColumnOrName) -> Column:
    """Display name of motif class 1..14: "0", "I", ... "XIII"."""
    return roman(col(one_based_class).cast("int") - 1)


def sigdigits(value: ColumnOrName, digits: int = 2) -> Column:
    """Round to a number of significant digits."""
    v = col(value).cast("double")
    power = F.floor(F.log10(F.abs(v))).cast("int") - F.lit(digits - 1)
    up, down = F.pow(F.lit(10.0), power), F.pow(F.lit(10.0), -power)
    scaled = F.when(power >= 0, F.rint(v / up) * up).otherwise(F.rint(v * down) / down)
    return F.when(v == 0, F.lit(0.0)).otherwise(scaled)


def signed_log10(value: ColumnOrName) -> Column:
    v = col(value)
    return F.signum(v) * F.log10(F.nullif(F.abs(v), F.lit(0.0)))


def minmax(value: ColumnOrName, low: ColumnOrName, high: ColumnOrName) -> Column:
    """Map [low, high] onto [0, 1]; NULL when the range is empty."""
    return (col(value) - col(low)) / F.nullif(col(high) - col(low), F.lit(0.0))


def significance(p: ColumnOrName, comparisons: ColumnOrName | int) -> Column:
    """Bonferroni star category of a p-value."""
    n = F.lit(comparisons) if isinstance(comparisons, int) else col(comparisons)
    name = n.cast("int").cast("string")
    x = col(p)
    return (
        F.when(x > F.lit(0.05) / n, F.lit("NS"))
        .when(x > F.lit(0.01) / n, F.concat(F.lit("* 0.05/"), name))
        .when(x > F.lit(0.001) / n, F.concat(F.lit("** 0.01/"), name))
        .when(x > F.lit(0.0001) / n, F.concat(F.lit("*** 0.001/"), name))
        .otherwise(F.concat(F.lit("**** 0.0001/"), name))
    )


def lag_condition(axis: str, first: ColumnOrName, second: ColumnOrName) -> Column:
    """How two lags of one sign compare in size, as TeX; empty for mixed signs or zero."""
    a, b = col(first), col(second)
    relation = (
        F.when(F.abs(a) < F.abs(b), F.lit("<")).when(F.abs(a) > F.abs(b), F.lit(">")).otherwise("=")
    )
    text = F.concat(F.lit(f"$\\abs{{{axis}_1}} "), relation, F.lit(f" \\abs{{{axis}_2}}$"))
    return F.when((F.signum(a) == F.signum(b)) & (a != 0), text).otherwise(F.lit(""))


def lag_conditions(n1: ColumnOrName, t1: ColumnOrName, n2: ColumnOrName, t2: ColumnOrName) -> Column:
    """Space and time conditions, stacked when both hold something."""
    parts = F.filter(F.array(lag_condition("n", n1, n2), lag_condition("t", t1, t2)), lambda p: p != "")
    stacked = F.concat(
        F.lit("\\adjustbox{raise=-0.25\\height}{\\shortstack{"), F.array_join(parts, "\\\\"), F.lit("}}")
    )
    return F.when(F.size(parts) > 1, stacked).otherwise(F.array_join(parts, ""))
