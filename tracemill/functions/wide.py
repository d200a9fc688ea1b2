"""Wide signals: rows that hold all channels of a step, as an array in the order of the channels.

They have no `channel` column and one row where a long signal has one per channel, so steps are
shuffled and sorted instead of samples. The array is as long in every row of a recording and never
NULL; a missing sample is a NULL in it. Operators that take them say so; their long results
number the channels from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_wide(signal: DataFrame, value: str = "value") -> bool:
    return isinstance(signal.schema[value].dataType, T.ArrayType)


def by_channel(steps: Column, width: Column) -> Column:
    """From an array of steps, each an array of channels, to an array of `width` channels of steps."""
    places = F.slice(F.sequence(F.lit(0), width.cast("int")), F.lit(1), width.cast("int"))
    return F.transform(places, lambda c: F.transform(steps, lambda s: F.get(s, c)))
