"""Flag expressions over the three boolean-like encodings of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from noticeflow.functions.text import upper_strip


def yes_no_binary(c: Column) -> Column:
    """``Y`` -> 1, ``N`` -> 0 after strip/upper; anything else null."""
    u = upper_strip(c.cast("string"))
    return F.when(u == "Y", 1).when(u == "N", 0).cast("int")


# The text tokens counted as a positive flag (exact match).
POSITIVE_TEXT = ("Y", "y", "1")


def positive_flag(c: Column, dtype: DataType) -> Column:
    """True when a flag of the given type is positive; null counts as False.

    Text: exactly ``Y``, ``y`` or ``1`` (``'1.0'`` and ``'True'`` are not).
    Numbers: equal to 1. Booleans: true.
    """
    if isinstance(dtype, BooleanType):
        e = c
    elif isinstance(dtype, NumericType):
        e = c == 1
    elif isinstance(dtype, StringType):
        e = c.isin(*POSITIVE_TEXT)
    else:
        e = c.cast("string").isin(*POSITIVE_TEXT)
    return F.coalesce(e, F.lit(False))
