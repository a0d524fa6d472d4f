"""CPV code reduction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import as_number


def cpv_prefix(c: Column, digits: int = 2) -> Column:
    """Top ``digits`` of a CPV code, zero-padded to 8 digits first.

    Numeric text (``'45200000.0'``, ``'3000000'``) becomes its integral value,
    padded and cut (``'45'``, ``'03'``). Text that is not an integral
    non-negative number is kept as it is (the reference keeps its original
    text there too).
    """
    num = as_number(c)
    integral = num.isNotNull() & (num == F.floor(num)) & (num >= 0) & (num < 1e18)
    code = num.cast("decimal(38,0)").cast("string")
    return F.when(integral, F.substring(F.lpad(code, 8, "0"), 1, digits)) \
            .otherwise(c.cast("string"))
