"""``DD/MM/YY`` date parsing with Python's two-digit-year pivot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ddmmyy(c: Column) -> Column:
    """Parse ``DD/MM/YY`` text to a date; unparsable text gives null.

    Spark's ``yy`` always maps to 2000-2099, while the reference's parser
    maps 69-99 to 19xx and 00-68 to 20xx, so shift years >= 2069 back by a
    century. ``d/M/yy`` accepts one- and two-digit days and months and
    rejects impossible dates such as 31/02.
    """
    d = F.to_date(F.try_to_timestamp(c, F.lit("d/M/yy")))
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (both ``DD/MM/YY`` text)."""
    return F.datediff(parse_ddmmyy(end), parse_ddmmyy(start))
