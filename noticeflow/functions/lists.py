"""Delimited-list features, expressed with higher-order functions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import strip_ws


def nuts_region_count(c: Column) -> Column:
    """Number of regions: commas + 1; empty or null text gives 0."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, ",", -1))).cast("int")


def nuts_level(c: Column) -> Column:
    """Mean stripped length of codes of length >= 2, minus 2; null if none."""
    lens = F.transform(F.split(F.coalesce(c, F.lit("")), ",", -1),
                       lambda x: F.length(strip_ws(x)).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"))
    # one pass over the codes: (sum, count) of the lengths >= 2
    return F.aggregate(
        lens, zero,
        lambda acc, n: F.when(n >= 2, F.struct((acc["s"] + n).alias("s"),
                                               (acc["n"] + 1).alias("n"))).otherwise(acc),
        lambda acc: F.when(acc["n"] > 0, acc["s"].cast("double") / acc["n"].cast("double") - 2.0))


def winner_count(c: Column) -> Column:
    """Number of winners: non-overlapping ``---`` + 1; empty/null gives 0."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s == "", 0).otherwise(F.regexp_count(s, F.lit("---")) + 1).cast("int")


def winner_country_count(c: Column) -> Column:
    """Distinct non-empty stripped country codes of a ``---`` list."""
    codes = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "---", -1),
                                 lambda x: strip_ws(x)),
                     lambda x: x != "")
    return F.size(F.array_distinct(codes)).cast("int")


def sme_winner_count(c: Column) -> Column:
    """Count of ``Y`` in the upper-cased SME list; null gives 0."""
    return F.regexp_count(F.upper(F.coalesce(c.cast("string"), F.lit(""))),
                          F.lit("Y")).cast("int")
