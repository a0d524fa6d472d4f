"""Consolidation operators."""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.flags import positive_flag
from noticeflow.functions.text import as_number

DISCONTINUED = "PROCUREMENT_DISCONTINUED"
UNSUCCESSFUL = "PROCUREMENT_UNSUCCESSFUL"
TENDER_COLS = ["NUMBER_TENDERS_SME", "NUMBER_TENDERS_OTHER_EU", "NUMBER_TENDERS_NON_EU"]


def consolidate_cascade_feature(df: DataFrame, target_col: str, cascade_cols) -> DataFrame:
    """first non-null value over the listed columns present; sources dropped."""
    cols = [c for c in cascade_cols if c in df.columns]
    if not cols:
        return df
    return df.withColumn(target_col, F.coalesce(*[F.col(c) for c in cols])) \
             .drop(*[c for c in cols if c != target_col])


def consolidate_logical_or_feature(df: DataFrame, target_col: str, source_cols) -> DataFrame:
    """OR of mixed-type flags (null counts as false) as 0/1; sources dropped."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [c for c in source_cols if c in types]
    if not cols:
        return df
    e = _fold(lambda a, b: a | b, [positive_flag(F.col(c), types[c]) for c in cols])
    return df.withColumn(target_col, e.cast("int")).drop(*[c for c in cols if c != target_col])


def consolidate_tenders_and_non_awards(df: DataFrame) -> DataFrame:
    """P4 + F6 + F7.

    Drop administrative cancellations, add the tender counts (null only if
    every part is null; unparsable text counts as null), and set 0 tenders
    for unsuccessful procedures with no count.
    """
    has_info = "INFO_ON_NON_AWARD" in df.columns
    if has_info:
        df = df.where(~F.col("INFO_ON_NON_AWARD").eqNullSafe(DISCONTINUED))
    parts = [c for c in TENDER_COLS if c in df.columns]
    if parts:
        nums = [as_number(F.col(c)) for c in parts]
        total = _fold(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in nums])
        df = df.withColumn("NUMBER_OF_TENDERS",
                           F.when(F.coalesce(*nums).isNotNull(), total)).drop(*parts)
    elif "NUMBER_OF_TENDERS" not in df.columns:
        df = df.withColumn("NUMBER_OF_TENDERS", F.lit(None).cast("double"))
    if has_info:
        n = F.col("NUMBER_OF_TENDERS")
        df = df.withColumn(
            "NUMBER_OF_TENDERS",
            F.when((F.col("INFO_ON_NON_AWARD") == UNSUCCESSFUL) & n.isNull(), F.lit(0.0))
             .otherwise(n.cast("double"))).drop("INFO_ON_NON_AWARD")
    return df
