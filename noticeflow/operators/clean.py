"""Cleaning of the golden table.

Fences are computed in one distributed quantile pass for all columns of a
step, kept as a one-row table and broadcast (a proven-size broadcast) into
the filter/cap expression: no value travels through the driver.
"""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered


def impute_domain_specific_missing_values(df: DataFrame) -> DataFrame:
    """F21 + F22: funds/recurrence null -> 0, criteria null -> ``MISSING``,
    ``TOP_TYPE`` null -> its mode (ties: smallest value; all null: unchanged)."""
    fills = {}
    for c in ("B_EU_FUNDS", "B_RECURRENT_PROCUREMENT"):
        if c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
    for c in ("CRIT_CODE", "AWARD_CRITERION"):
        if c in df.columns:
            fills[c] = F.coalesce(F.col(c), F.lit("MISSING"))
    if fills:
        df = df.withColumns(fills)
    if "TOP_TYPE" in df.columns:
        mode = df.agg(F.mode("TOP_TYPE", deterministic=True).alias("_top_mode"))
        df = df.crossJoin(F.broadcast(mode)) \
               .withColumn("TOP_TYPE", F.coalesce(F.col("TOP_TYPE"), F.col("_top_mode"))) \
               .drop("_top_mode")
    return df


def fences(df: DataFrame, columns: list[str], k_factor: float = 3.0,
           method: str = "log", quantile_method: str = "ranked") -> DataFrame:
    """A6 (``log``) / A7 (``standard``): upper fence per column, one row with a
    column ``<c>`` per input column (null when the column has no value).

    log: ``expm1(q3 + k (q3 - q1))`` of the ``log1p`` values (quantiles are
    taken in log space, not log of raw quantiles).
    """
    cols = [c for c in columns if c in df.columns]
    if method == "log":
        src = df.select(*[F.log1p(F.col(c).cast("double")).alias(c) for c in cols])
    elif method == "standard":
        src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    else:
        raise ValueError(f"unknown fence method {method!r}")
    qt = ordered.quantile_table(src, cols, [0.25, 0.75], method=quantile_method)
    q1, q3 = F.col(ordered.qname(0.25)), F.col(ordered.qname(0.75))
    fence = q3 + F.lit(k_factor) * (q3 - q1)
    if method == "log":
        fence = F.expm1(fence)
    # pivot the (<= #columns)-row table into one row; always exactly one row
    return qt.agg(*[F.max(F.when(F.col("_name") == c, fence)).alias(c) for c in cols]) \
        if cols else df.sparkSession.range(1).select()


def _with_fences(df: DataFrame, f: DataFrame, cols: list[str]) -> DataFrame:
    return df.crossJoin(F.broadcast(f.select(*[F.col(c).alias(f"_fence_{c}") for c in cols])))


def remove_extreme_outliers(df: DataFrame, columns: list[str], k_factor: float = 3.0,
                            method: str = "log", quantile_method: str = "ranked") -> DataFrame:
    """Drop rows above any column's fence (fences all from the same input;
    nulls kept)."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    j = _with_fences(df, fences(df, cols, k_factor, method, quantile_method), cols)
    keep = _fold(lambda a, b: a & b,
                 [F.coalesce(F.col(c) <= F.col(f"_fence_{c}"), F.lit(True)) |
                  F.col(c).isNull() for c in cols])
    return j.where(keep).drop(*[f"_fence_{c}" for c in cols])


def winsorize_features(df: DataFrame, columns: list[str], k_factor: float = 3.0,
                       method: str = "log", quantile_method: str = "ranked", watch=None) -> DataFrame:
    """Cap each column at its fence; nulls stay null, row count unchanged.
    ``watch(table, conditions)`` sees the rows with what will be capped."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    j = _with_fences(df, fences(df, cols, k_factor, method, quantile_method), cols)
    if watch is not None:
        j = watch(j, {f"capped_{c}": F.col(c) > F.col(f"_fence_{c}") for c in cols})
    capped = {c: F.when(F.col(c) > F.col(f"_fence_{c}"), F.col(f"_fence_{c}"))
                  .otherwise(F.col(c).cast("double")) for c in cols}
    return j.withColumns(capped).drop(*[f"_fence_{c}" for c in cols])


# The column groups of the cleaning stage.
CRITICAL_TARGETS = ["TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR", "NUMBER_OF_TENDERS"]
LOGICAL_CHECK_COLS = ["PREPARATION_DAYS", "DURATION", "TARGET_AWARD_VALUE_EUR",
                      "LOT_AWARD_VALUE_EUR", "ESTIMATED_VALUE_EUR", "NUMBER_OF_TENDERS"]
TARGET_LOG_COLS = ["TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR", "NUMBER_OF_TENDERS"]
INPUT_LOG_COLS = ["ESTIMATED_VALUE_EUR", "LOTS_NUMBER"]
INPUT_STANDARD_COLS = ["DURATION", "PREPARATION_DAYS", "NUTS_REGION_COUNT"]
