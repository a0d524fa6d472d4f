"""Extraction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.codes import cpv_prefix
from noticeflow.functions.dates import days_between
from noticeflow.functions.lists import (nuts_level, nuts_region_count, sme_winner_count,
                                        winner_count, winner_country_count)


def calculate_days(df: DataFrame, start_field: str, end_field: str, new_field: str) -> DataFrame:
    """F8: whole days between two ``DD/MM/YY`` columns; skipped if one is absent."""
    if start_field not in df.columns or end_field not in df.columns:
        return df
    return df.withColumn(new_field, days_between(F.col(start_field), F.col(end_field))) \
             .drop(start_field, end_field)


def reduce_cpv_cardinality(df: DataFrame, digits: int = 2) -> DataFrame:
    """keep the top ``digits`` of the CPV code."""
    if "CPV" not in df.columns:
        return df
    return df.withColumn("CPV", cpv_prefix(F.col("CPV"), digits))


def extract_nuts_features(df: DataFrame, target_col: str = "TAL_LOCATION_NUTS") -> DataFrame:
    """F10 + F11: region count and mean code level; source dropped."""
    if target_col not in df.columns:
        return df
    c = F.col(target_col).cast("string")
    return df.withColumns({"NUTS_REGION_COUNT": nuts_region_count(c),
                           "NUTS_LEVEL": nuts_level(c)}).drop(target_col)


def extract_winner_features(df: DataFrame) -> DataFrame:
    """Winner count, distinct winner countries, SME winners."""
    if "WIN_COUNTRY_CODE" in df.columns:
        w = F.col("WIN_COUNTRY_CODE").cast("string")
        df = df.withColumns({"NUMBER_OF_WINNERS": winner_count(w),
                             "NUMBER_WINNER_COUNTRIES": winner_country_count(w)}) \
               .drop("WIN_COUNTRY_CODE")
    if "B_CONTRACTOR_SME" in df.columns:
        df = df.withColumn("NUMBER_SME_WINNERS", sme_winner_count(F.col("B_CONTRACTOR_SME"))) \
               .drop("B_CONTRACTOR_SME")
    return df
