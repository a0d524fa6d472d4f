"""Row filters and column reduction."""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def xsd_ok(df: DataFrame) -> Column:
    """False where ``XSD_VERSION`` text contains ``8``; null versions pass."""
    if "XSD_VERSION" not in df.columns:
        return F.lit(True)
    return ~F.coalesce(F.col("XSD_VERSION").cast("string").contains("8"), F.lit(False))


def reduce_predicate(df: DataFrame) -> Column:
    """The combined row filter of ``filter_and_reduce`` (one pushed-down Filter)."""
    conds = [xsd_ok(df)]
    for c in ("CANCELLED", "OUT_OF_DIRECTIVES"):
        if c in df.columns:
            # null == 0 is null -> row dropped, like NaN == 0 in the reference
            conds.append(F.coalesce(F.col(c) == 0, F.lit(False)))
    return _fold(lambda a, b: a & b, conds)


def filter_and_reduce(df: DataFrame, columns_to_drop=()) -> DataFrame:
    """P2+P3 row filters, then P1 drop of the listed columns that exist."""
    return df.where(reduce_predicate(df)).drop(*_present(df, columns_to_drop))


def remove_logical_errors(df: DataFrame, columns, min_val: float = 0.0) -> DataFrame:
    """P5: keep rows where every listed column is >= min_val or null."""
    cols = _present(df, columns)
    if not cols:
        return df
    cond = _fold(lambda a, b: a & b,
                 [(F.col(c) >= min_val) | F.col(c).isNull() for c in cols])
    return df.where(cond)


def drop_missing_targets(df: DataFrame, target_columns) -> DataFrame:
    """Drop rows with a null in any target column."""
    return df.dropna(subset=list(target_columns))


# The reference's drop lists (shared / contract-notice only /
# award-notice only).
DROP_BOTH = [
    "ISO_COUNTRY_CODE_ALL", "EU_INST_CODE", "B_ACCELERATED", "B_NUMBER_COUNTRIES",
    "B_MULTIPLE_CAE", "TED_NOTICE_URL", "CAE_NAME", "CAE_ADDRESS", "CAE_TOWN",
    "CAE_POSTAL_CODE", "CAE_NATIONALID", "B_GPA", "GPA_COVERAGE", "CAE_GPA_ANNEX",
    "ISO_COUNTRY_CODE_GPA", "MAIN_CPV_CODE_GPA", "B_ELECTRONIC_AUCTION",
    "CRIT_CRITERIA", "CRIT_WEIGHTS", "CRIT_PRICE_WEIGHT", "CANCELLED", "CORRECTIONS",
    "B_DYN_PURCH_SYST", "XSD_VERSION", "ADDITIONAL_CPVS",
]
DROP_CFC = DROP_BOTH + [
    "ENV_OPERATORS", "ENV_MIN_OPERATORS", "ENV_MAX_OPERATORS", "B_LANGUAGE_ANY_EC",
    "ADMIN_LANGUAGES_TENDER", "ADMIN_OTHER_LANGUAGES_TENDER", "LOTS_SUBMISSION",
    "FUTURE_CAN_ID_ESTIMATED", "B_VARIANTS", "B_OPTIONS", "B_RENEWALS",
    "B_FRA_SINGLE_OPERATOR", "FRA_NUMBER_OPERATORS", "FRA_NUMBER_MAX_OPERATORS",
    "CONTRACT_START", "CONTRACT_COMPLETION",
]
DROP_CAN = DROP_BOTH + [
    "WIN_NAME", "WIN_ADDRESS", "WIN_TOWN", "WIN_POSTAL_CODE", "WIN_NATIONALID", "TITLE",
    "CONTRACT_NUMBER", "OUT_OF_DIRECTIVES", "INFO_UNPUBLISHED", "B_SUBCONTRACTED",
    "B_AWARDED_TO_A_GROUP", "NUMBER_OFFERS_ELECTR", "ID_AWARD", "ID_LOT_AWARED",
]
