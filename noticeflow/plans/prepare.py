"""Stage 01: row filters, formatting, consolidation, extraction.

A single lazy chain of narrow transformations per table: Catalyst collapses
it into one Project/Filter over the scan (one whole-stage-codegen span), so
the whole stage streams through once with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from noticeflow.operators.consolidate import (consolidate_cascade_feature,
                                              consolidate_logical_or_feature,
                                              consolidate_tenders_and_non_awards)
from noticeflow.operators.extract import (calculate_days, extract_nuts_features,
                                          extract_winner_features, reduce_cpv_cardinality)
from noticeflow.operators.format import (CATEGORICAL_COLS, convert_yes_no_to_binary,
                                         preprocess_framework_estimation,
                                         standardize_categorical_features)
from noticeflow.operators.reduce import DROP_CAN, DROP_CFC, filter_and_reduce

# Cascade and OR sources of the consolidation step.
TOTAL_VALUE_SOURCES = ["VALUE_EURO_FIN_2", "VALUE_EURO_FIN_1", "VALUE_EURO"]
AWARD_VALUE_SOURCES = ["AWARD_VALUE_EURO_FIN_1", "AWARD_VALUE_EURO", "AWARD_EST_VALUE_EURO"]
FRAMEWORK_SOURCES = ["B_FRA_AGREEMENT", "B_FRA_ESTIMATED_FLAG", "B_FRA_CONTRACT"]
COOPERATIVE_SOURCES = ["B_ON_BEHALF", "B_INVOLVES_JOINT_PROCUREMENT",
                       "B_AWARDED_BY_CENTRAL_BODY"]


def reduce_stage(df: DataFrame, side: str) -> DataFrame:
    return filter_and_reduce(df, DROP_CFC if side == "cfc" else DROP_CAN)


def format_stage(df: DataFrame, side: str) -> DataFrame:
    df = convert_yes_no_to_binary(df, ["B_EU_FUNDS", "B_RECURRENT_PROCUREMENT"])
    df = preprocess_framework_estimation(df)
    df = consolidate_cascade_feature(df, "TOTAL_VALUE_EUR", TOTAL_VALUE_SOURCES)
    if side == "can":
        df = consolidate_cascade_feature(df, "LOT_AWARD_VALUE_EUR", AWARD_VALUE_SOURCES)
    df = consolidate_logical_or_feature(df, "IS_FRAMEWORK", FRAMEWORK_SOURCES)
    df = consolidate_logical_or_feature(df, "COOPERATIVE_PURCHASING", COOPERATIVE_SOURCES)
    if side == "can":
        df = consolidate_tenders_and_non_awards(df)
    return df


def extract_stage(df: DataFrame, side: str) -> DataFrame:
    df = reduce_cpv_cardinality(df, digits=2)
    df = extract_nuts_features(df)
    if side == "cfc":
        df = calculate_days(df, "DT_DISPATCH", "DT_APPLICATIONS", "PREPARATION_DAYS")
    else:
        df = calculate_days(df, "DT_DISPATCH", "DT_AWARD", "DAYS_TO_AWARD")
        df = extract_winner_features(df)
    return standardize_categorical_features(df, CATEGORICAL_COLS)


def prepare(df: DataFrame, side: str) -> DataFrame:
    """The whole of stage 01 for one table (``side`` is ``'cfc'`` or ``'can'``)."""
    if side not in ("cfc", "can"):
        raise ValueError(side)
    return extract_stage(format_stage(reduce_stage(df, side), side), side)
