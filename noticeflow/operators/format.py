"""Formatting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.flags import yes_no_binary
from noticeflow.functions.text import null_tokens


def convert_yes_no_to_binary(df: DataFrame, columns) -> DataFrame:
    """Y/N flags to 1/0 (null otherwise), for the listed columns present."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: yes_no_binary(F.col(c)) for c in cols}) if cols else df


def preprocess_framework_estimation(df: DataFrame) -> DataFrame:
    """``FRA_ESTIMATED`` text of >= 2 characters -> ``B_FRA_ESTIMATED_FLAG``."""
    if "FRA_ESTIMATED" not in df.columns:
        return df
    flag = (F.length(F.coalesce(F.col("FRA_ESTIMATED").cast("string"), F.lit(""))) >= 2)
    return df.withColumn("B_FRA_ESTIMATED_FLAG", flag.cast("int")).drop("FRA_ESTIMATED")


def standardize_categorical_features(df: DataFrame, columns) -> DataFrame:
    """strip + upper; the tokens NAN / NONE become null."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: null_tokens(F.col(c).cast("string")) for c in cols}) \
        if cols else df


# Categorical columns standardised by the preparation stage.
CATEGORICAL_COLS = ["ISO_COUNTRY_CODE", "ID_TYPE", "CAE_TYPE", "TOP_TYPE",
                    "MAIN_ACTIVITY", "TYPE_OF_CONTRACT", "CRIT_CODE"]
