"""Master merge and the golden ML table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered
from noticeflow.operators.match import CAN_NOTICE, CFC_NOTICE, lot_key_exprs
from noticeflow.session import materialize

JOIN_KEYS = ["JOIN_NOTICE", "JOIN_LOT"]


def perform_master_merge(df_cfc: DataFrame, df_can: DataFrame) -> DataFrame:
    """Inner equi-join on the normalised (notice, lot) pair, many-to-many.

    Columns present on both sides get ``_CFC``/``_CAN`` suffixes, the others
    keep their names (pandas ``merge(suffixes=...)``). Rows with a null key
    never match; Catalyst filters them before the shuffle. Lot-less rows of
    one notice all share ``NO_LOT_DEFINED`` and multiply: AQE's skew-join
    handling splits such hot partitions (see ``join_fanout`` to audit it).
    """
    a = df_cfc.withColumns(dict(zip(JOIN_KEYS, lot_key_exprs(df_cfc, CFC_NOTICE))))
    b = df_can.withColumns(dict(zip(JOIN_KEYS, lot_key_exprs(df_can, CAN_NOTICE))))
    common = (set(a.columns) & set(b.columns)) - set(JOIN_KEYS)
    a = a.select(*[F.col(c).alias(c + "_CFC" if c in common else c) for c in a.columns])
    b = b.select(*[F.col(c).alias(c + "_CAN" if c in common else c) for c in b.columns])
    return a.join(b, on=JOIN_KEYS, how="inner")


def join_fanout(df_cfc: DataFrame, df_can: DataFrame, top: int = 20) -> DataFrame:
    """Audit: output rows per join key (left count x right count), largest
    first; a top-k report of the keys that dominate the merge."""
    def counts(df, col, n):
        return df.select(*[e.alias(k) for k, e in zip(JOIN_KEYS, lot_key_exprs(df, col))]) \
                 .dropna().groupBy(*JOIN_KEYS).agg(F.count(F.lit(1)).alias(n))
    j = counts(df_cfc, CFC_NOTICE, "n_cfc").join(counts(df_can, CAN_NOTICE, "n_can"), JOIN_KEYS)
    return j.withColumn("fanout", F.col("n_cfc") * F.col("n_can")) \
            .orderBy(F.desc("fanout"), *JOIN_KEYS).limit(top)


def compare_feature_consistency(master: DataFrame, features: list[str]) -> DataFrame:
    """A5: per feature, rows where the CFC and CAN values agree (null = null),
    the total, and the rate % (half-even, 2 places); highest rate first.
    One aggregation for all features."""
    feats = [f for f in features if f"{f}_CFC" in master.columns and f"{f}_CAN" in master.columns]
    if not feats:
        return master.sparkSession.createDataFrame(
            [], "Feature string, Match_Count bigint, Total_Count bigint, Consistency_Rate_pct double")
    aggs = [F.count(F.lit(1)).alias("_total")] + [
        F.sum(F.col(f"{f}_CFC").eqNullSafe(F.col(f"{f}_CAN")).cast("int")).cast("bigint").alias(f)
        for f in feats]
    a = master.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("Feature"), F.col(f).alias("Match_Count"))
                     for f in feats])
    out = a.select(F.inline(rows), F.col("_total").alias("Total_Count"))
    rate = F.bround(F.try_divide(F.col("Match_Count").cast("double"),
                                 F.col("Total_Count").cast("double")) * 100.0, 2)
    return out.select("Feature", "Match_Count", "Total_Count",
                      rate.alias("Consistency_Rate_pct")) \
              .orderBy(F.desc("Consistency_Rate_pct"), "Feature")


# The columns kept for the golden table.
META_COLS = ["JOIN_NOTICE", "JOIN_LOT"]
TARGETS_CAN = ["NUMBER_OF_TENDERS", "TOTAL_VALUE_EUR_CAN", "LOT_AWARD_VALUE_EUR"]
FEATURES_CFC = ["YEAR_CFC", "ID_TYPE_CFC", "ISO_COUNTRY_CODE_CFC", "CAE_TYPE_CFC",
                "MAIN_ACTIVITY_CFC", "CPV_CFC", "LOTS_NUMBER_CFC", "B_EU_FUNDS_CFC",
                "DURATION", "TOP_TYPE_CFC", "B_RECURRENT_PROCUREMENT", "TOTAL_VALUE_EUR_CFC",
                "IS_FRAMEWORK_CFC", "COOPERATIVE_PURCHASING_CFC", "CRIT_CODE_CFC",
                "TYPE_OF_CONTRACT_CFC", "NUTS_REGION_COUNT_CFC", "NUTS_LEVEL_CFC",
                "PREPARATION_DAYS"]
RENAMES = {"TOTAL_VALUE_EUR_CAN": "TARGET_AWARD_VALUE_EUR",
           "TOTAL_VALUE_EUR_CFC": "ESTIMATED_VALUE_EUR",
           "JOIN_NOTICE": "ID_NOTICE", "JOIN_LOT": "ID_LOT"}
# Row-order columns carried through the merge (merged order = cfc, then can).
POS_COLS = {"_row_pos_CFC": "_row_pos", "_row_pos_CAN": "_row_pos2"}


def _ml_name(c: str) -> str:
    return RENAMES.get(c, c.replace("_CFC", "") if c in FEATURES_CFC else c)


def select_ml_columns(master: DataFrame) -> DataFrame:
    """P10 (projection part): the 24 golden columns present, renamed, with the
    merged row order kept as ``_row_pos`` / ``_row_pos2``."""
    keep = [c for c in META_COLS + TARGETS_CAN + FEATURES_CFC if c in master.columns]
    pos = [F.col(c).alias(n) for c, n in POS_COLS.items() if c in master.columns]
    return master.select(*pos, *[F.col(c).alias(_ml_name(c)) for c in keep])


def id_codes(ml: DataFrame, col: str, code: str) -> DataFrame:
    """(value, code) for ``col``, codes by first appearance in merged order."""
    first = ml.select(col, F.struct("_row_pos", "_row_pos2").alias("_ord"))
    return ordered.dense_codes(first, col, "_ord", code)


def prepare_final_ml_dataset(master: DataFrame) -> DataFrame:
    """P10 + A11: golden table with integer notice and lot codes.

    The projected merge is materialised once; both code tables and the final
    join read it instead of recomputing the join chain."""
    ml = materialize(select_ml_columns(master))
    for col in ("ID_NOTICE", "ID_LOT"):
        if col in ml.columns:
            codes = id_codes(ml, col, "_code")
            ml = ml.join(codes, on=col, how="left").withColumn(col, F.col("_code")).drop("_code")
    return ml


# The features compared between CFC and CAN after the merge.
CONSISTENCY_FEATURES = ["YEAR", "ID_TYPE", "ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY",
                        "CPV", "LOTS_NUMBER", "B_EU_FUNDS", "TOP_TYPE", "TOTAL_VALUE_EUR",
                        "IS_FRAMEWORK", "COOPERATIVE_PURCHASING", "TYPE_OF_CONTRACT",
                        "CRIT_CODE", "NUTS_REGION_COUNT", "NUTS_LEVEL"]
