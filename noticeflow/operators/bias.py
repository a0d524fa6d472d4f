"""Bias analysis of matched vs orphan rows.

Each function takes a *tagged* frame (one boolean column saying whether the
row matched, see ``match.tag_by_notice`` / ``match.tag_by_lot``) so that
matched and orphan statistics come from one scan and one aggregation, never
from two joins and an outer re-alignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered


def rows_of(names: list[str], rows: list[tuple]) -> "F.Column":
    """``inline`` input: an array of structs with the same field names."""
    return F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, r)]) for r in rows]))


def _pct(num, den):
    return F.try_divide(num.cast("double"), den.cast("double")) * 100.0


def compare_distributions(tagged: DataFrame, feature: str, normalize: bool = False,
                          flag: str = "_matched") -> DataFrame:
    """A1: per value of ``feature``: matched vs orphan counts and orphan rate %,
    or (``normalize``) the two shares % and their difference in points.

    Nulls are excluded from counts and from the share base; rounding is
    half-even to 2 places; sorted by value.
    """
    if feature not in tagged.columns:
        raise ValueError(f"feature {feature!r} not in frame")
    m = F.sum(F.when(F.col(flag), 1).otherwise(0)).cast("bigint")
    o = F.sum(F.when(F.col(flag), 0).otherwise(1)).cast("bigint")
    g = tagged.where(F.col(feature).isNotNull()).groupBy(feature) \
              .agg(m.alias("Matched"), o.alias("Orphans"))
    if not normalize:
        rate = _pct(F.col("Orphans"), F.col("Matched") + F.col("Orphans"))
        return g.withColumn("Orphan_Rate_pct", F.bround(rate, 2)).orderBy(feature)
    # 1-row totals, cross-joined: a proven-size broadcast.
    tot = g.agg(F.sum("Matched").alias("_tm"), F.sum("Orphans").alias("_to"))
    s = g.crossJoin(F.broadcast(tot))
    ms, os_ = (F.coalesce(_pct(F.col("Matched"), F.col("_tm")), F.lit(0.0)),
               F.coalesce(_pct(F.col("Orphans"), F.col("_to")), F.lit(0.0)))
    return s.select(feature, F.bround(ms, 2).alias("Matched_pct"),
                    F.bround(os_, 2).alias("Orphans_pct"),
                    F.bround(os_ - ms, 2).alias("Difference_pts")).orderBy(feature)


def compare_metrics(tagged: DataFrame, metrics: list[str], flag: str = "_matched",
                    method: str = "ranked") -> DataFrame:
    """A2: median and mean of each metric on the matched and orphan side."""
    mets = [m for m in metrics if m in tagged.columns]
    side = F.when(F.col(flag), "Matched").otherwise("Orphan").alias("_side")
    t = tagged.select(side, *[F.col(m).cast("double").alias(m) for m in mets])
    med = ordered.quantile_table(t, mets, [0.5], ["_side"], method) \
        .withColumnRenamed(ordered.qname(0.5), "_med")
    means = ordered.unpivot_values(t, mets, ["_side"]).groupBy("_side", "_name") \
        .agg(F.avg("_v").alias("_mean"))
    both = means.join(med, ["_side", "_name"], "left")

    def pick(side, c):
        return F.bround(F.max(F.when(F.col("_side") == side, F.col(c))), 2)
    return both.groupBy(F.col("_name").alias("Metric")).agg(
        pick("Matched", "_med").alias("Matched_Median"),
        pick("Orphan", "_med").alias("Orphan_Median"),
        pick("Matched", "_mean").alias("Matched_Mean"),
        pick("Orphan", "_mean").alias("Orphan_Mean"))


def analyze_non_award_rates(can_orphans: DataFrame) -> DataFrame:
    """A3: total orphans, non-awarded among them, rate % (0 when empty)."""
    if "NOT_AWARDED" not in can_orphans.columns:
        raise ValueError("NOT_AWARDED not in frame")
    a = can_orphans.agg(F.count(F.lit(1)).alias("t"),
                        F.coalesce(F.sum("NOT_AWARDED"), F.lit(0)).cast("bigint").alias("n"))
    rate = F.coalesce(F.bround(_pct(F.col("n"), F.col("t")), 2), F.lit(0.0))
    return a.select(rows_of(["Metric", "Value"], [
        (F.lit("Total CAN Orphans"), F.col("t").cast("double")),
        (F.lit("Non-Awarded Orphans"), F.col("n").cast("double")),
        (F.lit("Non-Award Rate (%)"), rate)]))


def analyze_cross_dataset_orphans(df_cfc: DataFrame, df_can: DataFrame,
                                  cfc_matched: DataFrame | None = None,
                                  can_matched: DataFrame | None = None) -> DataFrame:
    """Notices whose lot orphans on one side meet notices of the other.

    With two frames this keeps the reference's computed definition (both
    rows intersect the same two id sets, so they are equal). Pass
    ``cfc_matched``/``can_matched`` for the documented meaning: CFC lot
    orphans in matched CAN notices, and vice versa.
    """
    def ids(df, col):
        return df.select(F.col(col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    a_cfc, a_can = ids(df_cfc, "FUTURE_CAN_ID"), ids(df_can, "ID_NOTICE_CAN")
    b_can = ids(can_matched, "ID_NOTICE_CAN") if can_matched is not None else a_can
    b_cfc = ids(cfc_matched, "FUTURE_CAN_ID") if cfc_matched is not None else a_cfc
    n1 = a_cfc.intersect(b_can).agg(F.count(F.lit(1)).alias("n"))
    n2 = a_can.intersect(b_cfc).agg(F.count(F.lit(1)).alias("n"))
    return (n1.select(F.lit("CFC Lot Orphan in Matched CAN").alias("Direction"),
                      F.col("n").alias("Affected_Notices"))
              .unionByName(n2.select(F.lit("CAN Lot Orphan in Matched CFC").alias("Direction"),
                                     F.col("n").alias("Affected_Notices"))))


def analyze_partial_notice_success(tagged_cfc: DataFrame, flag: str = "_matched") -> DataFrame:
    """A4: among notices with >= 1 orphan lot, how many lost all lots (total
    failure) vs some (partial success), and the shares %.

    One two-level aggregation over the tagged CFC rows (the reference's
    union + two value_counts + outer align). Null notice ids are not counted.
    """
    per = tagged_cfc.where(F.col("FUTURE_CAN_ID").isNotNull()).groupBy("FUTURE_CAN_ID").agg(
        F.count(F.lit(1)).alias("_tot"),
        F.sum(F.when(F.col(flag), 0).otherwise(1)).alias("_orph"))
    f = per.where(F.col("_orph") > 0).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col("_tot") == F.col("_orph"), 1).otherwise(0)).cast("bigint").alias("_tf"),
        F.sum(F.when(F.col("_tot") > F.col("_orph"), 1).otherwise(0)).cast("bigint").alias("_ps"))
    share = lambda c: F.coalesce(F.bround(_pct(F.col(c), F.col("_n")), 2), F.lit(0.0))
    return f.select(rows_of(["Scenario", "Notice_Count", "Share_pct"], [
        (F.lit("Total Failure (0% Lots Awarded)"),
         F.coalesce(F.col("_tf"), F.lit(0)).cast("bigint"), share("_tf")),
        (F.lit("Partial Success (>0% Lots Awarded)"),
         F.coalesce(F.col("_ps"), F.lit(0)).cast("bigint"), share("_ps"))]))
