"""Tables behind the reference's charts and dictionaries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import as_number
from noticeflow.operators import ordered


def encoding_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(Feature, Code, Value): dense codes per feature in sorted value
    order -- numeric order when every value of the feature is a number."""
    arr = F.array(*[F.struct(F.lit(c).alias("Feature"), F.col(c).cast("string").alias("Value"))
                    for c in columns])
    vals = df.select(F.inline(arr)).where(F.col("Value").isNotNull()).distinct()
    num = as_number(F.col("Value"))
    flags = vals.groupBy("Feature").agg(F.bool_and(num.isNotNull()).alias("_allnum"))
    v = vals.join(F.broadcast(flags), "Feature") \
            .withColumn("_num", F.when(F.col("_allnum"), num))
    out = ordered.global_index(v, ["_num", "Value"], ["Feature"], idx="Code")
    return out.select("Feature", F.col("Code").cast("bigint"), "Value")


def category_share(df: DataFrame, cluster_col: str, cat_col: str, top_n: int = 10) -> DataFrame:
    """% of each cluster's rows per category, over the ``top_n`` most
    frequent categories (ties: value), long form (cluster, category, pct)."""
    top = df.where(F.col(cat_col).isNotNull()).groupBy(cat_col) \
            .agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), cat_col).limit(top_n)
    f = df.join(F.broadcast(top.select(cat_col)), cat_col, "left_semi")  # <= top_n rows
    g = f.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col, cat_col) \
         .agg(F.count(F.lit(1)).alias("_c"))
    tot = g.groupBy(cluster_col).agg(F.sum("_c").alias("_t"))
    return g.join(tot, cluster_col).select(
        F.col(cluster_col).alias("Cluster"), F.col(cat_col).alias("Category"),
        F.bround(F.col("_c").cast("double") / F.col("_t").cast("double") * 100.0, 6).alias("Pct"))


def cluster_boxplot(df: DataFrame, cluster_col: str, features: list[str],
                    whisker: float = 1.5) -> DataFrame:
    """Per cluster x feature: q1, median, q3, whisker ends (furthest value
    within ``whisker`` IQR of the box) and the count of values outside."""
    qt = ordered.quantile_table(df, features, [0.25, 0.5, 0.75], [cluster_col])
    q1, q2, q3 = (F.col(ordered.qname(p)) for p in (0.25, 0.5, 0.75))
    box = qt.select(F.col(cluster_col), F.col("_name"), q1.alias("Q1"), q2.alias("Median"),
                    q3.alias("Q3"))
    long = ordered.unpivot_values(df, features, [cluster_col])
    # #clusters x #features rows: adaptive execution broadcasts them if they are few
    j = long.join(box, [cluster_col, "_name"])
    iqr = F.col("Q3") - F.col("Q1")
    lo_f, hi_f = F.col("Q1") - whisker * iqr, F.col("Q3") + whisker * iqr
    inside = (F.col("_v") >= lo_f) & (F.col("_v") <= hi_f)
    return j.groupBy(F.col(cluster_col).alias("Cluster"), F.col("_name").alias("Feature"),
                     "Q1", "Median", "Q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("Whisker_Low"),
        F.max(F.when(inside, F.col("_v"))).alias("Whisker_High"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("Outliers"))
