"""Column profiles (S4, S5): tables instead of HTML reports.

``profile_minimal`` unpivots every column and aggregates once per column
name. Distinct counts are HyperLogLog by default (bounded memory per
column); ``exact=True`` counts exactly (one shuffle of distinct values).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from noticeflow.operators import ordered


def sig(c: Column, digits: int = 10) -> Column:
    """Round a double to ``digits`` significant digits (engine-independent
    text form), so sums taken in different orders compare equal."""
    return F.when(c.isNotNull(),
                  F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double"))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def profile_minimal(df: DataFrame, exact: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Column, Type, Count, Nulls, Null_pct, Distinct, Zeros, Negatives,
    Min, Max, Mean, Std (sample) -- numeric statistics only for numeric columns.

    Long form: every row is unpivoted to (column, number, text) and one
    ``groupBy(column)`` computes all statistics, so the plan stays small
    however wide the table is (a wide one-row aggregate compiles for
    seconds). Distinct counts are taken on the text form."""
    cols = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    nul = F.lit(None).cast("double")
    arr = F.array(*[F.struct(
        F.lit(c).alias("Column"), F.lit(types[c].simpleString()).alias("Type"),
        F.lit(isinstance(types[c], NumericType)).alias("_isnum"),
        (F.col(c).cast("double") if isinstance(types[c], NumericType) else nul).alias("_v"),
        F.col(c).cast("string").alias("_t")) for c in cols])
    long = df.select(F.inline(arr))
    dist = F.count_distinct("_t") if exact else F.approx_count_distinct("_t")
    num = F.col("_v")
    a = long.groupBy("Column", "Type", "_isnum").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_t").alias("Count"), dist.alias("Distinct"),
        F.sum((num == 0).cast("int")).alias("Zeros"), F.sum((num < 0).cast("int")).alias("Negatives"),
        F.min(num).alias("Min"), F.max(num).alias("Max"), F.avg(num).alias("_mean"),
        F.stddev_samp(num).alias("_std"), F.count(num).alias("_nn"))
    isnum = F.col("_isnum")
    nulls = (F.col("_rows") - F.col("Count")).cast("bigint")
    pct = F.bround(F.try_divide(nulls.cast("double"), F.col("_rows").cast("double")) * 100.0, 2)
    return a.select(
        "Column", "Type", F.col("Count").cast("bigint").alias("Count"), nulls.alias("Nulls"),
        pct.alias("Null_pct"), F.col("Distinct").cast("bigint").alias("Distinct"),
        F.when(isnum, F.coalesce(F.col("Zeros"), F.lit(0))).cast("bigint").alias("Zeros"),
        F.when(isnum, F.coalesce(F.col("Negatives"), F.lit(0))).cast("bigint").alias("Negatives"),
        "Min", "Max", sig(F.col("_mean")).alias("Mean"), sig(F.col("_std")).alias("Std"))


def profile_spread(df: DataFrame, columns: list[str] | None = None, exact: bool = False, accuracy: int = 10_000, tracked: int = 10_000) -> DataFrame:
    """Quartiles of every numeric column and the most frequent value of every
    column: (Column, Q25, Median, Q75, Top, Top_Count).

    By default one pass of mergeable sketches: a quartile's rank is off by at most
    rows / ``accuracy``, and a value that more than rows / ``tracked`` rows have
    can't be missed as the top one. ``exact``: ranks by a distributed sort of distinct values, and
    counts per value (ties: smallest)."""
    cols = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if isinstance(types[c], NumericType)]
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "Column string")
    if exact:
        q = ordered.quantile_table(df.select(*[F.col(c).cast("double").alias(c) for c in numeric]), numeric, [0.25, 0.5, 0.75]) if numeric else None
        top = top_values(df, cols, 1).select("Column", F.col("Value").alias("Top"), F.col("Count").alias("Top_Count"))
        out = names.join(top, "Column", "left")
        if q is None:
            return out.select("Column", *[F.lit(None).cast("double").alias(x) for x in ("Q25", "Median", "Q75")], "Top", "Top_Count")
        q = q.select(F.col("_name").alias("Column"), *[F.col(ordered.qname(p)).alias(x) for p, x in ((0.25, "Q25"), (0.5, "Median"), (0.75, "Q75"))])
        return out.join(q, "Column", "left").select("Column", "Q25", "Median", "Q75", "Top", "Top_Count")
    nul = F.lit(None).cast("double")
    arr = F.array(*[F.struct(F.lit(c).alias("Column"), (F.col(c).cast("double") if c in numeric else nul).alias("_v"), F.col(c).cast("string").alias("_t")) for c in cols])
    a = df.select(F.inline(arr)).groupBy("Column").agg(F.percentile_approx("_v", [0.25, 0.5, 0.75], accuracy).alias("q"),
                                                       F.expr(f"approx_top_k(_t, 2, {tracked})").alias("t"))
    top = F.filter("t", lambda x: x["item"].isNotNull())
    a = names.join(a, "Column", "left")
    return a.select("Column", F.get("q", F.lit(0)).alias("Q25"), F.get("q", F.lit(1)).alias("Median"), F.get("q", F.lit(2)).alias("Q75"),
                    F.get(top, F.lit(0))["item"].alias("Top"), F.get(top, F.lit(0))["count"].alias("Top_Count"))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width histogram per numeric column (Column, Bin, Count)."""
    cols = columns or _numeric(df)
    arr = F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).cast("double").alias("v"))
                    for c in cols])
    long = df.select(F.inline(arr)).where(F.col("v").isNotNull())
    rng = long.groupBy("Column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # one row per column: a proven-size broadcast
    j = long.join(F.broadcast(rng), "Column")
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * bins),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return j.groupBy("Column", b.alias("Bin")).agg(F.count(F.lit(1)).alias("Count"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each text column (ties: value).

    Counts are aggregated per (column, value) first; the ranking window then
    runs per column over distinct values only (meant for categorical
    columns)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    arr = F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).cast("string").alias("Value"))
                    for c in cols])
    cnt = df.select(F.inline(arr)).where(F.col("Value").isNotNull()) \
            .groupBy("Column", "Value").agg(F.count(F.lit(1)).alias("Count"))
    w = Window.partitionBy("Column").orderBy(F.desc("Count"), "Value")
    return cnt.withColumn("Rank", F.row_number().over(w)).where(F.col("Rank") <= k)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column pair, one aggregation."""
    cols = columns or _numeric(df)
    pairs = list(combinations(cols, 2))
    a = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{i}")
                 for i, (x, y) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(x).alias("Column_A"), F.lit(y).alias("Column_B"),
                             sig(F.col(f"{i}")).alias("Pearson"))
                    for i, (x, y) in enumerate(pairs)])
    return a.select(F.inline(arr))
