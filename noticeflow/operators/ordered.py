"""Ordered operators without a single-task global window.

``Window.orderBy(...)`` with no partitioning moves every row to one task.
Everything order-based here (global row index, dense ids by first
appearance, exact quantiles, running sums for precision/recall curves) goes
through one pattern instead:

1. range-partition + sort on the order key (the sort is distributed);
2. tag each row with its partition id and its position inside the partition
   (``monotonically_increasing_id`` minus the partition's base), then
   write as Parquet, so that the sampled range bounds can never be recomputed
   differently and later steps read single columns;
3. count rows per (partition, group): a table of at most
   ``#partitions x #groups`` rows; exclusive offsets over it;
4. join the offsets back: global index = offset + local position.

Group columns must be low-cardinality (flags, column names, cluster ids);
for many small groups a ``Window.partitionBy(group)`` is the right tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.session import materialize

_PID, _LOC, _FIRST, _N, _OFF = "_o_pid", "_o_loc", "_o_first", "_o_n", "_o_off"


def _num_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_index(df: DataFrame, order_cols: list, group_cols: list | tuple = (),
                 idx: str = "_idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``idx``: 0-based position of each row in (group, order) sort order,
    restarting at 0 for every group. Ties get distinct consecutive positions."""
    groups = list(group_cols)
    keys = [F.col(g) for g in groups] + [c if isinstance(c, Column) else F.col(c)
                                         for c in order_cols]
    n = _num_parts(df, num_partitions)
    pid = F.spark_partition_id().cast("bigint")
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn(_PID, pid)
           .withColumn(_LOC, F.monotonically_increasing_id() - F.shiftleft(pid, 33)))
    s = materialize(s)
    per = s.groupBy(_PID, *groups).agg(F.count(F.lit(1)).alias(_N), F.min(_LOC).alias(_FIRST))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy()) \
        .orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn(_OFF, F.coalesce(F.sum(_N).over(w), F.lit(0)))
    out = s.join(offs.select(_PID, *groups, _OFF, _FIRST), on=[_PID, *groups])
    return (out.withColumn(idx, F.col(_OFF) + F.col(_LOC) - F.col(_FIRST))
               .drop(_PID, _LOC, _FIRST, _OFF))


def dense_codes(df: DataFrame, key: str, order_col: str, code: str) -> DataFrame:
    """Codes 0..k-1 for the distinct non-null values of ``key``, numbered by
    their first appearance in ``order_col`` order (``pd.factorize``).

    Returns a two-column table (key, code). Partial aggregation of ``min``
    runs before the shuffle; only the distinct keys are sorted.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order_col).alias("_first"))
    return global_index(firsts, ["_first"], idx=code).select(key, code)


def running_sums(df: DataFrame, order_cols: list, sum_cols: list[str],
                 suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in global ``order_cols`` order."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in order_cols]
    n = _num_parts(df, num_partitions)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
           .withColumn(_PID, F.spark_partition_id().cast("bigint")))
    s = materialize(s)
    per = s.groupBy(_PID).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w0 = Window.partitionBy().orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(_PID, *[F.coalesce(F.sum(f"_t_{c}").over(w0), F.lit(0)).alias(f"_b_{c}")
                              for c in sum_cols])
    wl = Window.partitionBy(_PID).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(offs, on=_PID)
    for c in sum_cols:
        out = out.withColumn(c + suffix, F.col(f"_b_{c}") + F.sum(c).over(wl))
    return out.drop(_PID, *[f"_b_{c}" for c in sum_cols])


def unpivot_values(df: DataFrame, cols: list[str], group_cols: list | tuple = (),
                   name: str = "_name", value: str = "_v") -> DataFrame:
    """Long (group..., name, value) table of the non-null values of ``cols``."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                    for c in cols])
    return (df.select(*group_cols, F.inline(arr))
              .where(F.col(value).isNotNull()))


def quantiles(df: DataFrame, cols: list[str], probs: list[float],
              group_cols: list | tuple = (), method: str = "ranked") -> DataFrame:
    """Linear-interpolated quantiles of each column (nulls skipped).

    Returns the long table (group..., ``_name``, ``_p``, ``_q``).

    * ``ranked`` (default): counts per distinct value, one distributed sort of
      these; the two neighbouring ranks ``floor/ceil((n-1)p)`` are looked up
      and interpolated as ``lo + frac*(hi-lo)``. No single task holds a column
      or all rows of one value.
    * ``exact``: Spark's ``percentile`` (a value->count map per group, fine
      for bounded distinct counts).
    * ``approx``: ``percentile_approx`` (sketch, bounded memory).
    * ``inverted_cdf``: as ``ranked``, but the least value that at least a share p
      of the rows does not exceed (no interpolation).
    """
    groups = list(group_cols)
    if method in ("exact", "approx"):
        long = unpivot_values(df, cols, groups)
        pa = F.array(*[F.lit(float(p)) for p in probs])
        agg = (F.percentile(long["_v"], pa) if method == "exact"
               else F.percentile_approx(long["_v"], pa, 100000))
        res = long.groupBy(*groups, "_name").agg(agg.alias("_qs"))
        return res.select(*groups, "_name",
                          F.inline(F.arrays_zip(pa.alias("_p"), F.col("_qs").alias("_q"))))
    if method not in ("ranked", "inverted_cdf"):
        raise ValueError(f"unknown quantile method {method!r}")
    long = unpivot_values(df, cols, groups)
    keys = groups + ["_name"]
    # equal values are one row with a count, so a value that most rows have is
    # no hot key; a row then covers the ranks _from <= r < _to
    distinct = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n = _num_parts(df, None)
    s = materialize(distinct.repartitionByRange(n, *keys, "_v").withColumn(_PID, F.spark_partition_id().cast("bigint")))
    per = s.groupBy(_PID, *keys).agg(F.sum("_c").alias(_N))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn(_OFF, F.coalesce(F.sum(_N).over(before), F.lit(0))) \
              .withColumn("_cnt", F.sum(_N).over(Window.partitionBy(*keys))).drop(_N)
    run = Window.partitionBy(_PID, *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = s.withColumn("_run", F.sum("_c").over(run)).join(offs, on=[_PID, *keys]) \
            .withColumn("_to", F.col(_OFF) + F.col("_run")).withColumn("_from", F.col("_to") - F.col("_c"))
    if method == "ranked":
        rank = lambda p: (F.col("_cnt") - 1).cast("double") * F.lit(float(p))
    else:
        rank = lambda p: F.greatest(F.ceil(F.col("_cnt").cast("double") * F.lit(float(p)) - 1).cast("double"), F.lit(0.0))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    aggs = [F.max("_cnt").alias("_cnt")]
    for i, p in enumerate(probs):
        aggs += [at(F.floor(rank(p))).alias(f"_lo{i}"), at(F.ceil(rank(p))).alias(f"_hi{i}")]
    found = rows.groupBy(*keys).agg(*aggs)
    between = lambda i, p: F.col(f"_lo{i}") + (rank(p) - F.floor(rank(p))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
    each = [F.struct(F.lit(float(p)).alias("_p"), (between(i, p) if method == "ranked" else F.col(f"_lo{i}")).alias("_q"))
            for i, p in enumerate(probs)]
    return found.select(*keys, F.inline(F.array(*each)))


def quantile_table(df: DataFrame, cols: list[str], probs: list[float],
                   group_cols: list | tuple = (), method: str = "ranked") -> DataFrame:
    """Wide form: one row per (group..., column) with ``q_<p>`` columns.

    Columns without any non-null value (in a group) are absent from the
    result; callers left-join when they need them."""
    long = quantiles(df, cols, probs, group_cols, method)
    groups = list(group_cols)
    aggs = [F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(qname(p)) for p in probs]
    return long.groupBy(*groups, "_name").agg(*aggs)


def qname(p: float) -> str:
    return "q_" + (f"{p:.4f}".rstrip("0").rstrip(".").replace(".", "_"))
