"""Seeded sampling, group-safe splits and folds.

Membership comes from a portable hash: the first 32 bits of
``md5(key || '|' || seed)``. It depends on the key only (not on partitioning
or row order), needs no shuffle, and gives the same bucket in Spark and in
DuckDB, so the oracle can check membership exactly. All rows of a group
share a hash, so a group never straddles two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1000


SAMPLE_BUCKETS = 1 << 14


def hash32(key: Column, seed: int = 42) -> Column:
    """Unsigned 32-bit hash of ``key`` (cast to text) and ``seed``."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def bucket(key: Column, seed: int = 42, buckets: int = BUCKETS) -> Column:
    return (hash32(key, seed) % buckets).cast("int")


def hash_sample(df: DataFrame, n: int, key: str = "_row_pos", seed: int = 42) -> DataFrame:
    """L1: exactly ``min(n, rows)`` rows without replacement, seeded.

    The ``n`` rows with the smallest hash (ties by key). Counts per hash
    bucket (``SAMPLE_BUCKETS`` numbers on the driver at any size) tell which
    buckets are kept whole; only the rows of the bucket that holds the cut are
    ranked, about ``rows / SAMPLE_BUCKETS`` of them.
    """
    tagged = df.withColumn("_h", hash32(F.col(key), seed))
    part = F.shiftright("_h", 32 - SAMPLE_BUCKETS.bit_length() + 1)
    counts = sorted((r.b, r.n) for r in tagged.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    seen = 0
    for b, k in counts:
        if seen + k > n:
            edge = tagged.where(part == b).orderBy("_h", key).limit(n - seen)
            return tagged.where(part < b).unionByName(edge).drop("_h")
        seen += k
    return df


def group_split(df: DataFrame, group_col: str, test_size: float = 0.2, seed: int = 42,
                col: str = "_is_test") -> DataFrame:
    """L2: flag a ``test_size`` share of *groups* as test (``col`` = 1)."""
    cut = int(round(test_size * BUCKETS))
    return df.withColumn(col, (bucket(F.col(group_col), seed) < cut).cast("int"))


def row_split(df: DataFrame, key: str = "_row_pos", test_size: float = 0.2, seed: int = 42,
              col: str = "_is_test") -> DataFrame:
    """L3: flag a ``test_size`` share of rows as test."""
    return group_split(df, key, test_size, seed, col)


def folds(df: DataFrame, key: str, k: int = 3, seed: int = 42, col: str = "fold") -> DataFrame:
    """L4 (group key) / L5 (row key): fold number 0..k-1 for cross-validation
    (``CrossValidator(foldCol=...)``); groups stay whole."""
    return df.withColumn(col, (hash32(F.col(key), seed + 1) % k).cast("int"))


def group_split_frames(df: DataFrame, target: str, group: str, drop: list[str] | tuple = (),
                       test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """L2 + P12: (train, test) rows with their features, ``target`` and ``group``;
    leakage columns in ``drop`` and ``ID_LOT`` are left out, absent ones ignored.
    All rows of a group are on one side."""
    gone = [c for c in (*drop, "ID_LOT") if c in df.columns and c not in (target, group)]
    t = group_split(df.drop(*gone), group, test_size, seed, "_is_test")
    return tuple(t.where(F.col("_is_test") == side).drop("_is_test") for side in (0, 1))
