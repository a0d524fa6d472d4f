"""Feature preprocessing fitted on Spark (M1, M2).

Numeric: median imputation -> log1p -> standardisation with the population
standard deviation (zero variance -> scale 1). The fitted statistics are a
one-row DataFrame, broadcast into the expressions; Spark's ``Imputer``
(approximate median) and ``StandardScaler`` (sample std) are not used.

Categorical: most-frequent imputation (ties: smallest value), one-hot over
the sorted training categories with the first one dropped; unseen values
encode as all zeros (``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder``
whose dropped last slot is the unseen one, then a ``VectorSlicer`` removing
each column's first category).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered
from noticeflow.session import materialize


@dataclass
class NumericScaler:
    cols: list[str]
    stats: DataFrame  # one row: med_<c>, mean_<c>, std_<c>

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        j = df.crossJoin(F.broadcast(self.stats))
        out = {}
        for c in self.cols:
            lg = F.log1p(F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
            sd = F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0))
            out[c + suffix] = (lg - F.col(f"_mean_{c}")) / sd
        return j.withColumns(out).drop(*self.stats.columns)


def fit_numeric_scaler(train: DataFrame, cols: list[str]) -> NumericScaler:
    """M1: fit medians, then mean / population std of log1p of the imputed
    values (two aggregations, no collect)."""
    qt = ordered.quantile_table(train.select(*[F.col(c).cast("double").alias(c) for c in cols]),
                                cols, [0.5])
    med = qt.agg(*[F.max(F.when(F.col("_name") == c, F.col(ordered.qname(0.5)))).alias(f"_med_{c}")
                   for c in cols])
    j = train.select(*cols).crossJoin(F.broadcast(med))
    lg = {c: F.log1p(F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"))) for c in cols}
    mom = j.agg(*[F.avg(lg[c]).alias(f"_mean_{c}") for c in cols],
                *[F.stddev_pop(lg[c]).alias(f"_std_{c}") for c in cols])
    return NumericScaler(cols, med.crossJoin(mom))


@dataclass
class CategoricalEncoder:
    cols: list[str]
    modes: DataFrame                      # one row: _mode_<c>
    indexer: object                       # StringIndexerModel
    labels: dict[str, list[str]] = field(default_factory=dict)

    def fill(self, df: DataFrame) -> DataFrame:
        j = df.crossJoin(F.broadcast(self.modes))
        return j.withColumns({c: F.coalesce(F.col(c).cast("string"), F.col(f"_mode_{c}"))
                              for c in self.cols}).drop(*self.modes.columns)

    def slot_names(self) -> list[str]:
        """Names of the kept one-hot slots, in vector order (first dropped)."""
        return [f"{c}_{v}" for c in self.cols for v in self.labels[c][1:]]

    def slot_sources(self) -> list[str]:
        return [c for c in self.cols for _ in self.labels[c][1:]]


def fit_categorical_encoder(train: DataFrame, cols: list[str]) -> CategoricalEncoder:
    """M2: modes (ties: smallest value) and sorted category lists."""
    counts = _long(train, cols).where(F.col("Category").isNotNull()).groupBy("Column", "Category").agg(F.count(F.lit(1)).alias("_n"))
    best = lambda c: F.min(F.when(F.col("Column") == c, F.struct((-F.col("_n")).alias("n"), F.col("Category").alias("c"))))["c"]
    modes = materialize(counts.agg(*[best(c).alias(f"_mode_{c}") for c in cols]))
    enc = CategoricalEncoder(cols, modes, None)
    filled = enc.fill(train.select(*cols))
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(filled)
    enc.indexer = idx
    enc.labels = dict(zip(cols, [list(x) for x in idx.labelsArray]))
    return enc


@dataclass
class CategoryTable:
    """One-hot encoding for category sets of any size: all of it are tables.

    ``codes`` (Column, Category, Code) numbers each column's sorted categories
    from 0, ``modes`` has one row per column. No category becomes a literal of a
    plan or an element of a list on the driver."""
    cols: list[str]
    codes: DataFrame
    modes: DataFrame

    def slots(self, df: DataFrame, key: str) -> DataFrame:
        """(key, Column, Category, Code) of the active slots: nulls take the mode,
        a column's first category and unseen ones have no slot.

        The codes are joined by (Column, Category); adaptive execution broadcasts a
        small table and splits the rows of a hot category otherwise."""
        filled = F.coalesce(F.col("Category"), F.col("_mode"))
        long = _long(df, self.cols, key).join(F.broadcast(self.modes), "Column", "left")  # one row per column
        long = long.select(key, "Column", filled.alias("Category"))
        return long.join(self.codes.where(F.col("Code") > 0), ["Column", "Category"])

    def vectors(self, df: DataFrame, key: str) -> DataFrame:
        """(key, indices) of every row: the sorted places of its ones in the vector of all slots,
        columns in their order. Rows without an active slot have an empty list."""
        sizes = {r["Column"]: r["n"] for r in self.codes.groupBy("Column").agg(F.max("Code").alias("n")).collect()}  # one number per column
        base, at = F.lit(0), 0
        for c in self.cols:
            base = F.when(F.col("Column") == c, F.lit(at)).otherwise(base)
            at += sizes.get(c, 0)
        ones = self.slots(df, key).groupBy(key).agg(F.sort_array(F.collect_list(base + F.col("Code") - 1)).alias("indices"))  # at most one per column
        return df.select(key).join(ones, key, "left").select(key, F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"))


def _long(df: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).cast("string").alias("Category")) for c in cols])))


def fit_category_table(train: DataFrame, cols: list[str]) -> CategoryTable:
    """M2 without a bound on the categories: counts per (column, category) give the
    modes (ties: smallest value) and, sorted in a distributed way, the codes."""
    counts = materialize(_long(train, cols).where(F.col("Category").isNotNull()).groupBy("Column", "Category").agg(F.count(F.lit(1)).alias("_n")))
    modes = counts.groupBy("Column").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("Category").alias("c"))).alias("m")).select("Column", F.col("m.c").alias("_mode"))
    codes = ordered.global_index(counts.select("Column", "Category"), ["Category"], ["Column"], idx="Code")
    return CategoryTable(cols, codes.select("Column", "Category", "Code"), materialize(modes))


@dataclass
class Preprocessor:
    """M1 + M2 as one fitted object producing a ``features`` vector."""
    numeric: NumericScaler | None
    categorical: CategoricalEncoder | None
    num_cols: list[str]
    cat_cols: list[str]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        parts: list[str] = []
        if self.numeric is not None:
            df = self.numeric.transform(df)
            parts += [c + "_scaled" for c in self.num_cols]
        keep: list[int] = []
        pos = len(parts)
        if self.categorical is not None:
            enc = self.categorical
            df = enc.indexer.transform(enc.fill(df))
            ohe_cols = [f"{c}_ohe" for c in self.cat_cols]
            df = OneHotEncoder(inputCols=[f"{c}_idx" for c in self.cat_cols], outputCols=ohe_cols,
                               dropLast=True).fit(df).transform(df)
            parts += ohe_cols
        keep = list(range(pos))
        if self.categorical is not None:
            off = pos
            for c in self.cat_cols:
                n = len(self.categorical.labels[c])  # slots: n categories (unseen dropped)
                keep += list(range(off + 1, off + n))
                off += n
        df = VectorAssembler(inputCols=parts, outputCol="_raw_features",
                             handleInvalid="keep").transform(df)
        df = VectorSlicer(inputCol="_raw_features", outputCol=out, indices=keep).transform(df)
        drop = ["_raw_features"] + [c + "_scaled" for c in self.num_cols] + \
               [f"{c}_idx" for c in self.cat_cols] + [f"{c}_ohe" for c in self.cat_cols]
        return df.drop(*drop)

    def coded(self, df: DataFrame) -> DataFrame:
        """``_num``: the scaled numbers (null: NaN); ``_cat``: places in the
        sorted category lists (an unseen one: the length of its list)."""
        if self.numeric is not None:
            df = self.numeric.transform(df)
        if self.categorical is not None:
            df = self.categorical.indexer.transform(self.categorical.fill(df))
        num = [F.coalesce(F.col(c + "_scaled"), F.lit(float("nan"))) for c in self.num_cols]
        cat = [F.col(f"{c}_idx").cast("int") for c in self.cat_cols]
        df = df.withColumn("_num", F.array(*num).cast("array<double>")).withColumn("_cat", F.array(*cat).cast("array<int>"))
        return df.drop(*[c + "_scaled" for c in self.num_cols], *[f"{c}_idx" for c in self.cat_cols])

    def feature_names(self) -> list[str]:
        cats = self.categorical.slot_names() if self.categorical is not None else []
        return list(self.num_cols) + cats

    def feature_sources(self) -> list[str]:
        cats = self.categorical.slot_sources() if self.categorical is not None else []
        return list(self.num_cols) + cats


def fit_preprocessor(train: DataFrame, cat_cols: list[str], num_cols: list[str]) -> Preprocessor:
    return Preprocessor(fit_numeric_scaler(train, num_cols) if num_cols else None,
                        fit_categorical_encoder(train, cat_cols) if cat_cols else None,
                        list(num_cols), list(cat_cols))
