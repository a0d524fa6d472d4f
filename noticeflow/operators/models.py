"""Supervised models (M7-M13) and their importances.

Class balancing uses a weight column; cross-validation uses a fold column
built from the group hash (``split.folds``), so the lots of a notice never
straddle a training and a validation fold. Model selection maximises macro-F1
for classes and minimises MAE for regression. Linear models and trees are Spark
ML's; the boosted models are in ``boosting``, forests in ``forest``.
"""

from __future__ import annotations

import itertools
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import boosting, forest
from noticeflow.operators.features import Preprocessor, fit_preprocessor
from noticeflow.operators.trees import coded_tables
from noticeflow.session import delete_folder, discard, ensure_checkpoint_dir, materialize


def macro_f1(counts: list[tuple[int, int, int]]) -> float:
    """Unweighted mean of the classes' F1, from counts per (actual, predicted)."""
    f1s = []
    for c in sorted({y for y, _, _ in counts} | {p for _, p, _ in counts}):
        tp = sum(n for y, p, n in counts if y == c and p == c)
        both = sum(n for y, _, n in counts if y == c) + sum(n for _, p, n in counts if p == c)
        f1s.append(2 * tp / both if both else 0.0)
    return sum(f1s) / len(f1s) if f1s else 0.0


def balanced_weights(df: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """``class_weight='balanced'``: n / (#classes * n_class), via a broadcast
    of the per-class counts (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)


def class_ratio(df: DataFrame) -> float:
    """``scale_pos_weight``: #neg / #pos (1 if there are none)."""
    r = df.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return r[0] / r[1] if r[1] else 1.0


# Hyper-parameter grids of the reference.
CLASSIFIER_GRIDS = {
    "logreg": {"C": [0.01, 0.1, 1.0, 10.0]},
    "dt": {"max_depth": [5, 10, 15, 20], "min_samples_leaf": [10, 50, 100]},
    "gbt": {"n_estimators": [100, 300, 500], "learning_rate": [0.05, 0.1], "max_depth": [5, 7, 9],
            "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
}
REGRESSOR_GRIDS = {
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "rf": {"n_estimators": [100, 200], "max_depth": [10, 20]},
    "gbt": {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "max_depth": [5, 7],
            "subsample": [0.8, 1.0]},
}
#: Hyper-parameters whose smaller values a fit with the greatest one serves as well.
NESTED = {"dt": ["max_depth"]}


def settings_of(grid: dict) -> list[dict]:
    return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]


def _depth(depth: int) -> int:
    if depth > 30:
        raise ValueError(f"trees are at most 30 levels deep here, not {depth}")
    return depth


def _classifier(name: str, s: dict, wsum: float | None = None):
    if name == "logreg":
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="_w",
                                  regParam=1.0 / (s["C"] * wsum), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000)
    if name == "dt":
        return DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="_w",
                                      maxDepth=_depth(s["max_depth"]),
                                      minInstancesPerNode=s["min_samples_leaf"], leafCol="leaf", seed=42,
                                      cacheNodeIds=True)
    raise ValueError(f"unknown classifier {name!r}")


def _regressor(name: str, s: dict):
    if name == "lasso":
        return LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0,
                                regParam=s["alpha"], standardization=False, maxIter=2000)
    raise ValueError(f"unknown model {name!r}")


@dataclass
class Fitted:
    """A model with the preprocessor that was fitted on the same rows."""
    pre: Preprocessor
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.pre.transform(df))


def leaf_values(model, spark, depths: list[int]) -> list[np.ndarray]:
    """Per tree of a fitted tree model: (depth x leaf) predictions of the tree
    cut at each depth, leaves counted from the left as ``leafCol`` does.

    A greedy tree's splits don't depend on its greatest depth, so cutting it is
    fitting a shallower one. The nodes come from the model's saved form; like
    the model itself they fit the driver."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = nodes.select("treeID", "id", "leftChild", "rightChild", "prediction").toPandas().sort_values(["treeID", "id"])
    delete_folder(spark, path)
    out = []
    for _, t in rows.groupby("treeID"):
        ids, left, right, value = (t[c].to_numpy() for c in ("id", "leftChild", "rightChild", "prediction"))
        at = {int(i): k for k, i in enumerate(ids)}
        depth, made = np.zeros(len(ids), int), np.tile(value, (len(depths), 1))
        for k in range(len(ids)):          # parents come before their children
            for child in (left[k], right[k]):
                if child >= 0:
                    c = at[int(child)]
                    depth[c] = depth[k] + 1
                    cut = [j for j, d in enumerate(depths) if depth[c] > d]
                    made[cut, c] = made[cut, k]
        out.append(made[:, left < 0])
    return out


def _nested_predictions(model, x: DataFrame, name: str, family: list[dict]) -> DataFrame:
    """(label, preds) with one prediction per setting of the family."""
    if name not in NESTED:
        return model.transform(x).select("label", F.array("prediction").alias("preds"))
    depths = sorted({s["max_depth"] for s in family})
    values = leaf_values(model, x.sparkSession, depths)
    size = max(v.shape[1] for v in values)
    stacked = np.zeros((len(depths), len(values), size))
    for k, v in enumerate(values):
        stacked[:, k, :v.shape[1]] = v
    plan = [(depths.index(s["max_depth"]), s.get("n_estimators", 1)) for s in family]
    sent = x.sparkSession.sparkContext.broadcast(stacked)

    def run(batches):
        table = sent.value
        for b in batches:
            leaf = np.array(b.column("leaves").to_pylist(), float).reshape(b.num_rows, -1).astype(int)
            of = [table[d][np.arange(n), leaf[:, :n]].mean(1) for d, n in plan]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.stack(of, 1).tolist(), pa.list_(pa.float64()))], names=["label", "preds"])

    leaves = F.array("leaf") if name == "dt" else vector_to_array("leaf")
    return model.transform(x).select("label", leaves.alias("leaves")).mapInArrow(run, "label double, preds array<double>")


def _scores(preds: DataFrame, task: str, n: int) -> list[float]:
    """Macro-F1 or mean absolute error of each prediction in ``preds``."""
    each = preds.select("label", F.posexplode("preds").alias("i", "p"))
    if task == "regression":
        rows = each.groupBy("i").agg(F.avg(F.abs(F.col("label") - F.col("p"))).alias("v")).collect()
        found = {r.i: r.v for r in rows}
        return [float(found.get(i, float("nan"))) for i in range(n)]
    rows = each.groupBy("i", F.col("label").cast("int").alias("y"), F.col("p").cast("int").alias("p")).count().collect()
    return [macro_f1([(r.y, r.p, r["count"]) for r in rows if r.i == i]) for i in range(n)]


def _families(name: str, settings: list[dict]) -> list[tuple[dict, list[dict]]]:
    """(setting to fit, settings that the fit serves): one fit per value of what is not nested."""
    nested = NESTED.get(name, [])
    groups: dict[tuple, list[dict]] = {}
    for s in settings:
        groups.setdefault(tuple((k, v) for k, v in s.items() if k not in nested), []).append(s)
    return [(dict(fixed) | {k: max(s[k] for s in family) for k in nested}, family) for fixed, family in groups.items()]


def _weighted(train: DataFrame, task: str) -> DataFrame:
    return balanced_weights(train, "label") if task == "classification" else train


def _kept(train: DataFrame, name: str) -> DataFrame:
    """``train`` cached and filled, so that fits in several threads read finished blocks
    and none of them runs the plan behind it.

    A forest draws its rows by partition and place. Files of one size come in any order,
    so its rows are dealt by key and sorted first: equal rows then give equal forests."""
    if name == "rf":
        train = train.repartition(max(1, train.rdd.getNumPartitions()), "_row_key").sortWithinPartitions("_row_key", "label")
    train = train.cache()
    train.count()
    return train


def _estimator(name: str, task: str, s: dict, train: DataFrame):
    if task == "regression":
        return _regressor(name, s)
    return _classifier(name, s, train.agg(F.sum("_w")).first()[0] if name == "logreg" else None)


def search(df: DataFrame, cats: list[str], nums: list[str], name: str, task: str, fold_col: str = "fold",
           parallelism: int = 4, grid: dict | None = None):
    """Grid search over ``fold_col``, refit of the best setting on all rows.

    ``df`` holds the raw columns, ``label`` and ``_row_key``. Whatever is fitted is
    fitted on a fold's training part only: medians, scales, modes, category lists,
    class weights and the penalty that depends on their sum. Settings that one fit
    serves are fitted once and scored in one pass over the held-out part.
    Returns (model over raw rows, [(setting, mean score)])."""
    grids = CLASSIFIER_GRIDS if task == "classification" else REGRESSOR_GRIDS
    if name not in grids:
        raise ValueError(f"unknown model {name!r}")
    settings = settings_of(grid or grids[name])
    df = materialize(df.select("_row_key", "label", fold_col, *cats, *nums))
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    pick = max if task == "classification" else min

    def prepared(train: DataFrame, keep: DataFrame) -> tuple[Preprocessor, DataFrame]:
        pre = fit_preprocessor(train, cats, nums)
        return pre, materialize(pre.transform(keep).select("_row_key", "label", fold_col, "features"))

    if name in ("gbt", "rf"):
        spark = df.sparkSession
        positive = {k: class_ratio(df if k is None else df.where(F.col(fold_col) != k)) if task == "classification" else None for k in (None, *folds)}
        pre_of = {k: fit_preprocessor(df if k is None else df.where(F.col(fold_col) != k), cats, nums) for k in (None, *folds)}
        tables = coded_tables(df, pre_of, positive, fold_col)
        parts = {k: tables[k] for k in folds}
        scores = boosting.grid_scores(spark, parts, task, settings) if name == "gbt" else forest.grid_scores(spark, parts, settings)
        best = pick(scores, key=lambda t: t[1])[0]
        return boosting.fit_model(spark, tables[None], pre_of[None], task, best) if name == "gbt" else forest.fit_forest(spark, tables[None], pre_of[None], best), scores

    sums: dict[int, list[float]] = {i: [] for i in range(len(settings))}
    for k in folds:
        _, x = prepared(df.where(F.col(fold_col) != k), df)
        train, held = _kept(_weighted(x.where(F.col(fold_col) != k), task), name), x.where(F.col(fold_col) == k)

        def one(job, train=train, held=held):
            fit, family = job
            model = _estimator(name, task, fit, train).fit(train)
            return family, _scores(_nested_predictions(model, held, name, family), task, len(family))

        with ThreadPoolExecutor(parallelism) as pool:
            for family, values in pool.map(one, _families(name, settings)):
                for s, v in zip(family, values):
                    sums[settings.index(s)].append(v)
        train.unpersist()
        discard(x)
    scores = [(s, sum(sums[i]) / len(sums[i])) for i, s in enumerate(settings)]
    best = pick(scores, key=lambda t: t[1])[0]
    pre, x = prepared(df, df)
    train = _kept(_weighted(x, task), name)
    model = _estimator(name, task, best, train).fit(train)
    train.unpersist()
    return Fitted(pre, model), scores


def predictions(model, test: DataFrame, keep: list[str]) -> DataFrame:
    """Test predictions with the positive-class probability as ``score``
    (classification) or the raw prediction (regression)."""
    p = model.transform(test)
    cols = [*keep, F.col("label"), F.col("prediction")]
    if "score" in p.columns:
        cols.append("score")
    elif "probability" in p.columns:
        cols.append(vector_to_array("probability")[1].alias("score"))
    return p.select(*cols)


def importances(model, names: list[str], sources: list[str]) -> list[tuple[str, str, float]]:
    """(slot, source column, importance) from tree importances or the
    absolute linear coefficients; slot -> source comes from the encoder."""
    model = getattr(model, "model", model)
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in model.coefficients.toArray().tolist()]
    return list(zip(names, sources, vals))
