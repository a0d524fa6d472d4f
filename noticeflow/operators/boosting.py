"""Second-order boosted trees (M9, M12) and the search over their grid.

The reference's boosted models take Newton steps: with gradient g and hessian h
of each row's loss, a split's gain is GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l) and
a leaf's value -G/(H+l) times the learning rate. Rows are drawn per tree
(``subsample``), one-hot slots per tree too (``colsample_bytree``). Numeric
columns are cut into at most ``BINS`` bins; a category is one slot of its column
("equal to v or not"), so a level's histograms need one sum per row and *source*
column instead of one per slot.

Spark's boosted trees run several jobs per level of every tree, so a grid of 72
settings x 3 folds x 500 trees is over half a million jobs. Here a *fit* is a
task, and one fit serves several settings: the model of the most rounds is
scored after 100, 300 and 500 of them, while it grows. The tasks of all folds
and settings run side by side.

Every fit trains on all rows of its part, and is scored on all rows of its fold:
the table is sent to the tasks as bin codes (``trees``), about one byte per column
and row, so memory grows with the rows but never leaves any out. Imputation,
category lists, cut points and class weights come from the whole training part
(of the fold), and predictions are made for every row of the table, by a narrow
pass with the model broadcast (its size is bounded by rounds and depth).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.features import Preprocessor
from noticeflow.operators.trees import Bins, Coded, Layout, Rule, _columns, fit_bins, fixed, grow_tree, leaves

#: The reference library's defaults.
LAMBDA, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6


@dataclass
class Table:
    """Rows as they are: numeric values (n x a), category codes (n x b), label, weight, fold."""
    num: np.ndarray
    cat: np.ndarray
    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray
    sizes: list[int]  # categories per category column


def _derivatives(task: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if task == "classification":
        p = 1.0 / (1.0 + np.exp(-margin))
        return w * (p - y), np.maximum(w * p * (1.0 - p), 1e-16)
    return w * (margin - y), w.copy()


def grow(t: Table | Coded, train: np.ndarray, task: str, setting: dict, rounds: int, seed: int = 42, watch=None) -> tuple[list[dict], Bins, float]:
    """(trees, bins, base margin) fitted on the rows ``train`` (mask) of ``t``.

    ``watch(round, margin)`` is called after each round with the margins of all
    rows. A tree is a dict of arrays: column, bin, left (0: a leaf), value.
    """
    if isinstance(t, Coded):
        bins, codes = t.bins, t.codes
    else:
        bins = fit_bins(t.num[train], t.sizes)
        codes = bins.codes(t.num, t.cat)
    x, y, w = Layout(codes, bins), t.y, t.w
    # slots to draw from: a number with all its bins, each category by itself
    slot = np.where(x.column < x.n_num, x.column, x.n_num + np.arange(x.width))
    drawable = np.unique(slot[x.usable])
    on = train.astype(float) * w
    mean = float((on * y).sum() / on.sum()) if on.sum() else 0.0
    base = mean if task == "regression" else float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))
    margin = np.full(len(y), base)
    trees: list[dict] = []
    rule, rate = Rule(LAMBDA, LEAST_HESSIAN, LEAST_GAIN), setting["learning_rate"]
    plain = task == "regression" and bool((w == 1).all())  # hessians are ones: they are counted
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        g, h = _derivatives(task, margin, y, w)
        inside = train if setting["subsample"] >= 1 else train & (rng.random(len(y)) < setting["subsample"])
        share = setting.get("colsample_bytree", 1.0)
        may = x.usable if share >= 1 else x.usable & np.isin(slot, rng.choice(drawable, max(1, int(drawable.size * share)), replace=False))
        tree, leaf = grow_tree(x, np.flatnonzero(inside), np.flatnonzero(~inside), fixed(g), None if plain else fixed(h), rule, may, setting["max_depth"])
        value = -rate * tree["g"] / (tree["h"] + LAMBDA)
        margin = margin + value.take(leaf)
        trees.append({"column": tree["column"].copy(), "bin": tree["bin"].copy(), "left": tree["left"].astype(np.int32), "value": value})
        if watch is not None:
            watch(r + 1, margin)
    return trees, bins, base


def predict(trees: list[dict], bins: Bins, base: float, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
    codes = bins.codes(num, cat)
    out = np.full(len(codes), base)
    for t in trees:
        out += t["value"][leaves(t, codes, len(bins.cuts))]
    return out


def root_gain(coded: DataFrame, model: "BoostedModel", positive: float) -> float:
    """Gain of a boosted classifier's first root over all rows of ``coded`` (0 if it does not split), in one aggregate."""
    tree, n_num = model.trees[0], len(model.bins.cuts)
    if tree["left"][0] == 0:
        return 0.0
    c, cut = int(tree["column"][0]), int(tree["bin"][0])
    value = F.when(F.isnan(F.col("_num")[c]), F.lit(float("-inf"))).otherwise(F.col("_num")[c]) if c < n_num else None
    left = value <= F.lit(float(model.bins.cuts[c][cut])) if c < n_num else F.col("_cat")[c - n_num] == cut
    p = 1.0 / (1.0 + float(np.exp(-model.base)))
    w = F.when(F.col("label") == 1, F.lit(float(positive))).otherwise(F.lit(1.0))
    g, h = w * (F.lit(p) - F.col("label")), w * F.lit(p * (1 - p))
    mine = lambda v, on: F.sum(F.when(on, v).otherwise(F.lit(0.0)))
    s = coded.agg(mine(g, left).alias("lg"), mine(h, left).alias("lh"), mine(g, ~left).alias("rg"), mine(h, ~left).alias("rh")).first()
    part = lambda a, b: a * a / (b + LAMBDA)
    return float(part(s.lg, s.lh) + part(s.rg, s.rh) - part(s.lg + s.rg, s.lh + s.rh))


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    scores = []
    for c in np.union1d(y, p):
        tp, both = float(((y == c) & (p == c)).sum()), float((y == c).sum() + (p == c).sum())
        scores.append(2 * tp / both if both else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def score(task: str, margin: np.ndarray, y: np.ndarray) -> float:
    """Macro-F1, or the mean absolute error."""
    return macro_f1(y, (margin > 0).astype(float)) if task == "classification" else float(np.abs(margin - y).mean()) if y.size else float("nan")


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All rows, or about ``rows`` of them by a hash of ``key``. For callers that ask for a draw; no fit takes one."""
    n = df.count()
    return df if n <= rows else df.where(F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 32) - 1)) < int(2**32 * rows / n))


def grid_scores(spark, tables: dict, task: str, settings: list[dict], seed: int = 42) -> list[tuple[dict, float]]:
    """Mean score over the folds of every setting; settings that differ in ``n_estimators`` alone are one fit.

    ``tables`` holds all rows per validation fold, coded by what was fitted on the other folds.
    """
    families: dict[tuple, list[int]] = {}
    for s in settings:
        families.setdefault(tuple(sorted((k, v) for k, v in s.items() if k != "n_estimators")), []).append(s["n_estimators"])
    fits = sorted(((k, f) for f in families for k in tables), key=lambda x: (-dict(x[1])["max_depth"], x[0]))
    sent = {k: spark.sparkContext.broadcast(t) for k, t in tables.items()}  # a task loads that of its fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                fold, family = fits[i]
                t, wanted = sent[fold].value, families[family]
                held = t.fold == fold

                def watch(r, margin):
                    if r in wanted:
                        out.append((i, r, score(task, margin[held], t.y[held])))
                grow(t, ~held, task, dict(family), max(wanted), seed, watch)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["fit", "rounds", "score"])

    # one task per fit
    found = spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, "fit long, rounds long, score double").collect()
    by: dict[tuple, list[float]] = {}
    for r in found:
        by.setdefault((fits[r.fit][1], r.rounds), []).append(r.score)
    key = lambda s: (tuple(sorted((k, v) for k, v in s.items() if k != "n_estimators")), s["n_estimators"])
    for b in sent.values():
        b.unpersist()
    return [(s, float(np.mean(by[key(s)]))) for s in settings]


@dataclass
class BoostedModel:
    """A fitted model; ``transform`` adds ``margin``, ``prediction`` and, for classes, ``score``."""
    task: str
    pre: Preprocessor
    trees: list[dict]
    bins: Bins
    base: float

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        sent = spark.sparkContext.broadcast((self.trees, self.bins, self.base))
        coded = self.pre.coded(df)
        kept = [f for f in coded.schema.fields if f.name not in ("_num", "_cat")]
        a, b = len(self.pre.num_cols), len(self.pre.cat_cols)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, bins, base = sent.value
            for x in batches:
                yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), pa.array(predict(trees, bins, base, *_columns(x, a, b)))], names=[*(f.name for f in kept), "margin"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        out = coded.mapInArrow(run, f"{schema}, margin double")
        if self.task == "regression":
            return out.withColumn("prediction", F.col("margin"))
        return out.withColumn("prediction", (F.col("margin") > 0).cast("double")).withColumn("score", 1.0 / (1.0 + F.exp(-F.col("margin"))))


def fit_model(spark, t: Table | Coded, pre: Preprocessor, task: str, setting: dict, seed: int = 42) -> BoostedModel:
    """One fit on all rows of the table, in a task."""
    import pickle
    sent = spark.sparkContext.broadcast(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pickle.dumps(grow(sent.value, np.ones(len(sent.value.y), bool), task, setting, setting["n_estimators"], seed)) for _ in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["model"])

    made = spark.range(0, 1, 1, 1).mapInArrow(run, "model binary").first()[0]
    return BoostedModel(task, pre, *pickle.loads(made))
