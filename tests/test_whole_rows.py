"""Boosted fits read all rows of their table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import boosting, features, models, trees
from noticeflow.plans import ml

CATS, NUMS = ["c", "d"], ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(400):
        c, x = rng.choice("abcd"), rng.randint(0, 30)
        out.append((f"k{i:03d}", float((x > 12) ^ (c == "b")), i % 3, c if i % 19 else None, rng.choice("pq"), float(x) if i % 11 else None, rng.random() * 10))
    return spark.createDataFrame(out, "_row_key string, label double, fold int, c string, d string, x double, y double").cache()


def seen_rows(monkeypatch) -> list[int]:
    """Lengths of the tables that fits are given; the number of rows that once bounded a fit is small."""
    monkeypatch.setattr(boosting, "ROWS", 50, raising=False)
    seen, grid, fit = [], boosting.grid_scores, boosting.fit_model
    monkeypatch.setattr(boosting, "grid_scores", lambda spark, tables, *a, **k: seen.extend(len(t.y) for t in tables.values()) or grid(spark, tables, *a, **k))
    monkeypatch.setattr(boosting, "fit_model", lambda spark, t, *a, **k: seen.append(len(t.y)) or fit(spark, t, *a, **k))
    return seen


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_boosted_searches_train_on_all_rows(rows, monkeypatch, task):
    seen = seen_rows(monkeypatch)
    grid = {"n_estimators": [2], "learning_rate": [0.3], "max_depth": [2], "subsample": [1.0]}
    model, _ = models.search(rows, CATS, NUMS, "gbt", task, grid=grid)
    assert seen == [400] * 4
    assert model.base == pytest.approx(rows.agg(F.avg("label")).first()[0] if task == "regression" else 0.0)  # balanced by their weights


def class_rows(rows):
    named = {c: F.col("c") if i % 2 else F.col("d") for i, c in enumerate(ml.CLASS_CATEGORICAL)} | {c: F.col("x") + i for i, c in enumerate(ml.CLASS_NUMERIC)}
    return rows.withColumns(named).withColumn("TARGET_MARKET_FAILURE", F.col("label").cast("int")).withColumn("_is_test", F.lit(0)).drop("label", *CATS, *NUMS)


def test_first_split_is_compared_with_all_rows(spark, rows, monkeypatch):
    seen = seen_rows(monkeypatch)
    monkeypatch.setattr(ml, "class_table", lambda *_: class_rows(rows))
    out = ml.boosted_first_split(spark, "").collect()
    assert seen == [400] and out and all(r.Not_Above_Root for r in out)
    # the root's gain is that of all rows, too
    pre = features.fit_preprocessor(rows, CATS, NUMS)
    ratio = models.class_ratio(rows)
    t = trees.coded_tables(rows, {None: pre}, {None: ratio}, "fold")[None]
    model = boosting.fit_model(spark, t, pre, "classification", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1, "subsample": 1.0})
    tree, p = model.trees[0], 1 / (1 + np.exp(-model.base))
    g, h = t.w * (p - t.y), t.w * p * (1 - p)
    code = t.codes[:, tree["column"][0]]
    left = code <= tree["bin"][0] if tree["column"][0] < 2 else code == tree["bin"][0]
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    assert boosting.root_gain(pre.coded(rows), model, ratio) == pytest.approx(part(left) + part(~left) - part(left | True))
