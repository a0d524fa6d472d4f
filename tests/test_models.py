"""Searches: one fit per family of settings, everything fitted inside the fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import boosting, models

CATS, NUMS = ["c", "d"], ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    out = []
    for i in range(360):
        fold = i % 3
        c = rng.choice("abc") if fold else rng.choice("abz")  # z is in fold 0 only
        x, y = rng.randint(0, 40), rng.random() * 10
        label = float((x > 20) ^ (c == "b") if rng.random() < 0.85 else rng.random() < 0.5)
        if fold == 1 and rng.random() < 0.5:
            label = 1.0  # class shares differ between folds
        out.append((f"r{i:03d}", label, fold, c if rng.random() > 0.05 else None, rng.choice("pq"), float(x) if rng.random() > 0.1 else None, y))
    return spark.createDataFrame(out, "_row_key string, label double, fold int, c string, d string, x double, y double").cache()


def test_cut_tree_scores_as_single_fits(rows):
    grid = {"max_depth": [1, 2, 4, 7], "min_samples_leaf": [1, 10]}
    _, whole = models.search(rows, CATS, NUMS, "dt", "classification", grid=grid)
    assert [s for s, _ in whole] == models.settings_of(grid)
    for s, v in whole[1::5]:
        assert models.search(rows, CATS, NUMS, "dt", "classification", grid={k: [x] for k, x in s.items()})[1][0][1] == pytest.approx(v, abs=1e-12)


def test_cut_forest_scores_as_single_fits(rows):
    reg = rows.withColumn("label", F.coalesce("x", F.lit(0.0)) * F.when(F.col("c") == "b", -1).otherwise(1) + F.col("y"))
    _, whole = models.search(reg, CATS, NUMS, "rf", "regression", grid={"n_estimators": [4], "max_depth": [2, 5]})
    for s, v in whole:
        assert models.search(reg, CATS, NUMS, "rf", "regression", grid={k: [x] for k, x in s.items()})[1][0][1] == pytest.approx(v, rel=1e-9)
    # fewer trees of one forest are a forest too, if not the same draw
    _, both = models.search(reg, CATS, NUMS, "rf", "regression", grid={"n_estimators": [2, 4], "max_depth": [6]})
    assert all(0 < v < 30 for _, v in both)


def test_everything_is_fitted_inside_the_fold(rows, monkeypatch):
    seen, plain = [], models.fit_preprocessor
    monkeypatch.setattr(models, "fit_preprocessor", lambda train, c, n: seen.append((sorted(r[0] for r in train.select("fold").distinct().collect()), plain(train, c, n))) or seen[-1][1])
    models.search(rows, CATS, NUMS, "logreg", "classification", grid={"C": [1.0]})
    parts = {tuple(folds): pre for folds, pre in seen}
    assert set(parts) == {(1, 2), (0, 2), (0, 1), (0, 1, 2)}
    assert parts[1, 2].categorical.labels["c"] == ["a", "b", "c"] and parts[0, 2].categorical.labels["c"] == ["a", "b", "c", "z"]
    for folds, pre in parts.items():
        m = rows.where(F.col("fold").isin(list(folds))).agg(F.percentile("x", 0.5)).first()[0]
        assert pre.numeric.stats.first()["_med_x"] == m


def test_penalty_and_weights_follow_the_fold(rows, monkeypatch):
    seen, plain = [], models._classifier
    monkeypatch.setattr(models, "_classifier", lambda name, s, wsum=None: seen.append(wsum) or plain(name, s, wsum))
    models.search(rows, CATS, NUMS, "logreg", "classification", grid={"C": [1.0]})
    assert sorted(round(w) for w in seen) == [240, 240, 240, 360]  # balanced weights sum to the rows of the part
    ratios, plain_ratio = [], models.class_ratio
    monkeypatch.setattr(models, "class_ratio", lambda df: ratios.append(plain_ratio(df)) or ratios[-1])
    models.search(rows, CATS, NUMS, "gbt", "classification", grid={"n_estimators": [2], "learning_rate": [0.1], "max_depth": [2], "subsample": [1.0], "colsample_bytree": [1.0]})
    assert len(set(ratios)) == 4


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(4)
    n = 300
    num = np.round(rng.normal(size=(n, 2)) * 3)
    num[::17, 0] = np.nan
    cat = rng.integers(0, 5, (n, 2)).astype(np.int32)  # 4 is an unseen category
    y = ((np.nan_to_num(num[:, 0]) > 0) ^ (cat[:, 1] == 2)).astype(float)
    return boosting.Table(num, cat, y, np.where(y == 1, 1.7, 1.0), rng.integers(0, 3, n), [4, 4])


def test_fewer_rounds_are_a_prefix(sample):
    setting = {"learning_rate": 0.1, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}
    for task in ("classification", "regression"):
        seen = {}
        trees, bins, base = boosting.grow(sample, sample.fold != 0, task, setting, 12, watch=lambda r, m: seen.update({r: m.copy()}))
        few, _, _ = boosting.grow(sample, sample.fold != 0, task, setting, 5)
        for a, b in zip(trees, few):
            assert all((a[k] == b[k]).all() for k in a)
        for r in (5, 12):
            assert np.allclose(boosting.predict(trees[:r], bins, base, sample.num, sample.cat), seen[r], atol=1e-12)


def test_first_split_has_the_greatest_gain(sample):
    setting = {"learning_rate": 1.0, "max_depth": 1, "subsample": 1.0}
    trees, bins, base = boosting.grow(sample, np.ones(300, bool), "classification", setting, 1)
    p = 1 / (1 + np.exp(-base))
    g, h = sample.w * (p - sample.y), sample.w * p * (1 - p)

    def gain(left):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(np.ones(300, bool)) if min(h[left].sum(), h[~left].sum()) >= 1 else -1
    num = np.nan_to_num(sample.num, nan=-np.inf)
    found = {(k, v): gain(num[:, k] <= v) for k in range(2) for v in np.unique(num[:, k])}
    found |= {(2 + k, v): gain(sample.cat[:, k] == v) for k in range(2) for v in range(1, 4)}  # the first category has no slot
    t = trees[0]
    col, cut = int(t["column"][0]), int(t["bin"][0])
    best = max(found.values())
    assert found[col, bins.cuts[col][cut] if col < 2 else cut] == pytest.approx(best)
    left = num[:, col] <= bins.cuts[col][cut] if col < 2 else sample.cat[:, col - 2] == cut
    assert t["value"][1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))


def test_boosted_model_learns_and_covers_all_rows(rows):
    grid = {"n_estimators": [5, 40], "learning_rate": [0.1], "max_depth": [3], "subsample": [0.8, 1.0], "colsample_bytree": [0.8]}
    model, scores = models.search(rows, CATS, NUMS, "gbt", "classification", grid=grid)
    assert len(scores) == 4 and max(v for _, v in scores) > 0.7
    out = model.transform(rows.withColumn("label", F.lit(None).cast("double"))).collect()
    assert len(out) == 360 and all(0 <= r.score <= 1 and r.prediction == (r.score > 0.5) for r in out)
    assert model.transform(rows.limit(0)).count() == 0


def test_bounded_sample(spark):
    df = spark.range(5000).withColumn("_row_key", F.col("id").cast("string"))
    assert 700 < boosting.sampled(df, "_row_key", 1000).count() < 1300 and boosting.sampled(df, "_row_key", 5000).count() == 5000


def test_unknown_model(rows):
    with pytest.raises(ValueError):
        models.search(rows, CATS, NUMS, "svm", "regression")


def test_equal_rows_give_equal_forests_in_any_order(rows):
    reg = rows.withColumn("label", F.coalesce("x", F.lit(0.0)) + F.col("y"))
    grid = {"n_estimators": [3], "max_depth": [3]}
    turned = reg.repartition(1).orderBy(F.desc("_row_key")).coalesce(1)
    one, two = (models._kept(t.select("_row_key", "label"), "rf") for t in (reg.coalesce(1), turned))
    assert [r._row_key for r in one.collect()] == [r._row_key for r in two.collect()]
    (_, a), (_, b) = (models.search(t, CATS, NUMS, "rf", "regression", grid=grid)[1][0] for t in (reg.coalesce(1), turned))
    assert a == pytest.approx(b, rel=1e-12)


def test_fits_in_threads_read_finished_blocks(rows, monkeypatch):
    ready, plain = [], models._estimator
    stored = lambda: sum(i.numCachedPartitions() for i in rows.sparkSession.sparkContext._jsc.sc().getRDDStorageInfo())
    rows.count()
    before = stored()
    monkeypatch.setattr(models, "_estimator", lambda *a: ready.append(stored()) or plain(*a))
    models.search(rows, CATS, NUMS, "lasso", "regression", grid={"alpha": [0.1]})
    assert ready and min(ready) > before


def test_boosted_histograms_are_read_column_by_column():
    """Sums per node, column and bin of the drawn rows decide the splits, also where most rows
    have left the level; a plain loop over rows gives the same first levels."""
    rng = np.random.default_rng(3)
    n = 400
    num, cat = rng.integers(0, 9, (n, 2)).astype(float), rng.integers(-1, 5, (n, 2)).astype(np.int32)
    y = ((num[:, 0] > 4) ^ (cat[:, 1] == 2)).astype(float)
    t = boosting.Table(num, cat, y, np.ones(n), rng.integers(0, 3, n), [5, 5])
    train = t.fold != 0
    trees, bins, base = boosting.grow(t, train, "regression", {"learning_rate": 1.0, "max_depth": 6, "subsample": 1.0}, 1)
    tree, codes, g = trees[0], bins.codes(num, cat), base - y
    node = np.zeros(n, int)
    for i in range(len(tree["left"])):
        here = train & (node == i)
        assert np.isclose(tree["value"][i], -g[here].sum() / (here.sum() + boosting.LAMBDA))
        if not tree["left"][i]:
            continue
        part = lambda m: g[m].sum() ** 2 / (m.sum() + boosting.LAMBDA)
        gains = []
        for c in range(4):
            for b in range(len(bins.cuts[c]) if c < 2 else 5):
                left = here & (codes[:, c] <= b if c < 2 else codes[:, c] == b)
                ok = (b > 0 or c < 2) and left.sum() >= 1 and (here & ~left).sum() >= 1
                gains.append(part(left) + part(here & ~left) - part(here) if ok else -np.inf)
        c, b = tree["column"][i], tree["bin"][i]
        goes = codes[:, c] <= b if c < 2 else codes[:, c] == b
        assert np.isclose(part(here & goes) + part(here & ~goes) - part(here), max(gains))
        node[(node == i) & goes], node[(node == i) & ~goes] = tree["left"][i], tree["left"][i] + 1
