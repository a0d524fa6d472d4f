"""Mixtures, segments and projections against what they must satisfy."""

import math
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from noticeflow.operators import cluster, optimality


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    a = rng.normal([0, 0, 5], [0.3, 2.0, 1.0], (200, 3))
    b = rng.normal([6, 1, 0], [1.0, 0.2, 0.5], (120, 3))
    return np.vstack([a, b])


@pytest.fixture(scope="module")
def table(spark, points):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "pos long, vec array<double>")
    return df.withColumn("features", array_to_vector("vec")).cache()


def _numpy_em(x, m):
    """One step of plain expectation maximisation, and the mean log-likelihood before it."""
    w, mu, var = np.array(m.weights), np.array(m.means), np.array(m.variances)
    lj = np.log(w) - 0.5 * (((x[:, None, :] - mu) ** 2 / var) + np.log(2 * math.pi * var)).sum(-1)
    top = lj.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(lj - top).sum(1))
    r = np.exp(lj - ll[:, None])
    return r, ll.mean(), r.sum(0) / len(x), (r.T @ x) / r.sum(0)[:, None]


def test_diagonal_mixture(table, points):
    res, m = cluster.train_gmm_diag(table, 3, k=2, n_init=2)
    r, ll, weights, means = _numpy_em(points, m)
    assert all(b >= a - 1e-9 for a, b in zip(m.history, m.history[1:]))
    assert ll == pytest.approx(m.history[-1], abs=1e-9)
    assert np.allclose(weights, m.weights, atol=2e-3) and np.allclose(means, m.means, atol=2e-2)
    got = {x.pos: (x.cluster, x.probability) for x in res.select("pos", "cluster", "probability").collect()}
    assert all(got[i] == (int(r[i].argmax()), pytest.approx(r[i].max(), abs=1e-9)) for i in range(len(points)))
    assert np.allclose(m.means, [[0, 0, 5], [6, 1, 0]], atol=0.5)


def test_a_mixture_that_does_not_converge_is_an_error(table):
    with pytest.raises(RuntimeError):
        cluster.train_gmm_diag(table, 3, k=2, max_iter=1, tol=-1.0)


def test_one_component_is_the_normal_distribution(table, points):
    _, m = cluster.train_gmm_diag(table, 3, k=1)
    assert np.allclose(m.means[0], points.mean(0)) and np.allclose(m.variances[0], points.var(0) + 1e-6)


def test_moments_of_segments(spark, table, points):
    res, model = cluster.train_kmeans(table, 2, 3)
    centers = sorted(c.tolist() for c in model.clusterCenters())
    rows = optimality.kmeans(res, centers).collect()
    assert len(rows) == 6 and all(r.Decomposed and r.Nearest for r in rows)
    assert {(r.I, r.J): r.Moment for r in rows} == {(i, j): pytest.approx((points[:, i] * points[:, j]).mean(), abs=1e-6) for i in range(3) for j in range(i, 3)}
    # wrong centroids are noticed
    moved = [[v + 1.0 for v in c] for c in centers]
    assert not any(r.Decomposed for r in optimality.kmeans(res, moved).where("I = 0 and J = 0").collect())
    assert not any(r.Nearest for r in optimality.kmeans(res, centers[::-1]).collect())


def test_principal_axes(spark, table, points):
    proj, ratio, axes = cluster.pca_2d(table.withColumn("cluster", F.lit(0)))
    want = np.linalg.eigvalsh(np.cov(points.T))[::-1]
    assert np.allclose(ratio, want[:2] / want.sum())
    rows = optimality.components(proj, ratio, axes).collect()
    assert [r.Component for r in rows] == [1, 2] and all(r.Orthonormal and r.Uncorrelated and r.Rows == 320 for r in rows)


def test_starts_of_a_fit_run_side_by_side(spark, monkeypatch):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 3) * 5 + i * 0.01, float(i % 7)]),) for i in range(60)], ["features"])
    met = threading.Barrier(2)

    def together(cls):
        plain = cls.fit
        return lambda self, data: (met.wait(60), plain(self, data))[1]

    alone = [cluster.KMeans(k=3, seed=42 + i, maxIter=300).fit(rows).summary.trainingCost for i in range(2)]
    monkeypatch.setattr(cluster.KMeans, "fit", together(cluster.KMeans))
    monkeypatch.setattr(cluster.GaussianMixture, "fit", together(cluster.GaussianMixture))
    res, model = cluster.train_kmeans(rows, 3, 2)
    assert model.summary.trainingCost == pytest.approx(min(alone))
    res, model = cluster.train_gmm(rows, 2, 2)
    assert res.count() == 60 and model.summary.logLikelihood < 0
