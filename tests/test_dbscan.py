"""Distributed DBSCAN against a brute-force O(n^2) version on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from noticeflow.operators import dbscan as module
from noticeflow.operators.dbscan import dbscan


def brute(points: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """Sequential scan in row order (the usual library's semantics)."""
    n = len(points)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    nb = [np.where(d[i] <= eps)[0] for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    lab = [-1] * n
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            for k in nb[j]:
                if lab[k] == -1:
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return lab


def _run(spark, pts, eps, ms):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "pos bigint, vec array<double>")
    out = dbscan(df, "pos", "vec", dim=pts.shape[1], eps=eps, min_samples=ms)
    got = dict((r.pos, r.cluster) for r in out.select("pos", "cluster").collect())
    return [got[i] for i in range(len(pts))]


def test_blobs_with_noise_and_duplicates(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(0, 0.3, (60, 3))
    b = rng.normal(3, 0.3, (60, 3))
    noise = rng.uniform(-4, 7, (15, 3))
    dup = np.repeat(a[:1], 10, axis=0)
    pts = np.vstack([b, noise, a, dup])
    assert _run(spark, pts, 0.5, 5) == brute(pts, 0.5, 5)


def test_chain_needs_many_rounds(spark):
    pts = np.array([[i * 0.4, 0.0] for i in range(40)] + [[100.0, 100.0]])
    assert _run(spark, pts, 0.5, 2) == brute(pts, 0.5, 2)


def test_embeddings_sample(spark):
    from tests.conftest import SF_SMALL
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").limit(150)
    rows = df.select("vec_id", F.slice("embedding", 1, 4).alias("v")).collect()
    pts = np.array([[float(x) for x in r.v] for r in rows])
    assert _run(spark, pts, 0.35, 4) == brute(pts, 0.35, 4)


def test_dense_cells_and_their_edges(spark):
    """Cells of many points, cells that nearly touch, points just inside and outside the radius."""
    rng = np.random.default_rng(3)
    blob = rng.uniform(0, 0.34, (150, 2))
    near = rng.uniform(0, 0.2, (60, 2)) + [0.34 + 0.3, 0]
    apart = rng.uniform(0, 0.2, (60, 2)) + [0.34 + 0.3 + 0.2 + 0.51, 0]
    border = np.array([[-0.45, 0.1], [-0.51, 0.1], [0.1, 0.83], [0.1, 0.86]])
    pts = np.vstack([blob, near, apart, border])
    for eps, least in ((0.5, 8), (0.5, 100)):
        assert _run(spark, pts, eps, least) == brute(pts, eps, least)


def test_work_on_one_blob_is_about_linear(spark, monkeypatch):
    """Rows that the descent looks at for 1,500 and 6,000 points in one blob."""
    from noticeflow.operators import dbscan as module
    seen = []
    plain = module.materialize

    def counted(df):
        out = plain(df)
        if "_in" in out.columns:
            seen.append(out.count())
        return out
    monkeypatch.setattr(module, "materialize", counted)
    work = []
    for n in (1500, 6000):
        seen.clear()
        pts = np.random.default_rng(1).normal(0, 0.3, (n, 3))
        lab = _run(spark, pts, 0.5, 10)
        assert lab.count(0) > 0.98 * n
        work.append(sum(seen))
    assert work[1] < 8 * work[0]


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    # many equal coordinates: few bytes as Parquet, far more in the driver's memory
    rng, seen, plain = random.Random(4), [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    pts = [(i, [rng.choice([0.0, 0.3, 0.6, 2.0]), rng.random() * 3]) for i in range(200)]
    dbscan(spark.createDataFrame(pts, "_row_pos bigint, vec array<double>"), "_row_pos", "vec", 2, 0.4, 4).count()
    assert sum("SortMergeJoin" in p for p in seen) > 5
    assert not [p for p in seen if "BroadcastHashJoin" in p]
