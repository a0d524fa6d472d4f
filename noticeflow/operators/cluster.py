"""Clustering on Spark ML (M3, M4, M6) and the 2-D projection.

Spark's ``KMeans``/``GaussianMixture`` have no ``n_init``: the input is
cached and fitted once per seed, keeping the lowest cost / highest
log-likelihood. Labels are renumbered by sorted centroid (first coordinate,
then the rest) so that a result does not depend on the winning seed's
arbitrary cluster order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from noticeflow.session import materialized


def _relabel(df: DataFrame, centers: list, col: str) -> DataFrame:
    order = sorted(range(len(centers)), key=lambda i: tuple(centers[i]))
    mapping = {old: new for new, old in enumerate(order)}
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(col, m[F.col(col)].cast("int"))


#: Starts that are fitted side by side; each keeps its own rows in memory.
PARALLEL = 3


def _starts(fitted: Callable[[int], tuple], n: int) -> list[tuple]:
    """``fitted(0) .. fitted(n - 1)`` in order. A step of a fit is one short job over
    few columns, so several fits share the cores."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(fitted, range(n)))


def train_kmeans(df: DataFrame, k: int = 4, n_init: int = 15, seed: int = 42,
                 features: str = "features", out: str = "cluster"):
    """M3: best of ``n_init`` seeded k-means fits (lowest training cost)."""
    data = materialized(df)

    def fitted(i: int) -> tuple[float, object]:
        m = KMeans(k=k, seed=seed + i, maxIter=300, featuresCol=features, predictionCol=out).fit(data)
        if m.summary.numIter >= 300:
            raise RuntimeError("k-means did not converge in 300 iterations")
        return m.summary.trainingCost, m

    model = min(_starts(fitted, n_init), key=lambda t: t[0])[1]
    centers = [c.tolist() for c in model.clusterCenters()]
    res = _relabel(model.transform(data), centers, out)
    return res, model


def silhouette(df: DataFrame, features: str = "features", label: str = "cluster") -> float:
    """Silhouette with squared Euclidean distance over the whole table
    (linear cost; the Euclidean form needs every pair of points)."""
    pts = df.where(F.col(label) != -1)
    return ClusteringEvaluator(featuresCol=features, predictionCol=label,
                               distanceMeasure="squaredEuclidean").evaluate(pts)


def find_optimal_k(df: DataFrame, max_k: int = 6, n_init: int = 15, seed: int = 42,
                   features: str = "features") -> list[tuple[int, float]]:
    """M4: silhouette for k = 2..max_k (the best k has the highest score)."""
    out = []
    df = materialized(df)
    for k in range(2, max_k + 1):
        res, _ = train_kmeans(df, k, n_init, seed, features)
        out.append((k, silhouette(res, features)))
    return out


def train_gmm(df: DataFrame, k: int = 4, n_init: int = 3, seed: int = 42,
              features: str = "features", out: str = "cluster"):
    """M6: best of ``n_init`` Gaussian mixtures (full covariance) by
    log-likelihood; hard label = most probable component."""
    data = materialized(df)

    def fitted(i: int) -> tuple[float, object]:
        m = GaussianMixture(k=k, maxIter=1000, seed=seed + i, featuresCol=features, predictionCol=out,
                            probabilityCol="_prob").fit(data)
        if m.summary.numIter >= 1000:
            raise RuntimeError("the mixture did not converge in 1000 iterations")
        return m.summary.logLikelihood, m

    model = max(_starts(fitted, n_init), key=lambda t: t[0])[1]
    means = [g.mean.toArray().tolist() for g in model.gaussians]
    res = model.transform(data).withColumn("probability", F.array_max(vector_to_array("_prob")))
    return _relabel(res.drop("_prob"), means, out), model


@dataclass
class DiagonalMixture:
    """Weights, means and variances of the components, and the mean
    log-likelihood before each step."""
    weights: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    history: list[float]


def _log_joint(vec: str, w: Column, mu: Column, var: Column, j: int, dim: int) -> Column:
    """log(weight_j * density_j) of a row, written out per index."""
    terms = [(F.col(vec)[i] - mu[j * dim + i]) * (F.col(vec)[i] - mu[j * dim + i]) / var[j * dim + i] + F.log(var[j * dim + i]) for i in range(dim)]
    return F.log(w[j]) - 0.5 * (sum(terms[1:], terms[0]) + dim * math.log(2 * math.pi))


def _responsibilities(df: DataFrame, vec: str, params: DataFrame, k: int, dim: int) -> DataFrame:
    """``_r0 .. _r(k-1)`` and ``_ll``, the log of their sum (log-sum-exp), of
    every row; the parameters are one broadcast row, so that all steps share one compiled plan."""
    j = df.crossJoin(F.broadcast(params))
    j = j.withColumns({f"_l{c}": _log_joint(vec, F.col("_w"), F.col("_mu"), F.col("_var"), c, dim) for c in range(k)})
    top = F.greatest(*[F.col(f"_l{c}") for c in range(k)]) if k > 1 else F.col("_l0")
    j = j.withColumn("_top", top)
    j = j.withColumn("_ll", F.col("_top") + F.log(sum((F.exp(F.col(f"_l{c}") - F.col("_top")) for c in range(k)), F.lit(0.0))))
    return j.withColumns({f"_r{c}": F.exp(F.col(f"_l{c}") - F.col("_ll")) for c in range(k)}).drop("_w", "_mu", "_var", "_top", *[f"_l{c}" for c in range(k)])


def _moments(rows: DataFrame, vec: str, k: int, dim: int, ll: Column) -> Row:
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(ll).alias("ll")]
    for c in range(k):
        r = F.col(f"_r{c}")
        aggs.append(F.sum(r).alias(f"r{c}"))
        aggs += [F.sum(r * F.col(vec)[i]).alias(f"s{c}_{i}") for i in range(dim)]
        aggs += [F.sum(r * F.col(vec)[i] * F.col(vec)[i]).alias(f"q{c}_{i}") for i in range(dim)]
    return rows.agg(*aggs).first()


def train_gmm_diag(df: DataFrame, dim: int, k: int = 3, n_init: int = 1, seed: int = 42, vec: str = "vec",
                   max_iter: int = 1000, tol: float = 1e-3, floor: float = 1e-6, out: str = "cluster"):
    """M6 with diagonal covariances, by expectation maximisation.

    A start is a k-means assignment. One step is one aggregate over the table:
    the responsibility-weighted sums of 1, x and x^2 per component, which combine
    before the shuffle. Ends when the mean log-likelihood gains less than ``tol``;
    raises if ``max_iter`` steps do not suffice. ``floor`` is added to each
    variance. Labels follow the sorted means. Returns (rows with ``out`` and
    ``probability``, DiagonalMixture)."""
    spark = df.sparkSession
    data = materialized(df)
    vectors = data.withColumn("_features", array_to_vector(vec))

    def fitted(r: Row, history: list[float]) -> DiagonalMixture:
        mean = [[r[f"s{c}_{i}"] / r[f"r{c}"] for i in range(dim)] for c in range(k)]
        var = [[max(r[f"q{c}_{i}"] / r[f"r{c}"] - mean[c][i] ** 2, 0.0) + floor for i in range(dim)] for c in range(k)]
        return DiagonalMixture([r[f"r{c}"] / r["n"] for c in range(k)], mean, var, history)

    def row(m: DiagonalMixture) -> DataFrame:
        flat = lambda x: [float(v) for line in x for v in line]
        return spark.createDataFrame([(m.weights, flat(m.means), flat(m.variances))], "_w array<double>, _mu array<double>, _var array<double>")

    best = None
    for start in range(n_init):
        if k > 1:
            km = KMeans(k=k, seed=seed + start, featuresCol="_features", predictionCol="_start", maxIter=300).fit(vectors)
            first = km.transform(vectors)
        else:
            first = vectors.withColumn("_start", F.lit(0))
        first = first.withColumns({f"_r{c}": (F.col("_start") == c).cast("double") for c in range(k)})
        m = fitted(_moments(first, vec, k, dim, F.lit(0.0)), [])
        for _ in range(max_iter):
            r = _moments(_responsibilities(data, vec, row(m), k, dim), vec, k, dim, F.col("_ll"))
            history = [*m.history, float(r["ll"])]
            if len(history) > 1 and history[-1] - history[-2] < tol:
                m.history = history
                break
            m = fitted(r, history)
        else:
            raise RuntimeError(f"the mixture did not converge in {max_iter} steps")
        if best is None or m.history[-1] > best.history[-1]:
            best = m
    order = sorted(range(k), key=lambda c: best.means[c])
    best = DiagonalMixture([best.weights[c] for c in order], [best.means[c] for c in order], [best.variances[c] for c in order], best.history)
    rows = _responsibilities(data, vec, row(best), k, dim)
    p = F.array(*[F.col(f"_r{c}") for c in range(k)])
    res = rows.withColumn("probability", F.array_max(p)).withColumn(out, (F.array_position(p, F.col("probability")) - 1).cast("int"))
    return res.drop("_ll", *[f"_r{c}" for c in range(k)]), best


def pca_2d(df: DataFrame, features: str = "features", label: str = "cluster"):
    """2-D PCA of the non-noise rows on *centred* vectors (Spark's PCA
    does not centre); component signs fixed so the largest loading is
    positive. Returns (projected rows, explained variance ratios, loadings)."""
    pts = df.where(F.col(label) != -1)
    centred = StandardScaler(inputCol=features, outputCol="_centred", withMean=True,
                             withStd=False).fit(pts).transform(pts)
    model = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    arr = vector_to_array("_pc")
    res = model.transform(centred).select("*", (arr[0] * signs[0]).alias("PC1"), (arr[1] * signs[1]).alias("PC2")) \
                 .drop("_centred", "_pc")
    return res, [float(x) for x in model.explainedVariance.toArray()], pc
