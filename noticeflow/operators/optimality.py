"""Tables that show whether a fitted model is what its method promises.

Solvers differ, so a fitted model can't be compared number by number. What an
optimum must satisfy can: the penalised gradient vanishes, every row lies with
its nearest centroid, a mixture reproduces the moments of its data, principal
axes are orthogonal, importances sum to one. Each table has a row per parameter
or group, with a quantity of the *data* that the condition refers to (SQL can
recompute it from the tables) and whether the model meets it.

All sums run over the whole table in one aggregate per condition; only
parameters, which live on the driver anyway, become literals.
"""

from __future__ import annotations



import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.profile import sig


def _slots(spark, pre, values: dict[str, list]) -> DataFrame:
    """(Source, Slot, ...) with one row per encoded feature; numbers are their own slot."""
    names, sources = pre.feature_names(), pre.feature_sources()
    rows = [(s, n[len(s) + 1:] if n != s else n, *(float(v[i]) for v in values.values())) for i, (n, s) in enumerate(zip(names, sources))]
    return spark.createDataFrame(rows, "Source string, Slot string, " + ", ".join(f"{k} double" for k in values))


def _weighted_sums(x: DataFrame, **weights: Column) -> dict[str, np.ndarray]:
    """Sum of weight * features for each (non-negative) weight, in one pass."""
    tagged = x.select("features", *[w.alias(k) for k, w in weights.items()])
    r = tagged.agg(*[Summarizer.metrics("sum").summary(F.col("features"), F.col(k)).alias(k) for k in weights]).first()
    return {k: r[k]["sum"].toArray() for k in weights}


def logistic(x: DataFrame, model, penalty: float, pre, tolerance: float = 1e-3) -> DataFrame:
    """Gradient of sum(w * loss) + penalty / 2 * |beta|^2 at the fit, per slot.

    ``Weighted_Positives`` is the weight of the positive rows with the slot's
    category; at the optimum the fitted probabilities add up to it, less the penalty's pull."""
    scored = model.transform(x).withColumn("_p", vector_to_array("probability")[1])
    s = _weighted_sums(scored, fitted=F.col("_w") * F.col("_p"), seen=F.col("_w") * F.col("label"), weight=F.col("_w"))
    beta = model.coefficients.toArray()
    gradient = s["fitted"] - s["seen"] + penalty * beta
    scale = float(scored.agg(F.sum("_w")).first()[0])
    t = _slots(x.sparkSession, pre, {"_seen": s["seen"], "_gradient": gradient})
    return t.select("Source", "Slot", F.when(F.col("Source") != F.col("Slot"), F.round("_seen", 6)).alias("Weighted_Positives"),
                    (F.abs("_gradient") <= tolerance * scale).alias("Stationary"))


def lasso(x: DataFrame, model, alpha: float, pre, tolerance: float = 1e-4) -> DataFrame:
    """Subgradient conditions of 1/(2n) |y - f|^2 + alpha |beta|_1, per slot:
    the mean of slot * residual is at most alpha, and alpha with the
    coefficient's sign where that is not zero. ``Rows`` counts the rows with the slot's category."""
    r = F.col("label") - F.col("prediction")
    scored = model.transform(x)
    s = _weighted_sums(scored, above=F.greatest(r, F.lit(0.0)), below=F.greatest(-r, F.lit(0.0)), rows=F.lit(1.0))
    n, beta = scored.count(), model.coefficients.toArray()
    corr = (s["above"] - s["below"]) / n
    slack = np.where(beta == 0, np.maximum(np.abs(corr) - alpha, 0), np.abs(corr - alpha * np.sign(beta)))
    t = _slots(x.sparkSession, pre, {"_rows": s["rows"], "_slack": slack})
    return t.select("Source", "Slot", F.when(F.col("Source") != F.col("Slot"), F.round("_rows").cast("bigint")).alias("Rows"),
                    (F.col("_slack") <= tolerance).alias("Optimal"))


def _cross(vec: str, dim: int, weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w * F.col(vec)[i] * F.col(vec)[j]).alias(f"m{i}_{j}") for i in range(dim) for j in range(i, dim)]


def kmeans(res: DataFrame, centers: list[list[float]], vec: str = "vec", label: str = "cluster", tolerance: float = 1e-2) -> DataFrame:
    """Second moments of the data split into between and within parts, per pair
    of features, and whether all rows lie with their nearest centroid.

    ``Moment`` is mean(x_i * x_j) over all rows. With centroids that are their
    members' means it equals the sum of both parts."""
    dim, k = len(centers[0]), len(centers)
    c = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in centers])
    own = c[F.col(label)]
    dist = [sum(((F.col(vec)[i] - F.lit(float(m[i]))) * (F.col(vec)[i] - F.lit(float(m[i]))) for i in range(dim)), F.lit(0.0)) for m in centers]
    mine = sum(((F.col(vec)[i] - own[i]) * (F.col(vec)[i] - own[i]) for i in range(dim)), F.lit(0.0))
    rows = res.select(vec, own.alias("_c"), (mine > F.least(*dist) + 1e-9 if k > 1 else F.lit(False)).alias("_far"))
    parts = [F.sum((F.col(vec)[i] - F.col("_c")[i]) * (F.col(vec)[j] - F.col("_c")[j]) + F.col("_c")[i] * F.col("_c")[j]).alias(f"d{i}_{j}")
             for i in range(dim) for j in range(i, dim)]
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_far").alias("far"), *_cross(vec, dim), *parts)
    each = [F.struct(F.lit(i).alias("I"), F.lit(j).alias("J"), F.col("n").alias("Rows"), F.round(F.col(f"m{i}_{j}") / F.col("n"), 6).alias("Moment"),
                     (F.abs(F.col(f"m{i}_{j}") - F.col(f"d{i}_{j}")) <= tolerance * F.col("n")).alias("Decomposed"), (F.col("far") == 0).alias("Nearest"))
            for i in range(dim) for j in range(i, dim)]
    return s.select(F.inline(F.array(*each)))


def mixture(spark, weights: list[float], means: list[list[float]], covariances: list[list[list[float]]], full: bool = True, floor: float = 0.0) -> DataFrame:
    """Second moments of a fitted mixture, per pair of features (full) or per feature.

    After a step of expectation maximisation they are those of its data; ``floor``
    is what the fit adds to each variance."""
    m = np.array(means)
    out = sum(w * (np.array(s) + np.outer(u, u)) for w, u, s in zip(weights, m, covariances))
    first = (np.array(weights)[:, None] * m).sum(0)
    dim = len(first)
    rows = [(i, j, float(first[i]), float(out[i, j]) - (floor if i == j else 0.0)) for i in range(dim) for j in range(i, dim) if full or i == j]
    t = spark.createDataFrame(rows, "I int, J int, a double, b double")
    return t.select("I", "J", (F.round("a", 6) + 0.0).alias("Mean"), (F.round("b", 6) + 0.0).alias("Moment"))


def components(proj: DataFrame, ratio: list[float], loadings: np.ndarray, tolerance: float = 1e-6) -> DataFrame:
    """Explained share of each component, and whether the axes are orthonormal and
    the projections centred and uncorrelated."""
    gram = loadings.T @ loadings
    orthonormal = bool(np.abs(gram - np.eye(gram.shape[0])).max() <= tolerance)
    s = proj.agg(F.covar_pop("PC1", "PC2").alias("c"), F.avg("PC1").alias("a"), F.avg("PC2").alias("b"), F.count(F.lit(1)).alias("n"))
    free = (F.abs("c") <= tolerance * 100) & (F.abs("a") <= tolerance * 100) & (F.abs("b") <= tolerance * 100)
    each = [F.struct(F.lit(i + 1).alias("Component"), F.col("n").alias("Rows"), F.round(F.lit(float(v)), 6).alias("Explained_Variance"),
                     F.lit(orthonormal).alias("Orthonormal"), free.alias("Uncorrelated")) for i, v in enumerate(ratio)]
    return s.select(F.inline(F.array(*each)))


def importance(table: DataFrame, grouped: DataFrame) -> DataFrame:
    """Slots per source column; whether the sources' importances are their slots' sums and all add up to one."""
    own = table.groupBy("Source").agg(F.count(F.lit(1)).alias("Slots"), F.sum("Importance").alias("_own"), F.min("Importance").alias("_least"))
    total = table.agg(F.sum("Importance").alias("_total"))
    t = own.join(grouped, "Source", "left").crossJoin(F.broadcast(total))  # one row
    return t.select("Source", "Slots", ((F.abs(F.col("_own") - F.col("Importance")) <= 1e-9) & (F.col("_least") >= 0)).alias("Adds_Up"),
                    (F.abs(F.col("_total") - 1) <= 1e-9).alias("Whole"))


def tree_leaves(x: DataFrame, model, least: int) -> DataFrame:
    """Rows and weight of the training table, and whether every leaf holds enough
    rows and predicts its weighted majority."""
    per = model.transform(x).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("label")).alias("w1"),
                                                 F.min("prediction").alias("p"), F.max("prediction").alias("p2"))
    fits = (F.col("n") >= least) & (F.col("p") == F.col("p2")) & F.when(F.col("p") == 1, 2 * F.col("w1") >= F.col("w") - 1e-6).otherwise(2 * F.col("w1") <= F.col("w") + 1e-6)
    return per.agg(F.sum("n").alias("Rows"), F.round(F.sum("w"), 4).alias("Weight"), F.every(fits).alias("Leaves_Agree"))


def forest_range(x: DataFrame, model) -> DataFrame:
    """Rows, mean and bounds of the labels, and whether all predictions lie inside them."""
    s = model.transform(x).agg(F.count(F.lit(1)).alias("Rows"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.avg("label").alias("m"),
                               F.min("prediction").alias("plo"), F.max("prediction").alias("phi"), F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("e"),
                               F.var_pop("label").alias("v"))
    return s.select("Rows", sig(F.col("lo")).alias("Least"), sig(F.col("hi")).alias("Greatest"), ((F.col("plo") >= F.col("lo") - 1e-9) & (F.col("phi") <= F.col("hi") + 1e-9)).alias("Inside"),
                    (F.col("e") <= F.col("v")).alias("Better_Than_Mean"))


def first_split_gains(coded: DataFrame, categories: list[str], labels: dict[str, list[str]], positive: Column, root_gain: float, penalty: float = 1.0) -> DataFrame:
    """Second-order gain at the root of a boosted classifier of "category or not", per category.

    Gradient and hessian sums of all categories come from one grouped aggregate.
    ``coded`` has the columns ``_cat``, ``label`` and the constant ``_p`` (first probability)."""
    g, h = F.col("_w") * (F.col("_p") - F.col("label")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
    long = coded.withColumn("_w", F.when(F.col("label") == 1, positive).otherwise(F.lit(1.0))) \
                .select(g.alias("g"), h.alias("h"), F.posexplode("_cat").alias("k", "v"))
    hist = long.groupBy("k", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    total = hist.where("k = 0").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(c).alias("Column"), F.lit(label).alias("Category"))
                      for k, c in enumerate(categories) for v, label in enumerate(labels[c]) if v])
    named = coded.sparkSession.range(1).select(F.inline(names))
    part = lambda a, b: a * a / (b + penalty)
    j = hist.join(F.broadcast(named), ["k", "v"]).crossJoin(F.broadcast(total))  # one row
    gain = part(F.col("g"), F.col("h")) + part(F.col("tg") - F.col("g"), F.col("th") - F.col("h")) - part(F.col("tg"), F.col("th"))
    return j.select("Column", "Category", (F.round(gain, 5) + 0.0).alias("Gain"), (gain <= root_gain + 1e-6).alias("Not_Above_Root"))


