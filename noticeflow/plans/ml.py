"""Query registry, part 3: preprocessing, models, clustering (scripts 06-08).

Preprocessing queries have DuckDB oracles; fitted models are checked by
rows only (their numbers depend on Spark ML's solvers).
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import boosting, cluster, dbscan, evaluate, features, models, optimality, split, trees
from noticeflow.operators.profile import sig
from noticeflow.plans import analytics
from noticeflow.plans import queries as base
from noticeflow.session import materialize

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Feature sets of the classification, regression and
# clustering scripts.
CLASS_CATEGORICAL = ["ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "TOP_TYPE", "CPV",
                     "TYPE_OF_CONTRACT", "CRIT_CODE"]
CLASS_NUMERIC = ["LOT_AWARD_VALUE_EUR", "DURATION", "PREPARATION_DAYS", "LOTS_NUMBER",
                 "NUTS_REGION_COUNT", "NUTS_LEVEL", "B_EU_FUNDS", "IS_FRAMEWORK",
                 "COOPERATIVE_PURCHASING", "B_RECURRENT_PROCUREMENT"]
REG_CATEGORICAL = ["ISO_COUNTRY_CODE", "CAE_TYPE", "CPV", "TYPE_OF_CONTRACT", "CRIT_CODE",
                   "TOP_TYPE"]
REG_NUMERIC = ["DURATION", "PREPARATION_DAYS", "LOTS_NUMBER", "NUTS_REGION_COUNT",
               "B_EU_FUNDS", "B_RECURRENT_PROCUREMENT"]
CLUSTER_NUMERIC = analytics.CLUSTER_NUMERIC


def _row_key() -> F.Column:
    return F.concat_ws("-", F.col("_row_pos").cast("string"), F.col("_row_pos2").cast("string"))


def class_table(spark, d) -> DataFrame:
    """F20 + P11 + L2 + L4: target, notice-grouped test flag and CV fold."""
    g = analytics.golden(spark, d).withColumn("_row_key", _row_key())
    y = F.coalesce(F.col("NUMBER_OF_TENDERS") <= 1, F.lit(False)).cast("int")
    g = g.withColumn("TARGET_MARKET_FAILURE", y).dropna(subset=["TARGET_MARKET_FAILURE"])
    g = split.group_split(g, "ID_NOTICE", 0.2, 42)
    return split.folds(g, "ID_NOTICE", 3, 42)


# Columns that would give the target away, left out before the split.
LEAKAGE = ["NUMBER_OF_TENDERS", "TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR"]


@query
def split_projection(spark, d):
    """L2 + P12: values per feature on both sides of the group split, leakage columns left out."""
    g = analytics.golden(spark, d).drop("_row_pos", "_row_pos2")
    g = g.withColumn("TARGET_MARKET_FAILURE", F.coalesce(F.col("NUMBER_OF_TENDERS") <= 1, F.lit(False)).cast("int"))
    sides = split.group_split_frames(g, "TARGET_MARKET_FAILURE", "ID_NOTICE", LEAKAGE)
    out = None
    for name, t in zip(("train", "test"), sides):
        counts = t.agg(*[F.count(c).alias(c) for c in t.columns])
        rows = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("Side"), F.lit(c).alias("Column"), F.col(c).alias("Values")) for c in t.columns])))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def numeric_scaled(spark, d):
    """M1 fitted on the training notices, applied to every row."""
    t = class_table(spark, d)
    sc = features.fit_numeric_scaler(t.where(F.col("_is_test") == 0), CLASS_NUMERIC)
    out = sc.transform(t.select("_row_key", *CLASS_NUMERIC))
    return out.select("_row_key", *[sig(F.col(c + "_scaled")).alias(c + "_scaled")
                                    for c in CLASS_NUMERIC])


@query
def onehot_features(spark, d):
    """M2 in long form: the active one-hot slots of every row (first sorted
    training category dropped, unseen categories encode as no slot)."""
    t = class_table(spark, d)
    table = features.fit_category_table(t.where(F.col("_is_test") == 0), CLASS_CATEGORICAL)
    return table.slots(t, "_row_key").select("Column", "Category", "_row_key")


def _fit_classifier(spark, d, name):
    t = class_table(spark, d).withColumn("label", F.col("TARGET_MARKET_FAILURE").cast("double"))
    t = materialize(t.select("_row_key", "ID_NOTICE", "fold", "_is_test", "label", *CLASS_CATEGORICAL, *CLASS_NUMERIC))
    best, scores = models.search(t.where(F.col("_is_test") == 0), CLASS_CATEGORICAL, CLASS_NUMERIC, name, "classification")
    return best, scores, t.where(F.col("_is_test") == 1), best.pre


def _class_train(spark, d, name):
    """(fitted, its setting, training rows, their features with balanced weights)."""
    t = class_table(spark, d).withColumn("label", F.col("TARGET_MARKET_FAILURE").cast("double"))
    t = materialize(t.where(F.col("_is_test") == 0).select("_row_key", "fold", "label", *CLASS_CATEGORICAL, *CLASS_NUMERIC))
    best, scores = models.search(t, CLASS_CATEGORICAL, CLASS_NUMERIC, name, "classification")
    x = materialize(models.balanced_weights(best.pre.transform(t).select("label", "features"), "label"))
    return best, max(scores, key=lambda v: v[1])[0], t, x


@query
def logreg_stationary(spark, d):
    """M7: the penalised gradient vanishes at the fitted coefficients."""
    best, setting, _, x = _class_train(spark, d, "logreg")
    return optimality.logistic(x, best.model, 1.0 / setting["C"], best.pre)


@query
def tree_leaves(spark, d):
    """M8: every leaf predicts the weighted majority of enough training rows."""
    best, setting, _, x = _class_train(spark, d, "dt")
    return optimality.tree_leaves(x, best.model, setting["min_samples_leaf"])


@query
def boosted_first_split(spark, d):
    """M9: no category splits the root better than the first tree does (all rows, all columns drawn)."""
    t = class_table(spark, d).withColumn("label", F.col("TARGET_MARKET_FAILURE").cast("double"))
    t = materialize(t.where(F.col("_is_test") == 0).select("_row_key", "fold", "label", *CLASS_CATEGORICAL, *CLASS_NUMERIC))
    pre = features.fit_preprocessor(t, CLASS_CATEGORICAL, CLASS_NUMERIC)
    ratio = models.class_ratio(t)
    model = boosting.fit_model(spark, trees.coded_tables(t, {None: pre}, {None: ratio}, "fold")[None], pre, "classification", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0})
    p = 1.0 / (1.0 + math.exp(-model.base))
    coded = pre.coded(t)
    root = boosting.root_gain(coded, model, ratio)
    return optimality.first_split_gains(coded.withColumn("_p", F.lit(p)), CLASS_CATEGORICAL, pre.categorical.labels, F.lit(float(ratio)), root)


@query
def failure_logreg(spark, d):
    """M7 + M13: balanced logistic regression, C chosen by grouped 3-fold CV."""
    m, _, test, _ = _fit_classifier(spark, d, "logreg")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def failure_tree(spark, d):
    """M8 + M13: balanced decision tree."""
    m, _, test, _ = _fit_classifier(spark, d, "dt")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def failure_gbt(spark, d):
    """M9 + M13: boosted trees, positives weighted by the class ratio."""
    m, _, test, _ = _fit_classifier(spark, d, "gbt")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def grid_search_scores(spark, d):
    """Mean macro-F1 of every logistic-regression setting."""
    _, scores, _, _ = _fit_classifier(spark, d, "logreg")
    rows = [(str(s), float(v)) for s, v in scores]
    return spark.createDataFrame(rows, "Setting string, Mean_Macro_F1 double")


@query
def failure_evaluation(spark, d):
    """E2 on the logistic model's test predictions (report + AP + AUC)."""
    m, _, test, _ = _fit_classifier(spark, d, "logreg")
    p = materialize(models.predictions(m, test, ["_row_key"]))
    rep = evaluate.classification_report(p, "label", "prediction")
    ap = evaluate.average_precision(p, "label", "score")
    auc = evaluate.roc_auc(p, "label", "score")
    extra = ap.crossJoin(auc).select(
        F.inline(F.array(F.struct(F.lit("pr_auc").alias("Label"),
                                  F.col("Average_Precision").alias("F1")),
                         F.struct(F.lit("roc_auc").alias("Label"), F.col("ROC_AUC").alias("F1")))))
    return rep.unionByName(extra, allowMissingColumns=True)


def _importance_table(spark, m, pre) -> DataFrame:
    rows = models.importances(m, pre.feature_names(), pre.feature_sources())
    return spark.createDataFrame(rows, "Feature string, Source string, Importance double")


@query
def feature_importance(spark, d):
    """Top-15 importances of the decision tree's encoded features."""
    m, _, _, pre = _fit_classifier(spark, d, "dt")
    return _importance_table(spark, m, pre).orderBy(F.desc("Importance"), "Feature").limit(15)


@query
def grouped_importance(spark, d):
    """Importance summed back to each source column (exact mapping)."""
    m, _, _, pre = _fit_classifier(spark, d, "dt")
    t = _importance_table(spark, m, pre)
    return _grouped(t).orderBy(F.desc("Importance"))


def _grouped(t: DataFrame) -> DataFrame:
    return t.groupBy("Source").agg(F.sum("Importance").alias("Importance"))


@query
def importance_sums(spark, d):
    """E10 + E11: slots per column, sums of their importances."""
    m, _, _, pre = _fit_classifier(spark, d, "dt")
    t = materialize(_importance_table(spark, m, pre))
    return optimality.importance(t, _grouped(t))


@query
def evaluation_identities(spark, d):
    """E1 + E2 + F19: reports agree with what the predictions themselves give."""
    m, _, test, _ = _fit_classifier(spark, d, "logreg")
    p = materialize(models.predictions(m, test, ["_row_key"]))
    rep = evaluate.classification_report(p, "label", "prediction")
    own = p.groupBy(F.col("label").cast("int").cast("string").alias("Label")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("_recall"))
    classes = rep.join(own, "Label").select(F.concat(F.lit("class "), "Label").alias("Part"), F.col("_n").alias("Rows"),
                                            ((F.col("Support") == F.col("_n")) & (F.abs(F.col("Recall") - F.col("_recall")) < 1e-8)).alias("Agrees"))
    m, _, test = _fit_regressor(spark, d, "lasso")
    q = materialize(models.predictions(m, test, ["_row_key"]))
    got = evaluate.regression_metrics(q, "label", "prediction", n_features=len(REG_CATEGORICAL + REG_NUMERIC), transform="ratio")
    y, f = F.exp("label"), F.exp("prediction")
    own = q.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - f)).alias("_mae"), F.sqrt(F.avg(F.pow(y - f, 2))).alias("_rmse"),
                (1 - F.sum(F.pow(y - f, 2)) / (F.count(F.lit(1)) * F.var_pop(y))).alias("_r2"), F.percentile(F.abs(y - f), 0.5).alias("_medae"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6 * F.greatest(F.abs(F.col(b)), F.lit(1.0))
    reg = got.crossJoin(own).select(F.lit("deviation").alias("Part"), F.col("n").alias("Rows"),
                                    (near("MAE", "_mae") & near("RMSE", "_rmse") & near("R2", "_r2") & near("MedAE", "_medae")).alias("Agrees"))
    return classes.unionByName(reg)


# ----------------------------------------------------------------- regression

def reg_table(spark, d) -> DataFrame:
    """A10 + P8 + F18 + L3 + L5 (script 08's data preparation)."""
    g = base._rounded(base.notice_first_row(spark, d), [])
    g = g.where((F.col("TARGET_AWARD_VALUE_EUR") > 0) & (F.col("ESTIMATED_VALUE_EUR") > 0))
    g = g.withColumn("label", F.ln(F.col("TARGET_AWARD_VALUE_EUR") / F.col("ESTIMATED_VALUE_EUR")))
    g = g.withColumn("_row_key", F.col("ID_NOTICE").cast("string"))
    g = split.row_split(g, "_row_key", 0.2, 42)
    return split.folds(g, "_row_key", 3, 42)


def _fit_regressor(spark, d, name):
    t = materialize(reg_table(spark, d).select("_row_key", "ID_NOTICE", "fold", "_is_test", "label", *REG_CATEGORICAL, *REG_NUMERIC))
    best, scores = models.search(t.where(F.col("_is_test") == 0), REG_CATEGORICAL, REG_NUMERIC, name, "regression")
    return best, scores, t.where(F.col("_is_test") == 1)


def _reg_train(spark, d, name):
    t = reg_table(spark, d)
    t = materialize(t.where(F.col("_is_test") == 0).select("_row_key", "fold", "label", *REG_CATEGORICAL, *REG_NUMERIC))
    best, scores = models.search(t, REG_CATEGORICAL, REG_NUMERIC, name, "regression")
    return best, min(scores, key=lambda v: v[1])[0], materialize(best.pre.transform(t).select("label", "features"))


@query
def lasso_optimal(spark, d):
    """Subgradient conditions of the lasso at the fitted coefficients."""
    best, setting, x = _reg_train(spark, d, "lasso")
    return optimality.lasso(x, best.model, setting["alpha"], best.pre)


@query
def forest_range(spark, d):
    """Predictions of averaged trees stay inside the labels' range."""
    t = reg_table(spark, d)
    t = materialize(t.where(F.col("_is_test") == 0).select("_row_key", "fold", "label", *REG_CATEGORICAL, *REG_NUMERIC))
    best, _ = models.search(t, REG_CATEGORICAL, REG_NUMERIC, "rf", "regression")
    return optimality.forest_range(t, best)


@query
def deviation_lasso(spark, d):
    """Lasso on the log deviation ratio."""
    m, _, test = _fit_regressor(spark, d, "lasso")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def deviation_forest(spark, d):
    """Random forest (all features considered at each split)."""
    m, _, test = _fit_regressor(spark, d, "rf")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def deviation_gbt(spark, d):
    """Gradient-boosted regressor."""
    m, _, test = _fit_regressor(spark, d, "gbt")
    return models.predictions(m, test, ["_row_key", "ID_NOTICE"])


@query
def deviation_evaluation(spark, d):
    """E1 + F19: lasso test metrics on back-transformed ratios."""
    m, _, test = _fit_regressor(spark, d, "lasso")
    p = models.predictions(m, test, ["_row_key"])
    return evaluate.regression_metrics(p, "label", "prediction",
                                       n_features=len(REG_CATEGORICAL + REG_NUMERIC),
                                       transform="ratio")


# ----------------------------------------------------------------- clustering

def cluster_input(spark, d):
    """Script 06: one row per notice, the five numeric features scaled (M1)."""
    g = base._rounded(base.notice_first_row(spark, d), [])
    pre = features.fit_preprocessor(g, [], CLUSTER_NUMERIC)
    x = pre.transform(g.select("_row_pos", "ID_NOTICE", "TYPE_OF_CONTRACT", "ISO_COUNTRY_CODE",
                               *CLUSTER_NUMERIC))
    return materialize(x)


@query
def kmeans_segments(spark, d):
    """M3: k = 4, best of 15 starts."""
    res, _ = cluster.train_kmeans(cluster_input(spark, d), 4, 15)
    return res.select("ID_NOTICE", "cluster")


@query
def kmeans_quality(spark, d):
    """E3 on the k-means segments: Davies-Bouldin, Calinski-Harabasz (full
    table) and the squared-Euclidean silhouette."""
    res, _ = cluster.train_kmeans(cluster_input(spark, d), 4, 15)
    res = materialize(res.withColumn("vec", vector_to_array("features")))
    db = evaluate.davies_bouldin(res, "cluster", "vec")
    ch = evaluate.calinski_harabasz(res, "cluster", "vec")
    sil = cluster.silhouette(res)
    return db.crossJoin(ch).withColumn("Silhouette_SqEuclidean", F.lit(sil))


@query
def optimal_k(spark, d):
    """M4: silhouette for k = 2..6."""
    rows = cluster.find_optimal_k(cluster_input(spark, d), 6, 15)
    return spark.createDataFrame([(k, float(s)) for k, s in rows], "k int, Silhouette double")


@query
def gmm_segments(spark, d):
    """M6: 4 full-covariance components, best of 3 starts."""
    res, _ = cluster.train_gmm(cluster_input(spark, d), 4, 3)
    return res.select("ID_NOTICE", "cluster", "probability")


@query
def gmm_diag_segments(spark, d):
    """M6: 4 components with diagonal covariances, the reference's default form, best of 3 starts."""
    x = cluster_input(spark, d).withColumn("vec", vector_to_array("features"))
    res, _ = cluster.train_gmm_diag(x, len(CLUSTER_NUMERIC), 4, 3)
    return res.select("ID_NOTICE", "cluster", "probability")


@query
def gmm_diag_moments(spark, d):
    """M6, diagonal: moments of the mixture, and whether each step raised the likelihood."""
    x = cluster_input(spark, d).withColumn("vec", vector_to_array("features"))
    _, m = cluster.train_gmm_diag(x, len(CLUSTER_NUMERIC), 4, 3)
    cov = [[[v if i == j else 0.0 for j in range(len(line))] for i, v in enumerate(line)] for line in m.variances]
    t = optimality.mixture(spark, m.weights, m.means, cov, full=False, floor=1e-6)
    rising = all(b >= a - 1e-9 for a, b in zip(m.history, m.history[1:]))
    return t.select(F.col("I").alias("Feature"), "Mean", "Moment", F.lit(rising).alias("Monotone"))


@query
def gmm_moments(spark, d):
    """M6, full: second moments of the mixture, per pair of features."""
    _, m = cluster.train_gmm(cluster_input(spark, d), 4, 3)
    return optimality.mixture(spark, list(m.weights), [g.mean.toArray().tolist() for g in m.gaussians], [g.cov.toArray().tolist() for g in m.gaussians])


@query
def kmeans_moments(spark, d):
    """M3: the data's second moments split between and within the segments; nearest centroids."""
    res, model = cluster.train_kmeans(cluster_input(spark, d), 4, 15)
    centers = sorted(c.tolist() for c in model.clusterCenters())
    return optimality.kmeans(res.withColumn("vec", vector_to_array("features")), centers)


@query
def pca_projection(spark, d):
    """2-D projection of the k-means segments, every row."""
    res, _ = cluster.train_kmeans(cluster_input(spark, d), 4, 15)
    proj, _, _ = cluster.pca_2d(res)
    return proj.select("ID_NOTICE", "cluster", "PC1", "PC2")


@query
def pca_explained(spark, d):
    """Explained variance of both components, and what makes them principal axes."""
    x = cluster_input(spark, d).withColumn("cluster", F.lit(0))
    proj, ratio, loadings = cluster.pca_2d(x)
    return optimality.components(proj, ratio, loadings)


@query
def dbscan_clusters(spark, d):
    """M5: density clusters (eps 0.5, min 30 points) over every notice; no row cap."""
    x = cluster_input(spark, d).withColumn("vec", vector_to_array("features"))
    res = dbscan.dbscan(x.select("_row_pos", "ID_NOTICE", "vec"), "_row_pos", "vec",
                        dim=len(CLUSTER_NUMERIC), eps=0.5, min_samples=30)
    return res.select("ID_NOTICE", "cluster")


@query
def dbscan_noise(spark, d):
    """M5 + P9: which notices belong to no density cluster."""
    return dbscan_clusters(spark, d).select("ID_NOTICE", (F.col("cluster") == -1).alias("Noise"))

