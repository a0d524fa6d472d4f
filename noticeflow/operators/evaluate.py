"""Model evaluation as aggregations.

Every metric is an aggregate over the whole prediction table; no rows of it
reach the driver. Curves and rank statistics use the distributed running
sums of ``ordered.running_sums`` over *distinct* scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered
from noticeflow.operators.profile import sig
from noticeflow.operators.split import hash_sample
from noticeflow.session import materialize


def regression_metrics(df: DataFrame, y: str, p: str, n_features: int,
                       transform: str | None = None) -> DataFrame:
    """E1 + F19: MedAE, MAE, RMSE, R2 and adjusted R2 (one row).

    ``transform``: ``'ratio'`` back-transforms both columns with ``exp``,
    ``'money'`` with ``expm1`` (log-space predictions)."""
    yt, yp = F.col(y).cast("double"), F.col(p).cast("double")
    if transform == "ratio":
        yt, yp = F.exp(yt), F.exp(yp)
    elif transform == "money":
        yt, yp = F.expm1(yt), F.expm1(yp)
    t = df.select(yt.alias("_y"), yp.alias("_p")).where(F.col("_y").isNotNull()
                                                        & F.col("_p").isNotNull())
    t = t.withColumn("_ae", F.abs(F.col("_y") - F.col("_p")))
    m = t.agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_my"))
    s = t.crossJoin(F.broadcast(m)).agg(
        F.first("_n").alias("_n"), F.avg("_ae").alias("_mae"),
        F.avg(F.col("_ae") * F.col("_ae")).alias("_mse"),
        F.sum(F.col("_ae") * F.col("_ae")).alias("_ssr"),
        F.sum((F.col("_y") - F.col("_my")) * (F.col("_y") - F.col("_my"))).alias("_sst"))
    med = ordered.quantile_table(t, ["_ae"], [0.5]).select(
        F.col(ordered.qname(0.5)).alias("_medae"))
    r2 = F.when(F.col("_sst") > 0, 1.0 - F.col("_ssr") / F.col("_sst"))
    n = F.col("_n").cast("double")
    adj = 1.0 - (1.0 - r2) * (n - 1.0) / (n - float(n_features) - 1.0)
    return s.crossJoin(F.broadcast(med)).select(
        sig(F.col("_medae")).alias("MedAE"), sig(F.col("_mae")).alias("MAE"),
        sig(F.sqrt("_mse")).alias("RMSE"), sig(r2).alias("R2"), sig(adj).alias("Adj_R2"))


def _label_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).cast("int").alias("_y"), F.col(p).cast("int").alias("_p")) \
             .agg(F.count(F.lit(1)).alias("_c"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts for every (actual, predicted) label pair, zeros included."""
    pairs = _label_pairs(df, y, p)
    labels = pairs.select(F.col("_y").alias("_l")).union(pairs.select("_p")).distinct()
    grid = labels.select(F.col("_l").alias("Actual")).crossJoin(
        F.broadcast(labels.select(F.col("_l").alias("Predicted"))))  # #classes^2 rows
    return grid.join(pairs.withColumnRenamed("_y", "Actual").withColumnRenamed("_p", "Predicted"),
                     ["Actual", "Predicted"], "left") \
               .select("Actual", "Predicted", F.coalesce("_c", F.lit(0)).cast("bigint").alias("Count"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class precision/recall/F1/support, macro and weighted averages,
    accuracy (zero division gives 0, as in the usual report)."""
    cm = confusion_matrix(df, y, p)
    per = cm.groupBy(F.col("Actual").alias("_l")).agg(
        F.sum(F.when(F.col("Actual") == F.col("Predicted"), F.col("Count")).otherwise(0)).alias("_tp"),
        F.sum("Count").alias("_sup"))
    pred = cm.groupBy(F.col("Predicted").alias("_l")).agg(F.sum("Count").alias("_pp"))
    t = per.join(pred, "_l")

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    prec, rec = div(F.col("_tp"), F.col("_pp")), div(F.col("_tp"), F.col("_sup"))
    t = t.select("_l", "_tp", "_sup", prec.alias("_pr"), rec.alias("_rc")) \
         .withColumn("_f1", div(2 * F.col("_pr") * F.col("_rc"), F.col("_pr") + F.col("_rc")))
    classes = t.select(F.col("_l").cast("string").alias("Label"), sig(F.col("_pr")).alias("Precision"),
                       sig(F.col("_rc")).alias("Recall"), sig(F.col("_f1")).alias("F1"),
                       F.col("_sup").cast("bigint").alias("Support"))
    a = t.agg(F.avg("_pr").alias("mp"), F.avg("_rc").alias("mr"), F.avg("_f1").alias("mf"),
              (F.sum(F.col("_pr") * F.col("_sup")) / F.sum("_sup")).alias("wp"),
              (F.sum(F.col("_rc") * F.col("_sup")) / F.sum("_sup")).alias("wr"),
              (F.sum(F.col("_f1") * F.col("_sup")) / F.sum("_sup")).alias("wf"),
              F.sum("_tp").alias("tp"), F.sum("_sup").cast("bigint").alias("n"))
    names = ["Label", "Precision", "Recall", "F1", "Support"]
    rows = [("macro avg", "mp", "mr", "mf"), ("weighted avg", "wp", "wr", "wf")]
    arr = [F.struct(F.lit(lbl).alias("Label"), sig(F.col(x)).alias("Precision"),
                    sig(F.col(r)).alias("Recall"), sig(F.col(f)).alias("F1"),
                    F.col("n").alias("Support")) for lbl, x, r, f in rows]
    acc = sig(F.col("tp").cast("double") / F.col("n").cast("double"))
    arr.append(F.struct(F.lit("accuracy").alias("Label"), F.lit(None).cast("double").alias("Precision"),
                        F.lit(None).cast("double").alias("Recall"), acc.alias("F1"),
                        F.col("n").alias("Support")))
    return classes.unionByName(a.select(F.inline(F.array(*arr))).select(*names))


def _score_groups(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row per distinct score: positives and total count."""
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.col(y).cast("bigint")).alias("_pos"), F.count(F.lit(1)).alias("_cnt"))


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """E5: precision and recall when predicting positive for score >= threshold,
    one row per distinct score (Threshold, Precision, Recall)."""
    g = _score_groups(df, y, score)
    tot = g.agg(F.sum("_pos").alias("_P"))
    rs = ordered.running_sums(g, [F.desc("_s")], ["_pos", "_cnt"])
    j = rs.crossJoin(F.broadcast(tot))
    return j.select(F.col("_s").alias("Threshold"),
                    sig(F.col("_pos_cum") / F.col("_cnt_cum")).alias("Precision"),
                    sig(F.try_divide(F.col("_pos_cum").cast("double"), F.col("_P").cast("double")))
                    .alias("Recall"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Average precision, sum over thresholds of (R_n - R_n-1) P_n."""
    g = _score_groups(df, y, score)
    rs = ordered.running_sums(g, [F.desc("_s")], ["_pos", "_cnt"])
    a = rs.agg(F.sum(F.col("_pos") * F.col("_pos_cum") / F.col("_cnt_cum")).alias("_num"),
               F.sum("_pos").alias("_P"))
    return a.select(sig(F.try_divide(F.col("_num"), F.col("_P").cast("double")))
                    .alias("Average_Precision"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC AUC = P(score_pos > score_neg) + 0.5 P(tie), from running
    counts of negatives below each distinct score."""
    g = _score_groups(df, y, score).withColumn("_neg", F.col("_cnt") - F.col("_pos"))
    rs = ordered.running_sums(g, ["_s"], ["_neg"])
    a = rs.agg(F.sum(F.col("_pos") * (F.col("_neg_cum") - F.col("_neg") * 0.5)).alias("_u"),
               F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return a.select(sig(F.try_divide(F.col("_u"), (F.col("_P") * F.col("_N")).cast("double")))
                    .alias("ROC_AUC"))


def regression_density(df: DataFrame, y: str, p: str, bins: int = 50) -> DataFrame:
    """2-D histogram of actual vs predicted on a shared square grid."""
    t = df.select(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")) \
          .where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    r = t.agg(F.least(F.min("_y"), F.min("_p")).alias("_lo"),
              F.greatest(F.max("_y"), F.max("_p")).alias("_hi"))
    j = t.crossJoin(F.broadcast(r))
    w = F.col("_hi") - F.col("_lo")

    def b(c: Column) -> Column:
        return F.when(w > 0, F.least(F.floor((c - F.col("_lo")) / w * bins), F.lit(bins - 1))) \
                .otherwise(F.lit(0)).cast("int")
    return j.groupBy(b(F.col("_y")).alias("Bin_Actual"), b(F.col("_p")).alias("Bin_Predicted")) \
            .agg(F.count(F.lit(1)).alias("Count"))


# ----------------------------------------------------------- clustering

def _centroids(points: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, n, centroid array<double>) from an array column: one vector of
    sums per label and task, combined before the shuffle."""
    cent = points.select(F.col(label).alias("_l"), _vector(vec).alias("_x")).groupBy("_l") \
                 .agg(Summarizer.mean(F.col("_x")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    # k rows, read several times: written once so the points are scanned once
    return materialize(cent.select("_l", vector_to_array("_c").alias("_c"), "_n"))


def _vector(vec: str) -> Column:
    return array_to_vector(F.transform(vec, lambda x: x.cast("double")))


def _dim(cent: DataFrame) -> int:
    """Vector length, read from the materialised k-row centroid table (no
    extra pass over the points): lets distances be written per index."""
    return int(cent.select(F.max(F.size("_c"))).first()[0] or 0)


def _sqdist(a: Column, b: Column, dim: int) -> Column:
    """Squared distance as explicit per-index arithmetic (codegen-compiled,
    unlike a higher-order lambda), summed left to right."""
    def t(i):
        d = a[i].cast("double") - b[i].cast("double")
        return d * d
    return sum((t(i) for i in range(1, dim)), t(0))


def davies_bouldin(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Davies-Bouldin index on the full table (noise label -1 removed).

    Centroids (one row per cluster) are joined back to the points; the pairwise
    part runs over the k x k centroid table only."""
    pts = df.where(F.col(label) != -1)
    cent = _centroids(pts, label, vec)
    dim = _dim(cent)
    # as many centroids as there are clusters: adaptive execution broadcasts them if they are few
    j = pts.join(cent, pts[label] == cent["_l"])
    s = j.groupBy("_l").agg(F.avg(F.sqrt(_sqdist(F.col(vec), F.col("_c"), dim))).alias("_s"))
    c2 = cent.join(s, "_l")
    a, b = c2.alias("a"), c2.alias("b")
    pair = a.crossJoin(F.broadcast(b)).where(F.col("a._l") != F.col("b._l"))  # k^2 rows
    ratio = (F.col("a._s") + F.col("b._s")) / F.sqrt(_sqdist(F.col("a._c"), F.col("b._c"), dim))
    worst = pair.groupBy(F.col("a._l").alias("_l")).agg(F.max(ratio).alias("_r"))
    return worst.agg(F.coalesce(sig(F.avg("_r")), F.lit(-1.0)).alias("Davies_Bouldin"))  # below two clusters: -1


def calinski_harabasz(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Calinski-Harabasz index on the full table (noise removed)."""
    pts = df.where(F.col(label) != -1)
    cent = _centroids(pts, label, vec)
    dim = _dim(cent)
    overall = pts.select(_vector(vec).alias("_x")).agg(Summarizer.mean(F.col("_x")).alias("_g")) \
                 .select(vector_to_array("_g").alias("_g"))
    # as many centroids as there are clusters: adaptive execution broadcasts them if they are few
    j = pts.join(cent, pts[label] == cent["_l"])
    w = j.agg(F.sum(_sqdist(F.col(vec), F.col("_c"), dim)).alias("_w"),
              F.count(F.lit(1)).alias("_n"))
    bt = cent.crossJoin(F.broadcast(overall)).agg(
        F.sum(F.col("_n") * _sqdist(F.col("_c"), F.col("_g"), dim)).alias("_b"),
        F.count(F.lit(1)).alias("_k"))
    r = w.crossJoin(bt)
    ch = (F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))
    return r.select(F.coalesce(sig(F.when(F.col("_k") >= 2, ch)), F.lit(-1.0)).alias("Calinski_Harabasz"))


def silhouette_sqeuclidean(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact on the full
    table in linear time (no pairs): the mean squared distance from x to a
    cluster C is ``|x|^2 - 2 x.mu_C + mean_C |y|^2``. Own-cluster distance
    excludes the point itself (``* n / (n - 1)``); singletons score 0.
    The k cluster summaries ride along as one broadcast row."""
    pts = df.where(F.col(label) != -1).select(
        F.col(label).alias("_l"), F.transform(vec, lambda x: x.cast("double")).alias("_x"))
    pts = pts.withColumn("_x2", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))
    cent = _centroids(pts.withColumnRenamed("_l", "_lab"), "_lab", "_x")
    m2 = pts.groupBy("_l").agg(F.avg("_x2").alias("_m2"))
    summ = cent.join(m2, "_l").agg(F.collect_list(F.struct("_l", "_n", "_c", "_m2")).alias("_cs"))
    j = pts.crossJoin(F.broadcast(summ))  # one row holding k summaries
    dist = F.transform("_cs", lambda c: F.struct(
        c["_l"].alias("l"), c["_n"].alias("n"),
        (F.col("_x2") - 2.0 * F.aggregate(F.zip_with(F.col("_x"), c["_c"], lambda a, b: a * b),
                                          F.lit(0.0), lambda s, v: s + v) + c["_m2"]).alias("d")))
    j = j.withColumn("_d", dist)
    own = F.filter("_d", lambda c: c["l"] == F.col("_l"))[0]
    others = F.filter("_d", lambda c: c["l"] != F.col("_l"))
    a = F.try_divide(own["d"] * own["n"].cast("double"), (own["n"] - 1).cast("double"))
    b = F.array_min(F.transform(others, lambda c: c["d"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).when(a < b, 1.0 - a / b).when(a > b, b / a - 1.0) \
         .otherwise(F.lit(0.0))
    return j.agg(sig(F.avg(s)).alias("Silhouette_SqEuclidean"))


#: Points per block of the pairwise sums.
PAIR_BLOCK = 512


def silhouette_euclidean(df: DataFrame, label: str, vec: str, sample: int, key: str, seed: int = 42) -> DataFrame:
    """Mean silhouette with Euclidean distance over ``min(sample, rows)``
    hash-sampled rows (noise label -1 removed; below two clusters -1).

    The mean distance to a cluster needs every pair of points. Points are packed
    into blocks; a row of the join is a pair of *blocks*, for which numpy adds up
    each point's distances per cluster, so no pair of points is ever a row. Work is
    quadratic in ``sample``, which the caller bounds, and spread over block pairs."""
    pts = hash_sample(df.where(F.col(label) != -1).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_l"),
                                                          F.transform(vec, lambda x: x.cast("double")).alias("_x")), sample, "_id", seed)
    pts = materialize(pts)
    blocks = max(1, -(-pts.count() // PAIR_BLOCK))
    packed = materialize(pts.groupBy(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct("_id", "_l", "_x")).alias("_p")))
    left = packed.select(F.col("_p").alias("_pl"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))

    def points(col) -> tuple[list, np.ndarray, np.ndarray]:
        return [p["_id"] for p in col], np.array([p["_l"] for p in col], np.int64), np.array([p["_x"] for p in col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, own, x = points(one)
                _, theirs, y = points(other)
                names, place = np.unique(theirs, return_inverse=True)
                sums = np.array([np.bincount(place, np.sqrt(((y - v) ** 2).sum(1)), names.size) for v in x])
                n = np.bincount(place, minlength=names.size)
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in names], b.schema[0].type.value_type.field("_id").type),
                                                  pa.array(np.repeat(own, names.size)), pa.array(np.tile(names, k)), pa.array(sums.ravel()), pa.array(np.tile(n, k))],
                                                 names=["_id", "_l", "_c", "_d", "_n"])

    kind = pts.schema["_id"].dataType.simpleString()
    part = left.join(packed, "_b").select("_pl", "_p").mapInArrow(run, f"_id {kind}, _l long, _c long, _d double, _n long")
    per = part.groupBy("_id", "_l", "_c").agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    mine = F.col("_l") == F.col("_c")
    each = per.groupBy("_id").agg(F.max(F.when(mine, F.col("_n"))).alias("n"), F.max(F.when(mine & (F.col("_n") > 1), F.col("_d") / (F.col("_n") - 1))).alias("a"),
                                  F.min(F.when(~mine, F.col("_d") / F.col("_n"))).alias("b"))
    s = F.when((F.col("n") <= 1) | (F.col("a") == F.col("b")), 0.0).when(F.col("a") < F.col("b"), 1.0 - F.col("a") / F.col("b")).otherwise(F.col("b") / F.col("a") - 1.0)
    return each.agg(F.when(F.count("b") > 0, sig(F.avg(s))).otherwise(F.lit(-1.0)).alias("Silhouette_Euclidean"))
