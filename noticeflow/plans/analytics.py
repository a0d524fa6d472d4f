"""Query registry, part 2: profiles, dictionaries, audits, chart tables and
evaluation metrics (SQL-checkable), plus the model queries (rows-only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import evaluate, merge, profile, tables
from noticeflow.operators.audit import stage01_audit
from noticeflow.operators.clean import INPUT_LOG_COLS, INPUT_STANDARD_COLS
from noticeflow.plans import queries as base
from noticeflow.plans import pipeline as pl
from noticeflow.sources import fixtures

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Column groups of the analysis scripts.
CLUSTER_NUMERIC = ["TARGET_AWARD_VALUE_EUR", "LOTS_NUMBER", "PREPARATION_DAYS",
                   "NUTS_REGION_COUNT", "NUMBER_OF_TENDERS"]
GOLDEN_CATEGORICAL = ["ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "TOP_TYPE", "CPV",
                      "ID_TYPE", "TYPE_OF_CONTRACT", "CRIT_CODE"]
CORR_COLS = ["TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR", "ESTIMATED_VALUE_EUR",
             "NUMBER_OF_TENDERS", "DURATION", "PREPARATION_DAYS", "NUTS_LEVEL", "LOTS_NUMBER"]


def golden(spark, d) -> DataFrame:
    """Stage 05 output with the capped columns rounded to 4 places."""
    return base._rounded(base.golden(spark, d), INPUT_LOG_COLS + INPUT_STANDARD_COLS)


@query
def profile_minimal(spark, d):
    """S4 on the cleaned golden table (exact distinct counts)."""
    return profile.profile_minimal(golden(spark, d), exact=True).drop("Type")


@query
def profile_spread(spark, d):
    """Quartiles and the top value of every column (exact form)."""
    t = profile.profile_spread(golden(spark, d), CORR_COLS + GOLDEN_CATEGORICAL, exact=True)
    return t.select("Column", *[profile.sig(F.col(c)).alias(c) for c in ("Q25", "Median", "Q75")], "Top", "Top_Count")


@query
def profile_histogram(spark, d):
    return profile.histogram(golden(spark, d), CORR_COLS, bins=10)


@query
def profile_topk(spark, d):
    return profile.top_values(golden(spark, d), GOLDEN_CATEGORICAL, k=5)


@query
def profile_corr(spark, d):
    return profile.correlations(golden(spark, d), CORR_COLS)


@query
def encoding_dictionary(spark, d):
    """Code <-> value per categorical feature of the cleaned table."""
    return tables.encoding_dictionary(golden(spark, d), GOLDEN_CATEGORICAL)


@query
def pipeline_audit(spark, d):
    """Stage 01 step counts of both tables."""
    return stage01_audit(fixtures.cfc(spark, d), "CFC") \
        .unionByName(stage01_audit(fixtures.can(spark, d), "CAN"))


@query
def stage_audit(spark, d):
    """A14, stages 02-05: rows kept, gaps filled and values capped per step, observed while the stages are written."""
    return pl.audited_stages(spark, d)


@query
def silhouette_euclidean(spark, d):
    """Silhouette with the reference's Euclidean distance, on a hash sample of 2,000 rows."""
    return evaluate.silhouette_euclidean(_embeddings(spark, d), "label", "embedding", sample=2000, key="vec_id")


@query
def join_fanout(spark, d):
    """The 20 (notice, lot) keys with the largest merge fan-out."""
    p = pl.stage02(spark, d)
    return merge.join_fanout(p.cfc, p.can, 20)


@query
def cluster_category_share(spark, d):
    """Country share within each contract type (top 10 countries)."""
    return tables.category_share(golden(spark, d), "TYPE_OF_CONTRACT", "ISO_COUNTRY_CODE", 10)


@query
def cluster_boxplot(spark, d):
    """Box-plot table per contract type and clustering feature."""
    return tables.cluster_boxplot(golden(spark, d), "TYPE_OF_CONTRACT", CLUSTER_NUMERIC)


@query
def deviation_target(spark, d):
    """P8 + F18 on the first row of each notice."""
    g = base.notice_first_row(spark, d)
    r = g.where((F.col("TARGET_AWARD_VALUE_EUR") > 0) & (F.col("ESTIMATED_VALUE_EUR") > 0))
    ratio = F.col("TARGET_AWARD_VALUE_EUR") / F.col("ESTIMATED_VALUE_EUR")
    return r.select("ID_NOTICE", profile.sig(ratio).alias("TARGET_BUDGET_DEVIATION_RATIO"),
                    profile.sig(F.ln(ratio)).alias("LOG_DEVIATION"))


# ------------------------------------------------- evaluation on driver tables

def _regression_input(spark, d) -> DataFrame:
    li = fixtures.read_table(spark, d, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))


def _scored_docs(spark, d) -> DataFrame:
    lab = fixtures.read_table(spark, d, "labels").select("doc_id", "quality")
    doc = fixtures.read_table(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"),
                    (F.col("n_chars") >= 3000).cast("int").alias("pred"))


@query
def regression_metrics(spark, d):
    return evaluate.regression_metrics(_regression_input(spark, d), "y", "p", n_features=6)


@query
def regression_density(spark, d):
    return evaluate.regression_density(_regression_input(spark, d), "y", "p", 50)


@query
def classification_report(spark, d):
    return evaluate.classification_report(_scored_docs(spark, d), "y", "pred")


@query
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_scored_docs(spark, d), "y", "pred")


@query
def average_precision(spark, d):
    return evaluate.average_precision(_scored_docs(spark, d), "y", "score")


@query
def roc_auc(spark, d):
    return evaluate.roc_auc(_scored_docs(spark, d), "y", "score")


@query
def pr_curve(spark, d):
    return evaluate.pr_curve(_scored_docs(spark, d), "y", "score")


def _embeddings(spark, d) -> DataFrame:
    return fixtures.read_table(spark, d, "embeddings")


@query
def davies_bouldin(spark, d):
    return evaluate.davies_bouldin(_embeddings(spark, d), "label", "embedding")


@query
def calinski_harabasz(spark, d):
    return evaluate.calinski_harabasz(_embeddings(spark, d), "label", "embedding")


@query
def silhouette_sample(spark, d):
    """Squared-Euclidean silhouette over all labelled vectors (exact)."""
    return evaluate.silhouette_sqeuclidean(_embeddings(spark, d), "label", "embedding")
