"""Held-out accuracy, what the fit may see, odd rows."""

import zlib

from pyspark.sql import functions as F

from noticeflow.llm import toxicity

D = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_independence(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).bias == model.bias  # labels of held-out rows change nothing
    out = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    hit, false = sum(r.predicted for r in held if r.toxic), sum(r.predicted for r in held if not r.toxic)
    assert hit >= 0.7 * sum(r.toxic for r in held) and false <= 0.01 * len(held)


def test_scores_on_rows(spark):
    docs = spark.createDataFrame([(1, "a plain text", 1), (2, None, 1), (3, "", 1), (3, "", 2), (None, "x", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (1, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_score_equals_the_plain_model(spark):
    rows = [(f"{'idiot ' * (k % 3)}word{k % 7} text badword{k % 2}", int(k % 3 > 0)) for k in range(60)]
    model = toxicity.train(rows)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - model.score(rows[r.doc_id][0])) < 1e-5
