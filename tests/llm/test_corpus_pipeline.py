"""The stages in a row: columns, decisions that take effect, clashing names."""

import corpus_pipeline
from noticeflow.llm import decontam, jaccard
from noticeflow.llm.decontam import fold

D = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumnRenamed("source", "base")
    before, texts = docs.count(), None
    items = [fold(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.checkpointed(stage(spark, docs, D))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == len({r.doc_id for r in rows}) <= before
        if name == "quality_rules":
            assert all(len((r.text or "").split()) >= 50 for r in rows) and len(rows) > before // 2
        if name == "ngram_jaccard_join":
            assert len({r.text for r in rows}) == len(rows)
        if name == "benchmark_decontamination":
            assert not any(x in fold(r.text) for r in rows for x in items)
            texts = {r.doc_id: r.text for r in rows}
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in rows) and {r.doc_id for r in rows} == set(texts)
            assert not any("@mail" in r.text for r in rows)
        before, docs = len(rows), out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() == before


def test_rows_under_null_and_repeated_ids(spark):
    item = "the quick brown fox jumps over the lazy dog tonight and never comes back"
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    a, b, c, d, near, e = say(1), say(2), say(3), say(4), say(4) + " more", say(5)
    rows = [(None, a), (None, b), (7, c), (7, item + " " + e), (None, item), (1, d), (None, near), (2, near), (7, c), (None, ""), (None, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [tuple(r) for r in decontam.clean(docs, bench).collect()]
    assert sorted(clean, key=str) == sorted((r for r in rows if item not in r[1]), key=str)
    left = [tuple(r) for r in jaccard.representatives(docs).collect()]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (7, c), (7, item + " " + e), (None, item), (1, d), (None, ""), (None, ""), (9, "")], key=str)
