"""Rows that once broke an operator: hot groups, great ids, odd markup, very long texts."""

import resource
import time

from pyspark.sql import functions as F

from noticeflow.llm import chat, decontam, html, pii, quality, shards, toxicity


def test_shards_beside_a_large_group(spark):
    rows = [(i, "hot " * 40 if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.assign(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("k")).collect()
    assert {r.shard for r in out} == set(range(40))
    assert all(r.n == r.k == r.top + 1 for r in out)
    largest = sorted((r.b for r in out), reverse=True)
    assert largest[0] == 1000 * (160 + 16) and largest[1] < 1.3 * sum(largest[1:]) / 39


def test_two_large_groups_and_one_row_for_a_third(spark):
    rows = [(7, "a" * 50)] * 400 + [(i, "b" * 60) for i in range(300)] + [(i, f"c{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.assign(df, shards=8)
    assert out.select("shard").distinct().count() == 8
    assert out.groupBy("shard", "text_crc32").count().groupBy("text_crc32").count().where("count > 1").isEmpty()
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count_distinct("slot")).alias("d")).where("d <> 0").isEmpty()


def test_great_conversation_ids(spark):
    big = 2**53
    rows = [(c, 1, "user", "hi") for c in (big + 2, big + 3, big + 4, -3, -2, -1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    pairs = {(r.pair_id, r.side) for r in chat.neighbours(df).collect()}
    assert pairs == {(big // 2 + 1, "chosen"), (big // 2 + 1, "rejected"), (big // 2 + 2, "chosen"), (-2, "rejected"), (-1, "chosen"), (-1, "rejected")}


def test_quoted_markup():
    said = lambda page: [b.text for b in html.blocks(page)]
    assert said('<img alt="a > b" src=x><a title="x>y">two</a>') == ["two"]
    assert said("<p title='it>s'>one</p><p title=it's>two</p><p class=\"open>three</p><p>four</p>") == ["one", "two", "three", "four"]
    assert said('<script data-x="</p>">var a = 1;</script><p>text</p>') == ["text"]
    start = time.time()
    assert len(said("<p>" + "<b>x</b> " * 40_000 + "</p>")[0]) == 79_999
    assert time.time() - start < 5


def test_many_matches_in_one_text(spark):
    n = 4000
    text = " ".join(f"user{i}@example{i % 9}.org" for i in range(n))
    start = time.time()
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model(), ["doc_id"]).first().base
    assert time.time() - start < 20
    assert len(found) == n and all(text[s.start:s.stop] == s.hit for s in found[::97])
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Model()).first().text
    assert clean == " ".join(["[EMAIL]"] * n)


def test_text_of_one_sign():
    index = decontam.Block([(1, "a" * 300), (2, "the quick brown fox jumps over the lazy dog and then sleeps all day long in the sun")])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert set(index.search("a" * 200_000)) == {1}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
    # a passage is found wherever it lies in a long text, also across the stretches
    for at in (0, 4000, 4090, 4096, 4500, 8190):
        text = "z x" * 3 + "q" * at + " the quick brown fox jumps over the lazy dog and then sleeps all day long in the sun " + "k" * 5000
        assert 2 in index.search(text)


def test_clean_without_a_key(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then sleeps all day long in the sun")], "item_id long, text string")
    bad = "well, the quick brown fox jumps over the lazy dog and then sleeps all day long in the sun"
    df = spark.createDataFrame([(1, bad, 2.0), (1, "fine", 1.0), (None, bad, None), (None, None, 3.0), (2, "fine", None)], "doc_id long, text string, x double")
    assert sorted(map(tuple, decontam.clean(df, bench).collect()), key=str) == sorted([(1, "fine", 1.0), (None, None, 3.0), (2, "fine", None)], key=str)
    assert decontam.clean(df, bench.limit(0)).count() == 5 and decontam.clean(df.limit(0), bench).columns == df.columns


def test_fits_take_one_text_of_a_repeated_id(spark, monkeypatch):
    rows = [(7, f"copy {i} of nothing") for i in range(600)] + [(i, f"some text number {i} here") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1)] + [(i, i % 2, i % 2) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda found, *a: seen.append(found))
    toxicity.fit(docs, labels)
    assert len(seen[0]) <= 61
    monkeypatch.setattr(quality, "learn", lambda stats, *a: seen.append(stats.count()) or [])
    quality.fit(docs, labels)
    assert seen[1] == 61
