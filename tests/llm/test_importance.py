"""Weights, scores and draws against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from noticeflow.llm import importance
from noticeflow.llm.queries import op12_importance_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[k:k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def expected(docs, target, n=1, buckets=10_000, least=20, percent=10):
    def bags(texts):
        found = [(w, [zlib.crc32(g.encode()) % buckets for g in f]) for w, f in (grams(t, n) for t in texts)]
        return found, Counter(b for _, f in found for b in f)
    found, s = bags(t for _, t in docs)
    _, t = bags(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (w, f) in zip(docs, found):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    out = []
    for k, r in enumerate(able):
        out.append((*r[:4], k + 1 if k < percent * len(able) // 100 else None))
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=str)


def test_rows(spark):
    rng = random.Random(8)
    vocabulary = ["Apple", "apple", "b2b", "é", "naïve", "x", "日本", "don", "A-Z", "a_b", "t.co/1"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n\n", "_", "\x7f", " "]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 60))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, "--"), (None, say(30)), (3, docs[3][1]), (4, say(40)), (203, "word " * 5000)]
    target = [say(12), None, "apple é"]
    df = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, id string, score int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for n, buckets in ((1, 10_000), (3, 50)):
        got = importance.resample(df, wanted, max_n=n, buckets=buckets)
        assert sorted(map(tuple, got.collect()), key=str) == expected(docs, target, n, buckets)
    assert importance.resample(df.limit(0), wanted).count() == 0
    none = importance.resample(df, wanted.limit(0))
    assert sorted(map(tuple, none.collect()), key=str) == expected(docs, [])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, op12_importance_resampling(spark, d).collect()), key=str) == expected(docs, target)
