"""Removed words against brute force over all windows."""

import hashlib
import random

import pytest

from noticeflow.llm import phrases
from noticeflow.llm.queries import op11_substring_dedup


def brute(rows, n=13):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key, at = tuple(w[k:k + n]), float("inf") if i is None else i
            first[key] = min(first.get(key, at), at)
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (float("inf") if i is None else i):
                gone[k:k + n] = b"\x01" * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def say(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_planted_passages(spark, shard_bytes):
    rng = random.Random(11)
    shared = [say(rng, k) for k in (12, 13, 14, 40, 200)]
    texts = [None, "", " ", "one", say(rng, 12), "a " * 40, "a " * 12, "b a " * 30, "A " * 40, shared[3] + "\t\n" + shared[3]]
    for _ in range(120):
        t = say(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(shared).split()
            a = rng.randint(0, max(0, len(w) - 13))
            t += " " + rng.choice([" ", "\n", "\x0b "]).join(w[a:a + rng.randint(8, len(w))]) + " " + say(rng, rng.randint(0, 30))
        texts.append(t)
    texts += [texts[20], texts[21] + " x", "y " + texts[21], texts[30], "é ü " * 20, "é ü " * 20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    # repeated rows, two texts under one id, rows without id
    rows += [rows[3], rows[3], (40, texts[50]), (40, say(rng, 20) + " " + shared[4]), (None, shared[4] + " end"), (None, say(rng, 30)), (None, texts[60])]
    rows += [(None, rows[-2][1]), (-5, shared[3])]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, doc string, shard int, id int").repartition(5)
    got = phrases.digest(phrases.dedup(df, shard_bytes=shard_bytes))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert phrases.dedup(df.limit(0)).count() == 0


def test_other_sizes_and_id_types(spark):
    rng = random.Random(2)
    rows = [(i, say(rng, 30, 6)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id smallint, text string")
    for n in (2, 5, 6):
        got = phrases.digest(phrases.dedup(df, size=n, shard_bytes=500))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, n)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, d):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_substring_dedup(spark, d).collect()), key=str) == brute(rows)
