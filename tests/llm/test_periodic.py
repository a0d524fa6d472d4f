"""Runs against brute force over all periods and starts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from noticeflow.llm import periodic
from noticeflow.llm.queries import op13_periodic_runs


def brute(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                length = j + q - i
                seg = w[i:i + length]
                smaller = any(all(seg[x] == seg[x + p] for x in range(length - p)) for p in range(1, q))
                if length >= max(least, times * q) and not smaller:
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(400):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 5, 50])
        w = [rng.randint(0, k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 2 else 0):
            p, a = rng.randint(1, 12), rng.randint(0, n - 1)
            base = w[a:a + p]
            for i in range(a, rng.randint(a, n)):
                w[i] = base[(i - a) % len(base)]
        for least, times in ((6, 4), (6, 3), (12, 4), (30, 4)):
            assert periodic.find_runs(np.array(w, np.int64), least, times) == brute(w, least, times)


def test_long_and_wrong():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    w = np.tile(np.arange(1000), 50)
    assert periodic.find_runs(w) == [(0, 50_000, 1000)]
    with pytest.raises(ValueError):
        periodic.find_runs(w, 6, 2)


def test_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b\ta\x0bb y", "é ü " * 9, "a b " * 7, "A a " * 5]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(5, "a a a a a a", "k", 2), (5, "b c " * 4, "k", 2), (None, "a " * 9, "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, runs int").repartition(3)
    got = sorted(periodic.digest(periodic.collapse(periodic.planted(df))).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    out = periodic.collapse(df.where("doc_id = 6")).first()
    assert out.n_words == 12 and out.collapsed == "x a b y" and [tuple(r) for r in out.runs] == [(1, 10, 2)]
    assert periodic.digest(periodic.collapse(periodic.planted(df.limit(0)))).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 8_000]
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, d).collect()}
    assert len(got) == len(rows)
    for i, t in short:
        assert got[i] == expected(i, t)
