"""Cuts against an exhaustive search; contract of rows, slots and atomic groups."""

import random
import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from noticeflow.llm import shards
from noticeflow.llm.queries import op5_sharding


def best(sizes, n):
    """Smallest largest shard of all contiguous partitions, by dynamic programming."""
    inf = float("inf")
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    row = [0] + [inf] * len(sizes)
    for _ in range(n):
        row = [min([row[k]] + [max(row[j], prefix[k] - prefix[j]) for j in range(k)]) for k in range(len(sizes) + 1)]
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_capacity_is_smallest(spark, seed, monkeypatch):
    monkeypatch.setattr(shards, "FIRST", 1)
    monkeypatch.setattr(shards, "MORE", 1)
    rng = random.Random(seed)
    rows = [(f"t{k}" * rng.choice([1, 3, 30]),) for k in range(150)]
    rows += [rows[4]] * 9 + [("x" * 3000,)] * seed
    df = spark.createDataFrame([(i, t, 0) for i, (t,) in enumerate(rows)], "doc_id long, text string, slot int")
    for n in (1, 3, 7):
        out = shards.assign(df, n).collect()
        by, total, slots = defaultdict(int), defaultdict(int), defaultdict(list)
        for (t,) in rows:
            by[md5(t.encode()).hexdigest()] += len(t) + 16
        where = {}
        for r in out:
            total[r.shard] += r.size
            slots[r.shard].append(r.slot)
            assert where.setdefault(rows[r.doc_id][0], r.shard) == r.shard
        assert max(total.values()) == best([by[k] for k in sorted(by)], n)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(n))


def test_whole_table_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    out = op5_sharding(spark, d).collect()
    total = defaultdict(int)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r.size
    assert len(out) == len(texts) and set(total) == set(range(40))
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "é")], "doc_id long, text string")
    rows = shards.assign(odd).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == [(16, 0), (16, 0), (16, 0), (18, zlib.crc32("é".encode()))]
    assert shards.assign(odd.limit(0)).count() == 0
