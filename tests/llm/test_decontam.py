"""Decontamination: planted passages with edits, clean neighbours, odd rows, several blocks."""

import random

import numpy as np

from noticeflow.llm import decontam


def edit(rng, t, k):
    t = list(t)
    for _ in range(k):
        p, kind = rng.randrange(len(t)), rng.randrange(3)
        if kind == 0:
            t[p] = "z"
        elif kind == 1:
            t.insert(p, "z")
        else:
            del t[p]
    return "".join(t)


def brute(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        p = "".join(rng.choice("abc d") for _ in range(rng.randint(5, 40)))
        t = "".join(rng.choice("abc d") for _ in range(30)) + edit(rng, p, 3) + "ab" * 9
        got, _ = decontam.distance(decontam.signs(p), decontam.signs(t), len(p))
        assert got == brute(p, t)


def test_filter_keeps_what_alignment_accepts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(8, 60))) for i in range(30)]
    block = decontam.Block(items)
    for _ in range(120):
        i, t = rng.choice(items)
        k = rng.randint(0, 12)
        text = say(rng.randint(0, 200)) + " " + edit(rng, t, k) + " " + say(rng.randint(0, 200))
        a = decontam.signs(text)
        want = {block.owner[x] for x, p in enumerate(block.patterns) if block.owner[x] == i
                and brute("".join(map(chr, p)), text) <= min(decontam.budget(p.size), (p.size - decontam.Q) // decontam.Q)}
        assert want <= block.search(text).keys()
        assert set(block.search(text)) <= {i}, (k, a.size)
    assert np.all(block.bound >= 1)


def test_passages_cut_at_every_offset():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for m in (41, 59, 60, 79, 80, 95, 119, 120, 179, 180, 239, 394):
        item = say(100)[:m - 1] + "q"
        block, n = decontam.Block([(1, item), (2, say(40))]), decontam.least_passage(m)
        assert n <= 89 and (m < 80 or n <= 0.75 * m)
        for at in range(m - n + 1):
            text = decontam.fold(say(30) + " zz" + item[at:at + n].strip() + "zz " + say(30))
            if len(item[at:at + n].strip()) == n:
                assert block.search(text).keys() == {1}, (m, at)
        # edited whole items are found as before
        k = decontam.budget(m) if m <= 179 else 0
        if k <= (m - decontam.Q) // decontam.Q:
            assert 1 in block.search(say(9) + " " + edit(rng, item, k) + " " + say(9))


def test_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog tonight", "x"), (2, None, "x"), (3, "  ", "x"), (4, "Tiny one", "x"),
                                   (4, "another   item of forty signs, or rather more", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "so THE quick  brown\nfox jumps over the lazy dog tonight.", 7), (2, None, 7), (3, "", 7), (4, "a tiny one.", 7),
                                  (5, "another item of forty sings, or rather more", 7), (5, "another item of forty sings, or rather more", 7), (6, "tinyone", 7),
                                  (None, "clean", 7)], "doc_id long, text string, item_id int")
    want = [(1, 1), (4, 4), (5, 4), (5, 4)]
    for size in (decontam.BLOCK, 10):
        monkeypatch.setattr(decontam, "BLOCK", size)
        assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()) == want
    assert sorted(str(r.doc_id) for r in decontam.clean(docs, bench).collect()) == ["2", "3", "6", "None"]
    assert decontam.matches(docs, bench.limit(0)).count() == 0
    assert decontam.matches(docs.limit(0), bench).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_verbatim_items_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    from noticeflow.llm.queries import op8_decontamination
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, decontam.fold(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in docs for t in [decontam.fold(r.text)] for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, d).collect()}
    assert want and want <= got and len(got) <= len(want) + 2
