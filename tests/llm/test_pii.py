"""Base spans against Python's regular expressions; what the trees add; redaction."""

import hashlib
import random
import re

from noticeflow.llm import pii
from noticeflow.llm.queries import op2_pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".") if x),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


ODD = [None, "", "a@b", "x.y+z@h-1.co.uk, q@r.s", "a@b.c-x_y@d.e a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0255.001.0.0", "+1 (234) 555-7890 +1-2 +49 0.30 123456 ()-",
       "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "é😀 4111111111111111 😀 me@x.org", "7" * 20000, "a" * 20000, "1 " * 5000, "." * 300 + "@a.b", "+5" + "(" * 900]


def test_odd_texts_and_repeats(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, ODD[3], "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(df, pii.Model(), ["doc_id"]).collect()
    assert sorted((r.doc_id, [tuple(s)[:3] for s in r.base]) for r in got) == sorted((i, brute(t)) for i, t, _ in rows)
    assert pii.fit(df.limit(0)).limits == {}
    assert pii.digest(pii.find(df.limit(0), pii.Model(), ["doc_id"])).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    added = 0
    for r in op2_pii(spark, d).collect():
        want = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert r.spans == listed or r.spans.startswith(listed)
        for s in r.spans[len(listed):].strip(",").split(","):
            if s:
                k, a, b = s.split(":")
                added += 1
                assert k == "secret" and re.fullmatch("[0-9a-f]{40}", texts[r.doc_id][int(a):int(b)])
    assert added > 5


def test_planted_numbers_are_selected(spark, monkeypatch):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"my account {digits(4)} {digits(4)} {digits(3)} please") for i in range(80)]
    rows += [(i, f"it made {digits(11)} turns since") for i in range(80, 300)]
    rows += [(300, "card 4111 1111 1111 1111 given")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (pii.CANDIDATES, 60):
        monkeypatch.setattr(pii, "CANDIDATES", most)
        got = {r.doc_id: [tuple(s)[:4] for s in r.spans] for r in pii.find(df, pii.fit(df), ["doc_id"]).collect()}
        for i, t in rows[:300]:
            assert got[i] == ([("number", 11, 24, t[11:24])] if i < 80 else []), t
        assert [s[0] for s in got[300]] == ["card"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to me@x.org, 4111 1111 1111 1111!", "k"), (2, None, "k"), (3, "none", None)], "doc_id long, text string, base string")
    got = {r.doc_id: (r.text, r.base) for r in pii.redact(df, pii.Model()).collect()}
    assert got == {1: ("to [EMAIL], [CARD]!", "k"), 2: (None, "k"), 3: ("none", None)}
