"""Formatting of small pairs, and the query against its SQL."""

import duckdb

from noticeflow.llm import chat
from noticeflow.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.01"


def test_pairs(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad"),
            (1, 3, "user", "u"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None), (5, 0, "", ""), (5, 1, "assistant", "y"),
            (7, 5, "assistant", "alone"), (None, 0, "user", "n"), (8, None, "user", "n")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = sorted((r.pair_id, r.part, r.turn, r.rendered, r.mask) for r in chat.format_pairs(chat.neighbours(df)).collect())
    say = lambda r, t: f"<|{r}|>\n{t}<|end|>\n"
    assert got == sorted([(0, "prompt", 0, say("system", "s"), 0), (0, "prompt", 1, say("user", "u"), 0), (0, "chosen", 2, say("assistant", "good"), 1),
                          (0, "rejected", 2, say("assistant", "bad"), 1), (0, "rejected", 3, say("user", "u"), 0), (1, "prompt", 0, say("user", "x"), 0),
                          (2, "prompt", 0, say("", ""), 0), (2, "rejected", 1, say("assistant", "y"), 1), (3, "rejected", 5, say("assistant", "alone"), 1)])
    assert chat.format_pairs(chat.neighbours(df.limit(0))).count() == 0


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{D}/conversations.parquet'")
    out = QUERIES["op4_chat_formatting"](spark, D)
    want = sorted(c.sql(f"select pair_id, part, turn, role, rendered, mask from ({ORACLES['op4_chat_formatting']})").fetchall())
    assert sorted(map(tuple, out.select("pair_id", "part", "turn", "role", "rendered", "mask").collect())) == want
