"""Preference formatting of paired conversations.

A pair is a chosen and a rejected conversation. The longest common prefix of
their turns (equal role and text) is rendered once, as the pair's prompt; the
rest of either side follows as its completion. Every turn is one output row
with its rendered text and a loss mask: 1 for assistant turns of a completion,
0 for all else. A side's training string is its prompt rows and then its
completion rows by turn, so no conversation is ever collected into one task:
the first differing turn of a pair is a ``min``, combined before the shuffle,
and joined back to the turns.

Rows: rows without a conversation id or turn are left out; of several rows for
one turn the smallest (role, text) counts; turns are compared by their number,
so conversations that number from different starts share no prompt; null roles and texts render as empty
and equal each other; a conversation whose partner is missing is all completion;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, said) with one row per turn."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                F.struct(F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("said"))
    return rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min("said").alias("said"))


def format_pairs(sides: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, rendered, mask) of ``sides`` (pair_id, side, turn, said).

    ``side`` is 'chosen' or 'rejected'; part is 'prompt' (once for both) or a side.
    """
    chosen = F.max(F.when(F.col("side") == "chosen", F.col("said")))
    rejected = F.max(F.when(F.col("side") == "rejected", F.col("said")))
    both = sides.groupBy("pair_id", "turn").agg(chosen.alias("chosen"), rejected.alias("rejected"))
    first = (both.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("split")))
    met = both.join(first, "pair_id", "left")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    out = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))))
    rows = met.select("pair_id", "turn", F.explode(out).alias("o")).where("o.said is not null")
    role, text = F.col("o.said.role"), F.col("o.said.text")
    return rows.select("pair_id", F.col("o.part").alias("part"), "turn", role.alias("role"), rendered(role, text).alias("rendered"),
                       ((F.col("o.part") != "prompt") & (role == "assistant")).cast("int").alias("mask"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    rows = turns(conversations)
    return rows.select(F.shiftright(F.col("conv").cast("long"), 1).alias("pair_id"), F.when(F.pmod("conv", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "said")


ORACLE = """
WITH t AS (SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
b AS (SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, turn,
             max(said) FILTER (conv_id % 2 = 0) AS chosen, max(said) FILTER (conv_id % 2 <> 0) AS rejected FROM t GROUP BY 1, 2),
f AS (SELECT pair_id, min(turn) AS split FROM b WHERE chosen IS DISTINCT FROM rejected GROUP BY pair_id),
m AS (SELECT b.*, (split IS NULL OR turn < split) AS shared FROM b LEFT JOIN f USING (pair_id)),
o AS (SELECT pair_id, turn, 'prompt' AS part, chosen AS said FROM m WHERE shared
      UNION ALL SELECT pair_id, turn, 'chosen', chosen FROM m WHERE NOT shared
      UNION ALL SELECT pair_id, turn, 'rejected', rejected FROM m WHERE NOT shared)
SELECT pair_id, part, CAST(turn AS BIGINT) AS turn, said.role AS role,
       '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered,
       CAST(part <> 'prompt' AND said.role = 'assistant' AS INTEGER) AS mask
FROM o WHERE said IS NOT NULL
"""
