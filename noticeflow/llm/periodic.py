"""Runs of periodic words inside each text, by seed-and-extend on diagonals.

A run of period q is a maximal stretch in which words q apart are equal, of at
least ``max(least, times * q)`` words; q is its smallest period. With times = 4
its overlap with itself, shifted by q, is at least 3q words, and ``least - 1``
for q = 1. Periods are taken in classes [2^t, 2^(t+1)); every run of a class
then holds a pair of equal k-grams exactly q words apart, where k is the least
overlap that the class guarantees. So for each class:

1. the text's k-grams are indexed by exact ranks, made by doubling: equal rank
   means equal words, no hash is involved; grams that all differ end the search,
   as longer ones differ too;
2. each occurrence is paired with the next one of the same k-gram, if their
   distance (the lag) is in the class. Earlier pairs suffice: k is at least q,
   so inside a run the next occurrence of its first k-gram is exactly q words on,
   and a multiple of the smallest period never is a next occurrence;
3. a pair is extended along its diagonal to both sides, unless the table of the
   furthest covered word per lag says that its stretch is known already.

So the pairs are linear in the text's words per class, also for one word that is
repeated a million times, and the classes are logarithmic in its length.

Texts never meet each other: one narrow pass, no shuffle, memory bounded by the
longest text. Rows: null or empty texts have no words and no runs; repeated rows
get the same result each; a null id is kept; an empty table gives an empty
table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import pieces, words

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of every pair (a[i], b[i])."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _joined(r: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of grams made of r[i] and r[i + shift]."""
    return _ranks(r[:r.size - shift], r[shift:])


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two arrays."""
    n, at, step = min(a.size, b.size), 0, 64
    while at < n:
        differ = a[at:at + step][:n - at] != b[at:at + step][:n - at]
        if differ.any():
            return at + int(differ.argmax())
        at += differ.size
        step *= 2
    return n


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, out = ids.size, []
    if times < 3 or least < times:
        raise ValueError("a run must hold three periods or more, and as many words")
    grams: dict[int, np.ndarray] = {1: ids}

    def gram(k: int) -> np.ndarray:
        """Ranks of all k-grams, from those of half the length."""
        if k not in grams:
            half = (k + 1) // 2
            grams[k] = _joined(gram(half), k - half)
        return grams[k]

    low = 1
    while max(least, times * low) <= n:
        # the overlap max(least, times * q) - q falls up to q = least / times, then rises
        turn = least // times
        k = min(max(least, times * q) - q for q in {low, 2 * low - 1, *(min(max(x, low), 2 * low - 1) for x in (turn, turn + 1))})
        rank = gram(min(k, n))
        if int(rank.max()) + 1 == rank.size:
            if times * low >= least:
                break
            low *= 2
            continue
        order = np.argsort(rank, kind="stable")
        i, lag = order[:-1], np.diff(order)
        near = np.flatnonzero((rank[i] == rank[order[1:]]) & (lag >= low) & (lag < 2 * low))
        near = near[np.argsort(i[near], kind="stable")]
        covered: dict[int, int] = {}
        for at, q in zip(i[near].tolist(), lag[near].tolist()):
            if at < covered.get(q, 0):
                continue
            start = at - _reach(ids[:at][::-1], ids[:at + q][::-1])
            end = at + k + _reach(ids[at + k:], ids[at + k + q:])
            covered[q] = end
            if end + q - start >= max(least, times * q):
                out.append((start, end + q - start, q))
        grams = {size: r for size, r in grams.items() if size == 1 or 2 * size >= k}
        low *= 2
    return sorted((s, length, q) for s, length, q in out)


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row; ``collapsed`` has, joined by
    one space, the words that no run contains after its first period."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, found, kept = [], [], []
            for t in b.column(1).to_pylist():
                # bytes.split knows just the blanks \t \n \v \f \r and space
                w = (t or "").encode("utf-8").split()
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w))
                runs = find_runs(ids, least, times) if len(known) < len(w) else []
                n.append(len(w))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                if runs:
                    gone = np.zeros(len(w), bool)
                    for s, length, q in runs:
                        gone[s + q:s + length] = True
                    w = [w[k] for k in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(w).decode("utf-8"))
            one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(one)), pa.array(kept, pa.string())],
                                             names=["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_words long, runs {RUN}, collapsed string").withColumnRenamed("id", id_col)


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (id, text), a tenth of them made periodic from some word on, chosen and shaped by a checksum of the id.

    With h = crc32 of the id and g = h div 10, rows of h mod 10 = 0 with n words
    repeat words a .. a + p - 1 from word a on, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = rows.withColumn("_w", F.when(h % 10 == 0, words(F.col("text")))).withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int"))

    def made() -> Column:
        tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice("_w", 1, F.col("_a")), tail), 1, F.col("_n")), " ")

    return rows.select(id_col, F.when(F.col("_n") > 0, made()).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run (ties: least start, then period) and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    out = rows.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return out.select(id_col, "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"),
                      F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
