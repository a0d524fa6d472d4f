"""Benchmark decontamination by q-gram lemma filtering.

A text region that holds a benchmark item of m signs with at most k edits
shares at least ``m + 1 - q * (k + 1)`` of the item's q-grams, all of them on
diagonals (place in the text minus place in the item) that differ by at most k.
So the hits of every item's q-grams in a document are counted in overlapping
bands of diagonals (width 2k, one starting every k); a band that reaches the
bound is kept, and only then a banded alignment of the item against that
stretch of text decides, by the true edit distance.

Items are cut into adjacent windows of about ``WINDOW`` signs, which decide on
whole edited items, and into overlapping ones (``overlapping``) for passages:
every verbatim passage of at least ``least_passage(m)`` signs of an item of m
signs holds one of them whole, wherever it begins. That is 89 signs from 120
signs on, about three quarters of an item of 80 to 119, 59 signs of shorter ones,
and the whole item below 60. Each window is an own pattern. Both sides are
compared in lower case with runs of white space as one space.

The patterns' q-grams are a sorted array that goes to the executors in blocks
of at most ``BLOCK`` signs; a larger benchmark takes more passes, never a
larger broadcast. Documents are searched in Arrow batches, whole, without a
shuffle; the hits of a long text are listed stretch by stretch, so that a text
of one repeated sign needs no more memory than any other.

Rows: a null or empty text matches nothing; items shorter than ``q + 1`` signs
after folding must occur exactly, as words; null or empty items are skipped;
repeated items and documents are each reported; an empty side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shingle_hash import mix

Q, WINDOW, ERRORS = 8, 120, 0.08
#: Signs of the shortest and the longest overlapping window.
SHORTEST, LONGEST = 40, 60
#: Signs of patterns in one broadcast block.
BLOCK = 4_000_000
#: Signs of text whose hits are listed at once, and their overlap, which is longer than any pattern with its edits.
STRETCH, OVERLAP = 4096, 512
_white = re.compile(r"\s+")
_table = mix(np.arange(1, 65537, dtype=np.uint64))


def fold(text: str | None) -> str:
    return _white.sub(" ", (text or "").lower()).strip()


def signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams of a text."""
    if a.size < q:
        return np.zeros(0, np.uint64)
    v = _table[a & 0xFFFF] + (a >> 16).astype(np.uint64)
    out = np.zeros(a.size - q + 1, np.uint64)
    for k in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + v[k:a.size - q + 1 + k]
    return mix(out)


def budget(m: int) -> int:
    return int(m * ERRORS)


def overlapping(m: int) -> list[tuple[int, int]]:
    """(start, stop) of windows that begin every half window, and of the last one, in an item of m signs."""
    w = min(LONGEST, max(SHORTEST, m // 2))
    return [(a, a + w) for a in sorted({*range(0, m - w + 1, w // 2), m - w})] if m >= w else []


def least_passage(m: int) -> int:
    """Signs from which on every passage of an item of m signs holds a whole window."""
    w = min(LONGEST, max(SHORTEST, m // 2))
    return min(m, w + w // 2 - 1)


def distance(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int]:
    """(edits, end) of the best match of the whole pattern in the text, which starts anywhere and ends anywhere.

    One row of the table per sign of the text, computed along the pattern with
    a running minimum; the caller hands in a band's stretch only.
    """
    m = pattern.size
    steps = np.arange(m + 1)
    row, best, end = steps.copy(), m + 1, 0
    for j, c in enumerate(text):
        new = np.empty(m + 1, np.int64)
        new[0] = 0
        np.minimum(row[1:] + 1, row[:-1] + (pattern != c), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row[m] < best:
            best, end = int(row[m]), j + 1
    return best, end


class Block:
    """Patterns of some items and an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.owner: list[int] = []
        self.patterns: list[np.ndarray] = []
        self.short: list[tuple[int, str]] = []
        for item, text in rows:
            a = signs(text)
            if a.size <= Q:
                self.short.append((item, text))
                continue
            n = max(1, round(a.size / WINDOW))
            adjacent = [(k * a.size // n, (k + 1) * a.size // n) for k in range(n)]
            for lo, hi in sorted({*adjacent, *overlapping(a.size)}):
                if hi - lo > Q:
                    self.owner.append(item)
                    self.patterns.append(a[lo:hi])
        parts = [grams(p) for p in self.patterns]
        gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        pattern = np.repeat(np.arange(len(parts)), [x.size for x in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(x.size) for x in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.pattern, self.place = gram[order], pattern[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(gram >> np.uint64(42)).astype(np.int64)] = True
        self.bound = np.array([max(1, p.size + 1 - Q * (budget(p.size) + 1)) for p in self.patterns], np.int64)
        self.width = np.array([max(1, budget(p.size)) for p in self.patterns], np.int64)

    def hits(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, diagonal) of all equal q-grams."""
        g = grams(a)
        at = np.flatnonzero(self.maybe[(g >> np.uint64(42)).astype(np.int64)]) if g.size else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not n.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return self.pattern[k], np.repeat(at, n) - self.place[k]

    def regions(self, a: np.ndarray) -> list[tuple[int, int]]:
        """(pattern, first diagonal) of bands that reach the q-gram bound."""
        out: list[tuple[int, int]] = []
        # the stretches overlap by more than a band, so a band lies whole in one of them
        for at in range(0, max(1, a.size), STRETCH):
            out += [(x, d + at) for x, d in self._regions(a[at:at + STRETCH + OVERLAP])]
        return sorted(set(out)) if a.size > STRETCH else out

    def _regions(self, a: np.ndarray) -> list[tuple[int, int]]:
        p, d = self.hits(a)
        if not p.size:
            return []
        enough = np.bincount(p, minlength=len(self.patterns)) >= self.bound
        p, d = p[enough[p]], d[enough[p]]
        if not p.size:
            return []
        w = self.width[p]
        band = (d + 4 * w) // w  # a band holds diagonals of two neighbouring steps
        key = (p << 40) + band + (1 << 20)  # bands of an item's start may be below 0
        del p, d, band
        found, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        found = found[count >= self.bound[found >> 40]]
        x, band = found >> 40, (found & ((1 << 40) - 1)) - (1 << 20)
        return list(zip(x.tolist(), ((band - 4) * self.width[x]).tolist()))

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item -> (matched patterns, least edits, end of a match in the folded text)."""
        t = fold(text)
        if not t:
            return {}
        a = signs(t)
        done: dict[int, tuple[int, int]] = {}
        for x, d in self.regions(a):
            if x in done:
                continue
            pattern, w = self.patterns[x], int(self.width[x])
            k = budget(pattern.size)
            lo, hi = max(0, d - k), min(a.size, d + 2 * w + pattern.size + k)
            at = t.find(pattern.tobytes().decode("utf-32-le", "surrogatepass"), lo, hi)
            edits, end = (0, at - lo + pattern.size) if at >= 0 else distance(pattern, a[lo:hi], k)
            if edits <= k:
                done[x] = edits, lo + end
        out: dict[int, tuple[int, int, int]] = {}
        for x, (edits, end) in done.items():
            n, least, last = out.get(self.owner[x], (0, edits, end))
            out[self.owner[x]] = n + 1, min(least, edits), max(last, end)
        for item, s in self.short:
            if s in t and re.search(rf"(?<!\w){re.escape(s)}(?!\w)", t):
                out[item] = out.get(item, (1, 0, 0))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Folded items in blocks of at most ``BLOCK`` signs of patterns (a longer item alone in one)."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        t = fold(r.t)
        if not t or r.i is None:
            continue
        more = len(t) + sum(hi - lo for lo, hi in overlapping(len(t)))
        if block and size + more > BLOCK:
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += more
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_windows, edits, end) for every document and item of which a window occurs within the edit budget."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id long, n_windows long, edits long, end long"
    sc = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Block(sent.value)
            for b in batches:
                found = [(i, item, *v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for item, v in index.search(t).items()]
                columns = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema[0].type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                                 names=[id_col, "item_id", "n_windows", "edits", "end"])
        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in whose text no benchmark item was found, whatever other rows have their id, or null.

    A narrow pass per block of the benchmark, which lets clean rows through; no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn("_text", F.col(text_col).cast("string"))
    schema = out.schema
    for block in blocks(benchmark):
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Block(sent.value)
            for b in batches:
                yield b.filter(pa.array([not index.search(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.bool_()))
        out = out.mapInArrow(run, schema)
    return out.drop("_text")
