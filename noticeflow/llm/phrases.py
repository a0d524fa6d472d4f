"""Repeated phrases across documents, located by sharded Aho-Corasick automata.

A window is ``size`` consecutive words. Every window that also starts in a
document of a smaller id is to be found, wherever it occurs. All documents are
dealt to shards by a hash of id and text; a shard is a bounded piece of the
corpus (``shard_bytes``), so their number grows with the input.

Confirm recurring passages:

1. Each window has one seed, the least hash among its ``SEED``-word grams, so
   equal windows have equal seeds and only about one word in five starts one.
   Seeds that two ids have, by a grouped minimum and maximum, go to the shards
   where they occur.
2. A shard keeps the stretches of its documents whose windows have such seeds;
   only these are counted window by window: least id, greatest id. Windows with
   two ids recur; the least id is the owner's.
3. The owner's shard cuts the owner's text into passages of recurring windows,
   each window in one passage only. A passage goes to the shards that hold one of
   its windows in a later document, and to no other.

Locate them: each shard compiles its passages into an automaton over word
numbers (pyahocorasick), then streams all its documents through it. Its patterns
are the passages' neighbouring phrases of (size + 1) // 2 words: any window holds a
whole one, and a passage takes one node per word, not one per word and window.
A hit says where in the document a passage may lie; the words on that diagonal
are compared, and each window that agrees whole covers its words if the passage's
owner is smaller than the document's id. So the words themselves decide; hashes
only choose what is compiled.

So every document is shuffled whole twice and read by one automaton, which never
holds more than its shard's own recurring windows and their neighbours in a
passage. A passage that a third of all documents share is one row per shard and
window; grouped minima combine before the shuffle, joins may be split. No group
but a shard is ever held by one task.

Rows: ids are whole numbers; a null id comes after all others (documents without
id lose to any other, not to one another); null or empty texts have no words;
rows that repeat an id are judged alike and never against one another; repeated
rows stay rows; an empty table gives an empty table; columns other than id and
text are not read. Very long texts are a shard's load of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import checkpointed, discard, pieces
from noticeflow.llm.shingle_hash import shingles, window_minima, word_hashes

SIZE, SEED = 13, 5
#: Bytes of text per shard, and windows per passage.
SHARD_BYTES, PASSAGE = 2 << 20, 32
#: Bytes that are hashed at once, windows that a task holds before it sends them on, pairs that are compared at once.
CHUNK, HELD, PAIRS = 1 << 18, 400_000, 50_000
LAST = 2**63 - 1


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of neighbouring texts of about ``CHUNK`` bytes; a longer text is one."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield at, k
            at, held = k, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """Words of several texts in a row: hash, first byte in ``raw`` and number of the text of each."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.hash, start = word_hashes(self.raw, lower=False)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, start, "right")
        self.start = np.concatenate((start, [len(self.raw)]))

    def whole(self, size: int) -> np.ndarray:
        """First words of all windows that lie in one text."""
        return np.flatnonzero(self.text[:self.text.size - size + 1] == self.text[size - 1:]) if self.text.size >= size else np.zeros(0, np.int64)

    def cut(self, first: int, last: int) -> bytes:
        """Bytes of the words first .. last."""
        return self.raw[self.start[first]:self.start[last + 1]].rstrip(b" \t\n\v\f\r")

    def windows(self, size: int) -> np.ndarray:
        return shingles(self.hash, size).view(np.int64) if self.hash.size >= size else np.zeros(0, np.int64)

    def seeds(self, size: int) -> np.ndarray:
        """The seed of every window: the least hash of the grams in it."""
        if self.hash.size < size:
            return np.zeros(0, np.int64)
        gram = min(SEED, size)
        h = shingles(self.hash, gram)
        return h[window_minima(h, size - gram + 1)].view(np.int64)


def _seed_rows(docs: DataFrame, size: int) -> DataFrame:
    """(seed, shard, doc) of every seed of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            shard, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [t.encode("utf-8") for t in b.column(2).to_pylist()]
            for a, z in _chunks(texts):
                w = Words(texts[a:z])
                at = w.whole(size)
                s, of = w.seeds(size)[at], w.text[at]
                first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])))) if s.size else at
                yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(shard[a + of[first]]), pa.array(doc[a + of[first]])], names=["seed", "shard", "doc"])

    return docs.select("shard", "doc", "text").mapInArrow(run, "seed long, shard int, doc long")


def _starts_and_ends(places: np.ndarray, most: int = 0) -> tuple[list[int], list[int]]:
    """First and last of each stretch of consecutive places, cut after every ``most`` of them."""
    if not places.size:
        return [], []
    new = np.concatenate(([True], np.diff(places) != 1))
    if most:
        first = np.flatnonzero(new)
        inside = np.arange(places.size) - np.repeat(first, np.diff(np.concatenate((first, [places.size]))))
        new = inside % most == 0
    first = np.flatnonzero(new)
    return places[first].tolist(), places[np.concatenate((first[1:], [places.size])) - 1].tolist()


def _stretches(docs: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """(shard, doc, text): the stretches of all windows with one of the shard's ``seeds`` (shard, seed)."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.sort(right.column("seed").to_numpy())
        ids, doc, text = left.column("doc").to_numpy(), [], []
        texts = [t.encode("utf-8") for t in left.column("text").to_pylist()] if wanted.size else []
        for a, z in _chunks(texts):
            w = Words(texts[a:z])
            at = w.whole(size)
            s = w.seeds(size)[at]
            at = at[wanted[np.minimum(np.searchsorted(wanted, s), wanted.size - 1)] == s]
            for first, last in zip(*_starts_and_ends(at)):
                doc.append(ids[a + w.text[first]])
                text.append(w.cut(first, last + size - 1))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(doc), pa.int32()), "doc": pa.array(doc, pa.int64()), "text": pa.array(text, pa.binary())})

    return docs.select("shard", "doc", "text").groupBy("shard").cogroup(seeds.select("shard", "seed").groupBy("shard")).applyInArrow(run, "shard int, doc long, text binary")


def _window_rows(stretches: DataFrame, size: int) -> DataFrame:
    """(window, shard, lo, hi): windows of the stretches with their least and greatest document, in parts."""
    def part(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, shard, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, shard, h))
        h, shard, doc = h[order], shard[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])))) if h.size else order
        last = np.concatenate((first[1:], [h.size])) - 1 if h.size else order
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first], shard[first], doc[first], doc[last])], names=["window", "shard", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches, 5_000):
            shard, doc, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for a, z in _chunks(texts):
                w = Words(texts[a:z])
                at = w.whole(size)
                held.append((w.windows(size)[at], shard[a + w.text[at]], doc[a + w.text[at]]))
                n += at.size
                if n > HELD:
                    yield part(held)
                    held, n = [], 0
        if held:
            yield part(held)

    return stretches.select("shard", "doc", "text").mapInArrow(run, "window long, shard int, lo long, hi long")


def _passages(stretches: DataFrame, recurring: DataFrame, size: int) -> DataFrame:
    """(passage, owner, text, windows): the owners' texts cut into passages of recurring windows (window, lo, shard of the owner)."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("window").to_numpy())
        known, owner = right.column("window").to_numpy()[order], right.column("lo").to_numpy()[order]
        free = np.ones(known.size, bool)
        ids, texts = left.column("doc").to_numpy(), left.column("text").to_pylist() if known.size else []
        name, of, text, windows = [], [], [], []
        for a, z in _chunks(texts):
            w = Words(texts[a:z])
            places = w.whole(size)
            h = w.windows(size)
            at = np.minimum(np.searchsorted(known, h[places]), known.size - 1)
            mine = (known[at] == h[places]) & (owner[at] == ids[a + w.text[places]]) & free[at]
            places, at = places[mine], at[mine]
            once = np.sort(np.unique(at, return_index=True)[1])
            places = places[once]
            free[at[once]] = False
            for first, last in zip(*_starts_and_ends(places, PASSAGE)):
                name.append(int(h[first]))
                of.append(ids[a + w.text[first]])
                text.append(w.cut(first, last + size - 1))
                windows.append(h[first:last + 1])
        ends = np.concatenate(([0], np.cumsum([x.size for x in windows]))).astype(np.int32)
        return pa.table({"passage": pa.array(name, pa.int64()), "owner": pa.array(of, pa.int64()), "text": pa.array(text, pa.binary()),
                         "windows": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(windows) if windows else np.zeros(0, np.int64)))})

    return stretches.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(run, "passage long, owner long, text binary, windows array<long>")


def recurring_passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(shard, owner, text) of the passages that each shard of ``docs`` (shard, doc, text) has to look for."""
    rows = checkpointed(_seed_rows(docs, size))
    twice = rows.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed")
    seeds = checkpointed(rows.select("seed", "shard").join(twice, "seed").distinct())
    discard(rows)
    stretches = checkpointed(_stretches(docs, seeds, size))
    discard(seeds)
    windows = _window_rows(stretches, size)
    least = windows.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("shard", "lo").alias("shard"))
    recurring = checkpointed(least.where("lo < hi").select("window", "lo", "shard"))
    passages = checkpointed(_passages(stretches, recurring, size))
    discard(recurring)
    of = passages.select("passage", "owner", F.explode("windows").alias("window"))
    sent = checkpointed(windows.join(of, "window").where("hi > owner").select("passage", "shard").distinct())
    discard(stretches)
    return sent.join(passages.select("passage", "owner", "text"), "passage").select("shard", "owner", "text")


class Phrases:
    """The passages of a shard, compiled."""

    def __init__(self, passages: list[tuple[int, bytes]], size: int):
        self.size, self.step = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        split = [tuple(number(w, len(self.numbers) + 1) for w in text.split()) for _, text in passages]
        places: dict[tuple, list[tuple[int, int]]] = {}
        for k, s in enumerate(split):
            for at in range(0, len(s) - self.step + 1, self.step):
                places.setdefault(s[at:at + self.step], []).append((k, at))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, phrase in enumerate(places):
            self.found.add_word(self.letters(np.array(phrase)), k)
        self.found.make_automaton()
        # of each pattern: where in which passages
        many = np.array([len(p) for p in places.values()], np.int64)
        self.first, self.many = np.concatenate(([0], np.cumsum(many))), many
        self.passage, self.at = np.array([x for p in places.values() for x in p], np.int64).reshape(-1, 2).T
        self.owner = np.array([o for o, _ in passages], np.int64)
        self.width = max(map(len, split), default=0)
        self.words = np.full((len(split), self.width), -1, np.int64)
        for k, s in enumerate(split):
            self.words[k, :len(s)] = s

    @staticmethod
    def letters(numbers: np.ndarray) -> tuple[int, ...]:
        """Two letters per word, of disjoint alphabets: a node's children are searched one
        by one, so the root must not have one per word."""
        out = np.empty(2 * numbers.size, np.int64)
        out[0::2], out[1::2] = 256 + (numbers >> 8), numbers & 255
        return tuple(out.tolist())

    def hits(self, sequence: np.ndarray) -> list[tuple[int, int]]:
        """(last word, pattern) of all phrases in the stretches of known words that hold a window."""
        known = np.concatenate(([False], sequence > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        out = []
        for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if z - a >= self.size:
                out += [(a + (end >> 1), k) for end, k in self.found.iter(self.letters(sequence[a:z]))]
        return out

    def covered(self, words: list[bytes], doc: int) -> np.ndarray | None:
        """Which words of a document a passage of a smaller owner covers; None for none."""
        n = len(words)
        if n < self.size or not self.owner.size:
            return None
        sequence = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, n)
        hits = self.hits(sequence)
        if not hits:
            return None
        end, phrase = np.array(hits, np.int64).T
        many = self.many[phrase]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[phrase], many) + nth
        passage = self.passage[entry]
        begin = np.repeat(end - self.step + 1, many) - self.at[entry] + self.width  # of the passage, from 0 on
        earlier = self.owner[passage] < doc
        pairs = np.unique(passage[earlier] * (n + 2 * self.width) + begin[earlier])
        if not pairs.size:
            return None
        text = np.concatenate((np.zeros(self.width, np.int64), sequence, np.zeros(2 * self.width, np.int64)))
        marks = np.zeros(text.size + 1, np.int64)
        for a in range(0, pairs.size, PAIRS):
            passage, begin = np.divmod(pairs[a:a + PAIRS], n + 2 * self.width)
            same = text[begin[:, None] + np.arange(self.width)] == self.words[passage]
            sums = np.concatenate((np.zeros((len(same), 1), np.int64), np.cumsum(same, 1)), 1)
            row, at = np.nonzero(sums[:, self.size:] - sums[:, :-self.size] == self.size)
            np.add.at(marks, begin[row] + at, 1)
            np.add.at(marks, begin[row] + at + self.size, -1)
        return np.cumsum(marks)[self.width:self.width + n] > 0


def dedup(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; ``kept`` is the words that remain, joined by one space."""
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc", "text"), F.lit(shards)).cast("int"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        phrases = Phrases(list(zip(right.column("owner").to_pylist(), right.column("text").to_pylist())), size)
        n, gone, kept = [], [], []
        for d, t in zip(left.column("doc").to_pylist(), left.column("text").to_pylist()):
            w = t.encode("utf-8").split()
            n.append(len(w))
            covered = phrases.covered(w, d)
            if covered is not None:
                w = [w[k] for k in np.flatnonzero(~covered).tolist()]
            gone.append(n[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8"))
        return pa.table({"id": left.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    passages = recurring_passages(docs, size)
    out = docs.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(run, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
