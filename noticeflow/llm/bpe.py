"""Byte-pair encoding and decoding with a segment tree over pair ranks.

A word starts as its symbols. Leaf ``i`` of a segment tree holds the rank of
the pair (symbol ``i``, next symbol), packed above its position, so that the
root is always the leftmost pair of lowest rank. A merge changes three leaves;
each is a point update of O(log n). So a word of n symbols takes O(n log n),
also where a text is one word of many thousand characters.

``encode_decode`` runs inside Arrow batches: no shuffle, and a lost task is
redone from its input rows alone. Every task keeps a bounded cache of chunks.

Rows: null text counts as empty; an empty text has no ids and decodes to "";
repeated rows give repeated results; an empty table gives an empty table;
other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most chunks and pieces that a Python worker keeps; beyond it the cache starts anew.
CACHE_ENTRIES = 400_000
OUT_SCHEMA = "{id} {kind}, n_tokens long, ids binary, decoded string"

_space = regex.compile(r"\p{White_Space}+")
_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_odd_space = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it
    prints, else the next free one from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


#: Above every packed pair: no merge.
NONE = 1 << 62
#: Bits of an id in a packed pair.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1


class PairTree:
    """Minimum over the pairs of a word, in a heap-ordered array.

    A leaf is (rank, id of the merged symbol, position) packed in this order
    into one integer, so the root is the leftmost pair of lowest rank.
    """

    def __init__(self, pairs: list[int]):
        n = len(pairs)
        self.width = width = 1 << (n - 1).bit_length()
        self.shift = width.bit_length()
        shift = self.shift
        self.nodes = nodes = [NONE] * width + [NONE if p == NONE else p << shift | i for i, p in enumerate(pairs)] + [NONE] * (width - n)
        for k in range(width - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b

    def put(self, i: int, pair: int) -> None:
        """Point update: O(log n), or less once a node keeps its minimum."""
        nodes, k = self.nodes, self.width + i
        new = NONE if pair == NONE else pair << self.shift | i
        if nodes[k] == new:
            return
        nodes[k] = new
        while k > 1:
            other = nodes[k ^ 1]
            if other < new:
                new = other
            k >>= 1
            if nodes[k] == new:
                return
            nodes[k] = new


class Bpe:
    """Vocabulary, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.vocab[a] << ID_BITS | self.vocab[b]] = rank << ID_BITS | self.vocab[a + b]
        self.symbols = byte_symbols()
        alike = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(alike)})") if alike else None
        self.cache: dict[str, bytes] = {}

    def word(self, piece: str) -> list[int]:
        """Ids of one piece by repeated merges of the tree's root."""
        signs = [self.symbols[b] for b in piece.encode("utf-8")]
        if self.suffix:
            signs[-1] += self.suffix
        ids = [self.vocab[s] for s in signs if s in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        pair = self.pairs.get
        tree = PairTree([pair(a << ID_BITS | b, NONE) for a, b in zip(ids, ids[1:])])
        nodes, put = tree.nodes, tree.put
        shift, place = tree.shift, (1 << tree.shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := nodes[1]) != NONE:
            i = top & place
            ids[i] = now = top >> shift & ID_MASK
            j = after[i]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(j, NONE)
                put(i, pair(now << ID_BITS | ids[k], NONE))
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                put(h, pair(ids[h] << ID_BITS | now, NONE))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of one piece, from the cache if it is there."""
        out = self.cache.get(text)
        if out is None:
            out = np.array(self.word(text), "<u4").tobytes()
            self.keep(text, out)
        return out

    def chunk(self, text: str) -> bytes:
        """Packed ids of a text without white space."""
        pieces = _pieces.findall(text)
        if len(pieces) == 1 and pieces[0] == text:
            return self.piece(text)
        out = b"".join(map(self.piece, pieces))
        self.keep(text, out)
        return out

    def keep(self, text: str, ids: bytes) -> None:
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        if len(text) <= 64:
            self.cache[text] = ids

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        chunks = _space.split(text) if _odd_space.search(text) else text.split()
        get, miss = self.cache.get, self.chunk
        return b"".join([get(c) or miss(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: the file names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary per Python worker; it is read again after a loss."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and the decoded text of every row: (id, n_tokens, ids, decoded).

    ``path`` is a tokenizer file that every executor can read (an installed
    package's file, not one of the driver's).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=[id_col, "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, OUT_SCHEMA.format(id=id_col, kind=rows.schema[0].dataType.simpleString()))


def digest(df: DataFrame) -> DataFrame:
    """Digest columns of ``encode_decode`` rows."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                     F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
