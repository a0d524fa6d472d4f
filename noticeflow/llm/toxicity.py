"""Toxicity by weak supervision.

Voters: a lexicon of insults per language, and patterns mined from labelled
training rows (words and word beginnings that toxic rows have far more often).
A voter says 1 where a text has one of its marks, and abstains or says 0 where
it has none. A generative label model (Dawid-Skene with a class prior, fitted
by expectation maximisation) estimates every voter's accuracy; voters that agree
more than their accuracies explain are correlated, and a group of them shares
one vote's weight. The label model sees the given labels as one more voter, as
labels are noisy. Its posteriors train a linear classifier (logistic
regression on voter marks and hashed words), which scores all rows.

Fitting uses at most about ``SAMPLE`` labelled rows whose crc32(id) mod 3 is not
1 (a documented bound): the bounded sample comes to the driver once. Scoring is
one narrow Arrow pass over whole texts with a fixed-size weight vector. Inputs
of a score are the text alone.

Rows: null text counts as empty and gets the score of an empty text; a null id
counts as held out by the crc32 of the empty string; repeated rows score alike;
very long texts are read whole, word by word; labels that are null are not used; without both classes every score is the share
of toxic labels (0 if there are none); other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import bounded_sample, one_text_per_id

SAMPLE, MINED, HASHED, THRESHOLD = 4_000, 80, 1 << 10, 0.7
#: Lengths of the word beginnings that patterns may be.
BEGINNINGS = (3, 4, 5, 6)
_word = re.compile(r"\w+")
#: Insults by language: plain word lists.
LEXICON = {
    "en": ["idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "jerk", "filthy", "imbecile", "fool"],
    "de": ["idiot", "dumm", "trottel", "abschaum", "dreck", "widerlich", "erbärmlich", "wertlos", "versager"],
    "fr": ["idiot", "stupide", "crétin", "minable", "ordure", "dégoûtant", "nul", "imbécile", "racaille"],
    "es": ["idiota", "estúpido", "imbécil", "basura", "asqueroso", "patético", "inútil", "escoria", "payaso"],
}


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def marks(text: str | None) -> set[str]:
    """Words and word beginnings of a lower-cased text: what voters look for."""
    words = set(_word.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def mine(rows: list[tuple[set[str], int]], most: int = MINED) -> list[str]:
    """Marks that toxic rows have far more often, by a smoothed log ratio with a count bound.

    A mark whose toxic rows nearly all have three chosen marks already adds
    nothing and is passed over, so that rarer languages get their marks too.
    """
    pos, neg = Counter(), Counter()
    where: dict[str, list[int]] = {}
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    for k, (m, y) in enumerate(rows):
        if y:
            pos.update(m)
    least = max(3, n1 // 500)
    for k, (m, y) in enumerate(rows):
        if y:
            for x in m:
                if pos[x] >= least:
                    where.setdefault(x, []).append(k)
        else:
            neg.update(x for x in m if pos[x] >= least)
    scored = []
    for m, at in where.items():
        ratio = ((len(at) + 0.5) / (n1 + 1)) / ((neg[m] + 0.5) / (n0 + 1))
        if ratio >= 12:
            scored.append((len(at) * np.log(ratio), m))
    chosen: list[str] = []
    had: Counter[int] = Counter()
    alike: set[tuple[int, ...]] = set()
    for _, m in sorted(scored, key=lambda x: (-x[0], -len(x[1]), x[1])):
        if tuple(where[m]) in alike:
            continue
        alike.add(tuple(where[m]))
        if sum(had[k] < 3 for k in where[m]) >= max(2, 0.1 * len(where[m])):
            chosen.append(m)
            had.update(where[m])
            if len(chosen) == most:
                break
    return chosen


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, P(vote | toxic), P(vote | clean)) of 0/1 votes by expectation maximisation.

    Correlated voters: where two voters' votes, given the posterior class, still
    agree strongly, each takes 1 / (size of its group) of a vote's weight.
    """
    n, k = votes.shape
    weight = np.ones(k)
    post = np.clip(votes[:, 0] * 0.8 + 0.05 + 0.15 * (votes[:, 1:].any(1)), 0.02, 0.98)
    for step in range(rounds):
        a = (post @ votes + 0.5) / (post.sum() + 1.0)
        b = ((1 - post) @ votes + 0.5) / ((1 - post).sum() + 1.0)
        if step % 10 == 5:
            rest = votes - (post[:, None] * a + (1 - post)[:, None] * b)
            c = rest.T @ rest / n
            s = np.sqrt(np.maximum(np.diag(c), 1e-9))
            weight = 1.0 / np.maximum(1, (np.abs(c / s / s[:, None]) > 0.5).sum(1))
        prior = np.clip(post.mean(), 1e-3, 0.5)
        on, off = np.log(a / b), np.log((1 - a) / (1 - b))
        z = np.log(prior / (1 - prior)) + (votes * on + (1 - votes) * off) @ weight
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-5:
            break
        post = new
    return post, a, b


@dataclass
class Model:
    voters: list[frozenset[str]]
    weights: np.ndarray
    bias: float

    def features(self, m: set[str]) -> np.ndarray:
        x = np.zeros(len(self.voters) + HASHED, np.float32)
        for k, v in enumerate(self.voters):
            x[k] = not v.isdisjoint(m)
        plain = [xxhash.xxh32_intdigest(w) % HASHED for w in m if w[-1] != "*"]
        if plain:
            x[len(self.voters) + np.array(plain)] = 1.0 / np.sqrt(len(plain))
        return x

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(marks(text)) @ self.weights + self.bias, -30, 30))))


def train(rows: list[tuple[str | None, int]]) -> Model:
    """Voters, label model and classifier from (text, label) rows."""
    seen = [(set(map(sys.intern, marks(t))), y) for t, y in rows]
    n1 = sum(y for _, y in seen)
    if n1 == 0 or n1 == len(seen):
        share = n1 / len(seen) if seen else 0.0
        return Model([], np.zeros(HASHED, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    mined = mine(seen)
    voters = [frozenset(w) for w in LEXICON.values()] + [frozenset([m]) for m in mined]
    said = np.array([[not v.isdisjoint(m) for v in voters] for m, _ in seen], np.float64)
    votes = np.concatenate((np.array([[y] for _, y in seen], np.float64), said), 1)
    post, a, b = label_model(votes, n1 / len(seen))
    # a clean label alone does not outvote good marks, nor a toxic label without any
    model = Model(voters, np.zeros(len(voters) + HASHED, np.float32), 0.0)
    x = np.array([model.features(m) for m, _ in seen], np.float32)
    scale = np.concatenate((np.full(len(voters), 1e-4), np.full(HASHED, 3e-2))).astype(np.float32)
    w, c = np.zeros(x.shape[1], np.float32), float(np.log(post.mean() / (1 - post.mean())))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    rng, step, t = np.random.RandomState(5), 0.05, 0
    for _ in range(30):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 512):
            k = order[lo:lo + 512]
            t += 1
            e = (1 / (1 + np.exp(-np.clip(x[k] @ w + c, -30, 30))) - post[k]).astype(np.float32)
            g = x[k].T @ e / len(k) + scale * w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w -= step * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-6)
            c -= step * float(e.mean())
    return Model(voters, w, c)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled rows that are not held out."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    some = bounded_sample(usable, id_col, sample).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_t")).join(F.broadcast(some), id_col)  # bounded by ``sample``
    rows = one_text_per_id(rows, id_col, "_t")
    return train([(r._t, int(r._y)) for r in rows.orderBy(id_col).toLocalIterator()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: voters and HASHED weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        by_mark: dict[str, list[int]] = {}
        for k, v in enumerate(model.voters):
            for m in v:
                by_mark.setdefault(m, []).append(k)
        n = len(model.voters)
        places: dict[str, tuple] = {}

        def known(w: str) -> tuple:
            found = [k for m in (w, *(w[:j] + "*" for j in BEGINNINGS if len(w) > j)) for k in by_mark.get(m, ())]
            out = xxhash.xxh32_intdigest(w) % HASHED, found
            if len(places) < 200_000:
                places[w] = out
            return out

        def one(text: str | None) -> float:
            on: set[int] = set()
            plain = []
            for w in set(_word.findall((text or "").lower())):
                h, found = places.get(w) or known(w)
                plain.append(h)
                on.update(found)
            z = model.bias + float(model.weights[list(on)].sum()) if on else model.bias
            if plain:
                z += float(model.weights[n + np.unique(np.array(plain))].sum()) / np.sqrt(len(plain))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        for b in batches:
            s = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    scored = rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
