"""Quality rules: text statistics and a learned decision list.

``statistics`` is one narrow projection per document (no shuffle, no Python).
``learn`` grows a decision list by sequential covering: rule after rule, the
threshold literal of the best information gain is added to a conjunction until
it is pure, literals that do not pay on a separate pruning part are cut from its
end, and the rows that a rule covers leave the table. All counts come from
DataFrame aggregates over one small table; the driver sees (feature, bin)
counts only. ``verdict`` turns the list into one ordered ``when`` chain.

Fitting uses at most about ``SAMPLE`` labelled rows (a documented bound); the
statistics and the verdict cover every row.

Rows: null text has no words; empty texts have zero counts and fail the base
rule; repeated rows are judged alike; labels that are null, or of unknown
documents, are not used; without both classes the list is empty and only the
base rule decides; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import SPACE, bounded_sample, checkpointed, one_text_per_id, settled, words

#: Labelled rows that a fit may use.
SAMPLE = 20_000
MAX_RULES, MAX_LITERALS, BINS, MIN_COVER, MIN_PRECISION = 8, 3, 24, 10, 0.9
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_share", "digit_share", "bang_share"]


def _removed(text: Column, signs: str) -> Column:
    """How many characters of ``signs`` a text has."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _window_hashes() -> Column:
    w = F.col("_words")
    one = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), one)).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts() -> Column:
    """Starts of the windows that occur twice or more, by a sort of (hash, start)."""
    s = F.col("_sorted")
    at = lambda i: F.get(s, i)["h"]
    start = lambda i: F.when((at(i) == at(i - 1)) | (at(i) == at(i + 1)), F.get(s, i)["p"])
    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), start), lambda x: x.isNotNull())
    return F.when(F.size(s) > 0, F.sort_array(found)).otherwise(F.array().cast("array<int>"))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, base counts, features) of every row; ``keep`` names columns to carry along."""
    own = [F.col(c) for c in keep or []]
    carried = [c for c in keep or []]
    text = F.col("_text")
    d = df.select(*own, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    d = d.withColumn("_words", words(text))
    d = d.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    d = d.withColumn("_hashes", _window_hashes())
    # texts in which every window is unique need no sort
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
                                       F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
                     .otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    d = d.withColumn("_starts", _repeated_starts())
    gap = lambda j: F.least(F.lit(3), F.coalesce(F.get("_starts", j + 1) - F.get("_starts", j), F.lit(3))).cast("long")
    covered = F.when(F.size("_starts") > 0, F.aggregate(F.sequence(F.lit(0), F.size("_starts") - 1), F.lit(0).cast("long"), lambda a, j: a + gap(j))).otherwise(F.lit(0).cast("long"))
    d = d.select(*carried, "_id", "_text", F.size("_words").cast("long").alias("n_words"),
                 F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
                 _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
                 F.size("_lines").alias("_n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 covered.alias("n_repeat_words"), F.size(F.array_distinct("_words")).alias("_distinct"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    n, chars = F.col("n_words"), F.col("word_chars")
    d = d.select(
        *carried, F.col("_id").alias(id_col), *BASE,
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.struct(n.cast("double").alias("words"), share(chars, n).alias("word_length"), share(F.col("n_symbols"), n).alias("symbol_share"),
                 share(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"), share(F.col("n_repeat_words"), n).alias("repeat_share"),
                 share(F.col("_distinct"), n).alias("distinct_share"),
                 share(_removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars).alias("capital_share"),
                 share(_removed(text, "0123456789"), chars).alias("digit_share"), share(_removed(text, "!"), n).alias("bang_share")).alias("features"))
    return settled(d, carried + [id_col])


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        x = F.col(f"features.{self.feature}")
        return x > self.limit if self.above else x <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


def _all(literals: tuple[Literal, ...] | list[Literal]) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & x.column()
    return out


def _between(values: list[float]) -> list[float]:
    """Thresholds halfway between neighbouring quantiles, so that a rule does not hug one class."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _below(x: Column):
    return lambda cut: cut < x


def _best_literal(rows: DataFrame, limits: dict[str, list[float]]) -> tuple[Literal | None, int, int]:
    """The literal of the best gain for bad rows, from one aggregate of (feature, bin) counts."""
    binned = []
    for name, cuts in limits.items():
        x = F.col(f"features.{name}")
        place = F.size(F.filter(F.lit(cuts).cast("array<double>"), _below(x)))
        binned.append(F.struct(F.lit(name).alias("feature"), place.alias("bin")))
    counts = (rows.select("bad", F.explode(F.array(*binned)).alias("b")).groupBy("b.feature", "b.bin")
              .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
    if not by:
        return None, 0, 0
    whole = next(iter(by.values())).values()
    p0, n0 = sum(x[0] for x in whole), sum(x[1] for x in whole)
    if p0 == 0 or n0 == 0:
        return None, p0, n0
    start = math.log2(p0 / (p0 + n0))
    best: tuple[float, Literal | None] = (0.0, None)
    for name in sorted(by):
        p = n = 0
        for k, cut in enumerate(limits[name]):
            a, b = by[name].get(k, (0, 0))
            p, n = p + a, n + b
            for lit, pp, nn in ((Literal(name, False, cut), p, n), (Literal(name, True, cut), p0 - p, n0 - n)):
                if pp >= MIN_COVER and (gain := pp * (math.log2(pp / (pp + nn)) - start)) > best[0] + 1e-9:
                    best = gain, lit
    return best[1], p0, n0


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[tuple[Literal, ...]]:
    """Ordered conjunctions, each of which rejects a document.

    ``stats`` has (id, base_failed, features) of the labelled documents, ``labels`` (id, 1 good or 0 bad).
    """
    part = F.crc32(F.col("_key").cast("string").cast("binary")) % 3
    rows = (stats.where(~F.col("base_failed")).select(F.col(id_col).alias("_key"), "features")
            .join(F.broadcast(labels.select(F.col(id_col).alias("_key"), (1 - F.col(label_col)).cast("long").alias("bad"))), "_key"))
    rows = checkpointed(rows.select("bad", "features", (part == 0).alias("pruning")).repartition(8))
    probes = [i / BINS for i in range(1, BINS)]
    edges = rows.select(*[F.percentile_approx(F.when(F.col("bad") == bad, F.col(f"features.{f}")), probes, 2000).alias(f"{f}_{bad}")
                          for f in FEATURES for bad in (0, 1)]).first()
    limits = {f: _between(sorted({*(edges[f"{f}_0"] or []), *(edges[f"{f}_1"] or [])})) for f in FEATURES}
    rules: list[tuple[Literal, ...]] = []
    left = rows
    for _ in range(MAX_RULES):
        rule: list[Literal] = []
        growing = left.where(~F.col("pruning"))
        while len(rule) < MAX_LITERALS:
            lit, p, n = _best_literal(growing.where(_all(rule)), limits)
            if lit is None or (rule and p >= MIN_COVER and p / (p + n) >= 0.995):
                break
            rule.append(lit)
        if not rule:
            break
        sums = left.where("pruning").agg(*[F.sum(F.when(_all(rule[:k]), x).otherwise(0)).alias(f"{s}{k}")
                                           for k in range(1, len(rule) + 1) for s, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((sums[f"p{k}"] or 0) - (sums[f"n{k}"] or 0)) / max(1, (sums[f"p{k}"] or 0) + (sums[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        k = worth.index(max(worth)) + 1
        if (1 + max(worth)) / 2 < MIN_PRECISION or (sums[f"p{k}"] or 0) < 2:
            break
        rules.append(tuple(rule[:k]))
        left = left.where(~_all(rule[:k]))
    return rules


def verdict(rules: list[tuple[Literal, ...]]) -> Column:
    """The rule that rejects a row ('base' first), or null: one ordered conditional."""
    out = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        out = out.when(_all(r), F.lit(" and ".join(map(str, r))))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[Literal, ...]]:
    """Learn the list from at most about ``sample`` labelled rows; only these rows' texts are read into statistics."""
    some = bounded_sample(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()), id_col, sample)
    some = some.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    mine = docs.join(F.broadcast(some.select(id_col)), id_col, "left_semi")  # bounded by ``sample``
    mine = one_text_per_id(mine.select(id_col, F.col(text_col).cast("string").alias(text_col)), id_col, text_col)
    return learn(statistics(mine, id_col, text_col), some, id_col, label_col)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Statistics of every document with ``rule`` (null: none) and ``kept``."""
    rules = fit(docs, labels)
    return statistics(docs, keep=keep).withColumn("rule", verdict(rules)).withColumn("kept", F.col("rule").isNull())


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the list keeps, with their own columns."""
    rules = fit(docs, labels)
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    whole = whole.select("_row", F.col("_row")[id_col].alias("_key"), F.col("_row")[text_col].alias("_t"))
    kept = statistics(whole, "_key", "_t", keep=["_row"]).where(verdict(rules).isNull())
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *BASE, "base_failed", "kept", "rule")
