"""Personal data: generators, boosted trees over candidates, calibrated thresholds.

Base kinds (email, ip, card, phone) are exact patterns with their checks. More
generators (``GENERATORS``) propose spans with high recall that may overlap the
base ones: long random-looking tokens, long digit groups, spelled-out mail
addresses. Gradient-boosted trees (Spark ML, fitted here) see format and context
features of a candidate, but not the checks; they learn from candidates that the
checks or a strong context decide (``_weak_label``). The trees are turned into
one Column expression, and a threshold per kind is chosen on a calibration part
so that at least ``PRECISION`` of what it selects is positive. Selected
candidates join the base spans, which always stay; a number inside one adds
nothing and is left out.

Everything per document is one narrow projection of built-in functions: no
shuffle, no Python on executors. The labelled candidates and the calibration are
grouped aggregates over all documents; only the trees are fitted on a bounded
part (``CANDIDATES``), spread over kinds and labels and weighted back, and read
into a few driver-side tree nodes.

Rows: null text counts as empty and has no spans; repeated rows repeat;
without both classes of candidates nothing is added to the base; offsets are
code points, end exclusive; other columns are carried only where asked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import checkpointed, settled

#: Candidates that the fit may train on.
CANDIDATES = 20_000
TREES, DEPTH, PRECISION, LEAST_CALIBRATION = 8, 3, 0.98, 3
BINS = 50

# The patterns match what the plain forms of the contract match. Possessive
# loops keep Java from recursing on long runs, and a match may only begin where
# a run begins or the last match ended, which keeps long runs linear.
_MAIL_SIGN, _HOST_SIGN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL_SIGN})){_MAIL_SIGN}++@{_HOST_SIGN}++(?:\.{_HOST_SIGN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+",
    "mail_words": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)+",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20./()-]{0,2}+[0-9]){8,}+(?![A-Za-z])",
}
#: Kinds in the order of a span list.
KINDS = [*BASE, *GENERATORS]
CONTEXT = 24
KEYWORD = r"(?i)(?:token|secret|passw(?:or)?d|api.?key|access.?key|auth|bearer|iban|ssn|tel|phone|mail|card|konto|account)[^\n]{0,8}$"
NUMERIC = ["n_digits", "n_letters", "n_capitals", "n_separators", "n_distinct", "hex_share", "digit_share", "runs"]
FEATURES = ["length", *NUMERIC, "keyword", "assigned", "quoted", "after_letter", "before_letter", "plus", *(f"is_{k}" for k in KINDS)]


def _bound(x: Column, use) -> Column:
    """``use(x)`` with x evaluated once; inside a lambda a plain column would be evaluated for each element."""
    return F.transform(F.array(x), use)[0]


#: Elements whose results are gathered before they join the others'.
PART = 64


def _in_parts(rows: Column, start: Column, step, kind: str) -> Column:
    """The ``out`` array of an aggregate with state (at, out), gathered in parts of ``PART``
    elements: appending one by one would copy all earlier elements each time."""
    parts = _bound(rows, lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(r, i + 1, PART)))

    def whole(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))
    zero = F.struct(start["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(parts, zero, whole, lambda a: a["out"]))


def _spans(text: Column, kind: str, pattern: str, needs: str | None = None) -> Column:
    """array<struct<kind, start, end, hit, before, after>> of all leftmost non-overlapping matches.

    The pieces between matches and the matches come from the same scan, so a
    running sum of their lengths gives every match's place.
    """
    kinds = "array<struct<kind:string,start:int,stop:int,hit:string,before:string,after:string>>"
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["h"])
        one = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), x["h"].alias("hit"),
                       F.right(x["g"], F.lit(CONTEXT)).alias("before"), F.left(x["n"], F.lit(2)).alias("after"))
        return F.struct(stop.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))
    rows = _bound(gaps, lambda g: F.transform(hits, lambda h, i: F.struct(h.alias("h"), F.get(g, i).alias("g"), F.get(g, i + 1).alias("n"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))
    found = _in_parts(rows, start, step, kinds)
    test = F.size(gaps) > 1
    if needs is not None:
        test = F.contains(text, F.lit(needs)) & test
    return F.when(test, found).otherwise(F.array().cast(kinds))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.split(F.reverse(_digits(x)), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(s: Column) -> Column:
    """The check of a base kind."""
    n = F.length(_digits(s["hit"]))
    octets = F.split(s["hit"], r"\.")
    return (F.when(s["kind"] == "ip", F.forall(octets, lambda o: F.regexp_replace(o, "^0+(?=.)", "").rlike("^([0-9]|[0-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")))
            .when(s["kind"] == "card", F.when((n >= 16) & (n <= 19), _luhn(s["hit"])).otherwise(False))
            .when(s["kind"] == "phone", (n >= 8) & (n <= 15))
            .otherwise(s["kind"] == "email"))


def candidates(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``base`` (valid spans), ``failed`` (base matches that fail) and ``extra`` (generators' spans)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(*keep, text.alias("_text"))
    needs = {"email": "@", "ip": ".", "phone": "+"}
    parts = {k: _spans(F.col("_text"), k, p, needs.get(k)) for k, p in BASE.items()}
    more = {k: _spans(F.col("_text"), k, p) for k, p in GENERATORS.items()}
    d = settled(d.select(*keep, F.concat(*parts.values()).alias("all"), F.concat(*more.values()).alias("extra")), keep)
    checked = F.transform("all", lambda s: F.struct(_valid(s).alias("ok"), s.alias("s")))
    d = settled(d.select(*keep, checked.alias("checked"), "extra"), keep)
    pick = lambda good: F.transform(F.filter("checked", lambda x: x["ok"] == F.lit(good)), lambda x: x["s"])
    return d.select(*keep, pick(True).alias("base"), pick(False).alias("failed"), "extra")


def _features(s: Column) -> dict[str, Column]:
    hit = s["hit"]
    n = F.length(hit)
    removed = lambda signs: n - F.length(F.translate(hit, signs, ""))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    before = s["before"]
    out = {"length": n, "n_digits": removed(digits), "n_letters": removed(lower + upper), "n_capitals": removed(upper),
           "n_separators": n - removed(lower + upper + digits), "n_distinct": F.size(F.array_distinct(F.split(hit, ""))),
           "hex_share": removed("abcdefABCDEF" + digits) / n, "digit_share": removed(digits) / n,
           "runs": F.size(F.split(hit, "[^0-9]++")), "keyword": before.rlike(KEYWORD), "assigned": before.rlike("[=:][\\x20\"']*$"),
           "quoted": before.rlike("[\"']$"), "after_letter": before.rlike("[A-Za-z]$"), "before_letter": s["after"].rlike("^[A-Za-z]"), "plus": hit.startswith("+")}
    out |= {f"is_{k}": s["kind"] == k for k in KINDS}
    return {k: v.cast("double") for k, v in out.items()}


def _weak_label(s: Column, origin: Column, base: Column) -> Column:
    """1 or 0 where a check or a strong context decides, else null."""
    met = F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    decided = s["before"].rlike(r"(?i)(?:token|secret|passw(?:or)?d|api.?key|access.?key)[\x20]*[=:][\x20\"']*$")
    mixed = s["hit"].rlike("[A-Za-z]") & s["hit"].rlike("[0-9]")
    return (F.when(origin == "base", 1.0).when(origin == "failed", 0.0)
            .when(s["kind"] == "secret", F.when(decided & mixed, 1.0).when(~s["before"].rlike("[=:\"'][\\x20\"']*$"), 0.0))
            .when(s["kind"] == "mail_words", F.when(s["hit"].rlike(r"(?i)dot|\.[a-z]{2,6}$"), 1.0).otherwise(0.0))
            .when(s["kind"] == "number", F.when(met | s["before"].rlike(KEYWORD), 1.0).otherwise(0.0)))


@dataclass
class Model:
    """Weighted trees as nested tuples, and the threshold of every added kind."""
    trees: list[tuple[float, tuple]] = field(default_factory=list)
    limits: dict[str, float] = field(default_factory=dict)

    def score(self, features: dict[str, Column]) -> Column:
        def column(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            f, limit, left, right = node
            return F.when(features[FEATURES[f]] <= limit, column(left)).otherwise(column(right))
        margin = sum((F.lit(w) * column(t) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _node(n) -> tuple:
    if n.getClass().getSimpleName() == "LeafNode":
        return (float(n.prediction()),)
    return int(n.split().featureIndex()), float(n.split().threshold()), _node(n.leftChild()), _node(n.rightChild())


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trees and thresholds from the candidates of all documents."""
    some = candidates(df.select(id_col, text_col), [id_col], text_col)
    tagged = lambda origin: F.transform(origin, lambda s: F.struct(F.lit(origin).alias("origin"), s.alias("s")))
    rows = some.select("base", F.explode(F.concat(*map(tagged, ("base", "failed", "extra")))).alias("o")).select("base", "o.origin", "o.s")
    s = F.col("s")
    # one vote per text of a candidate: copies of a document don't count again
    rows = rows.select(F.crc32(s["hit"].cast("binary")).alias("h"), s["kind"].alias("kind"), _weak_label(s, F.col("origin"), F.col("base")).alias("label"),
                       F.array(*[c.alias(k) for k, c in _features(s).items()]).alias("x")).where("label is not null")
    rows = rows.groupBy("h", "kind", "label").agg(F.min("x").alias("x"))
    rows = checkpointed(rows)
    train = rows.where(F.col("h") % 4 != 0)
    sizes = train.groupBy("kind", "label").count().collect()  # at most two per kind
    if len({r.label for r in sizes}) < 2:
        return Model()
    share = F.lit(1.0)  # of a kind and label that the fit takes
    for r in sizes:
        share = F.when((F.col("kind") == r.kind) & (F.col("label") == r.label), min(1.0, CANDIDATES / len(sizes) / r["count"])).otherwise(share)
    if sum(r["count"] for r in sizes) <= CANDIDATES:
        share = F.lit(1.0)
    train = train.withColumn("share", share).where(F.crc32(F.col("h").cast("string").cast("binary")) < F.col("share") * 2**32)
    train = checkpointed(train.select("label", (1 / F.col("share")).alias("weight"), "x").repartition(1)).select("label", "weight", array_to_vector("x").alias("features"))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False, weightCol="weight").fit(train)
    model = Model([(float(w), _node(t._call_java("rootNode"))) for w, t in zip(gbt.treeWeights, gbt.trees)])
    probability = model.score({k: F.col("x")[i] for i, k in enumerate(FEATURES)})
    held = (rows.where(F.col("h") % 4 == 0).select("kind", F.floor(probability * BINS).alias("bin"), "label")
            .groupBy("kind", "bin").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect())
    def limit(bins: list) -> float | None:
        p, n, low = 0, 0, None
        for r in sorted(bins, key=lambda r: -r.bin):
            p, n = p + r.p, n + r.n
            if n >= LEAST_CALIBRATION and p >= PRECISION * n:
                low = r.bin / BINS
        return low
    known = {r.kind for r in rows.where("label = 1").select("kind").distinct().collect()}
    for kind in GENERATORS:
        mine = [r for r in held if r.kind == kind]
        # a kind with too few candidates to calibrate alone takes the limit of all kinds
        low = limit(mine) if sum(r.n for r in mine) >= 4 * LEAST_CALIBRATION else limit(held)
        if kind in known and low is not None:
            model.limits[kind] = max(0.5, low)
    return model


def find(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (base and selected candidates, by kind as listed, then start)."""
    d = candidates(df, keep, text_col)
    picked = F.array().cast(d.schema["extra"].dataType)
    if model.limits:
        def wanted(s: Column) -> Column:
            p = model.score(_features(s))
            out = F.lit(False)
            for kind, limit in model.limits.items():
                out = out | ((s["kind"] == kind) & (p >= limit))
            inside = F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
            return out & ~((s["kind"] == "number") & inside)
        picked = F.filter("extra", wanted)
    return d.select(*keep, "base", F.concat("base", picked).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with every span replaced by its kind in brackets; overlapping spans become one.

    A null text stays null.
    """
    d = find(df.select(F.struct(*df.columns).alias("_row"), F.col(text_col).alias("_t")), model, ["_row"], "_t")
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    d = d.select("_row", ordered.alias("_o"))
    text = F.col("_row")[text_col]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate("_o", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size("_o") > 0, done).otherwise(text)
    return d.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])


def redacted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``redact`` for the documents table: ``n_chars``, where there is one, counts the new text."""
    out = redact(docs, model)
    if "n_chars" not in docs.columns:
        return out
    count = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[count.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
