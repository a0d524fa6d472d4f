"""Notice- and lot-level matching.

The reference builds Python sets of ids and masks each frame with ``isin``.
Here each split is a semi-join (matched) or anti-join (orphans) against the
*distinct* keys of the other side, so no join can fan out, and AQE may turn
it into a broadcast join at run time when the key set turns out small.

Null keys never match (as in the reference, where ``isin`` on a missing id
is false). A third of a table can have no award id; such rows must not all
hash to one shuffle partition: semi-joins drop them before the shuffle, and
anti-joins and tagging give them unique never-matching surrogate keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import as_text, id_key, normalize_id

NO_LOT = "NO_LOT_DEFINED"
CFC_NOTICE = "FUTURE_CAN_ID"
CAN_NOTICE = "ID_NOTICE_CAN"


@dataclass
class Split:
    """The four lazy frames of a split; all share the same key sets."""
    cfc_matched: DataFrame
    cfc_orphans: DataFrame
    can_matched: DataFrame
    can_orphans: DataFrame

    def finalize(self) -> tuple[DataFrame, DataFrame]:
        """Keep the matched frames, discard the orphans."""
        return self.cfc_matched, self.can_matched


def _require(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing key column(s) {missing}; have {df.columns}")


def _keys(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Distinct non-null key tuples under the given output names."""
    k = df.select(*[e.cast("string").alias(n) for n, e in exprs.items()]).dropna()
    return k.distinct()


# A prefix no real key text carries: null keys become unique never-matching
# surrogates, so they spread over all partitions in one pass instead of
# hashing to a single task (and the input is not scanned twice).
_NULL_SALT = "\u0001null:"


def _keyed(df: DataFrame, key_exprs: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(key_exprs))]
    tmp = df.withColumns(dict(zip(names, key_exprs)))
    any_null = F.lit(False)
    for n in names:
        any_null = any_null | F.col(n).isNull()
    salt = F.concat(F.lit(_NULL_SALT), F.monotonically_increasing_id().cast("string"))
    tmp = tmp.withColumn(names[0], F.when(any_null, salt).otherwise(F.col(names[0]).cast("string")))
    return tmp, names


def semi_anti(df: DataFrame, key_exprs: list[Column], keys: DataFrame,
              how: str) -> DataFrame:
    """``left_semi``/``left_anti`` of ``df`` against a distinct key table.

    ``keys`` has columns ``_k0.._kn`` (text) matching ``key_exprs``. Null
    keys never match; on the anti side they are kept."""
    names = [f"_k{i}" for i in range(len(key_exprs))]
    if how == "left_semi":
        # Catalyst drops null join keys before the shuffle: no routing needed
        tmp = df.withColumns(dict(zip(names, key_exprs)))
        return tmp.join(keys, on=names, how=how).drop(*names)
    tmp, names = _keyed(df, key_exprs)
    return tmp.join(keys, on=names, how=how).drop(*names)


def tag_matched(df: DataFrame, key_exprs: list[Column], keys: DataFrame,
                flag: str = "_matched") -> DataFrame:
    """Add a boolean ``flag``: does the row's key occur in ``keys``?

    One left join against distinct keys (no fan-out) instead of a semi- and
    an anti-join, so aggregates over matched and orphan rows read the table
    once. Null keys get never-matching surrogates (flag false)."""
    tmp, names = _keyed(df, key_exprs)
    hit = keys.select(*names).withColumn(flag, F.lit(True))
    return (tmp.join(hit, on=names, how="left")
               .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop(*names))


# --- notice level (J1) -------------------------------------------------------

def _dtype(df: DataFrame, c: str):
    return df.schema[c].dataType


def _notice(df: DataFrame, c: str) -> Column:
    """The one key expression of all notice-level paths."""
    return id_key(F.col(c), _dtype(df, c))



def notice_keys(df_cfc: DataFrame, df_can: DataFrame) -> DataFrame:
    """Ids present on both sides (exact text, or equal numbers)."""
    _require(df_cfc, [CFC_NOTICE])
    _require(df_can, [CAN_NOTICE])
    a = _keys(df_cfc, {"_k0": _notice(df_cfc, CFC_NOTICE)})
    b = _keys(df_can, {"_k0": _notice(df_can, CAN_NOTICE)})
    return a.intersect(b)


def split_by_notice(df_cfc: DataFrame, df_can: DataFrame) -> Split:
    """Split both tables into matched / orphan rows by raw notice id."""
    _require(df_cfc, [CFC_NOTICE])
    _require(df_can, [CAN_NOTICE])
    kc, ka = [_notice(df_cfc, CFC_NOTICE)], [_notice(df_can, CAN_NOTICE)]
    can_ids = _keys(df_can, {"_k0": ka[0]})
    cfc_ids = _keys(df_cfc, {"_k0": kc[0]})
    return Split(semi_anti(df_cfc, kc, can_ids, "left_semi"),
                 semi_anti(df_cfc, kc, can_ids, "left_anti"),
                 semi_anti(df_can, ka, cfc_ids, "left_semi"),
                 semi_anti(df_can, ka, cfc_ids, "left_anti"))


# --- lot level (J2) ----------------------------------------------------------

def lot_key_exprs(df: DataFrame, notice_col: str) -> list[Column]:
    """F15 + F16: normalised (notice, lot) pair; a null lot is NO_LOT_DEFINED.

    Kept as two join columns instead of the reference's ``a---b`` string:
    cheaper to hash and free of separator collisions.
    """
    _require(df, [notice_col, "ID_LOT"])
    notice = normalize_id(F.col(notice_col), _dtype(df, notice_col))
    lot = normalize_id(F.coalesce(as_text(F.col("ID_LOT"), _dtype(df, "ID_LOT")), F.lit(NO_LOT)))
    return [notice, lot]


def lot_keys(df_cfc: DataFrame, df_can: DataFrame) -> DataFrame:
    """Normalised (notice, lot) pairs present on both sides."""
    a = _keys(df_cfc, dict(zip(["_k0", "_k1"], lot_key_exprs(df_cfc, CFC_NOTICE))))
    b = _keys(df_can, dict(zip(["_k0", "_k1"], lot_key_exprs(df_can, CAN_NOTICE))))
    return a.intersect(b)


def split_by_lot(df_cfc: DataFrame, df_can: DataFrame) -> Split:
    """Split both tables by the normalised (notice, lot) pair."""
    kc, ka = lot_key_exprs(df_cfc, CFC_NOTICE), lot_key_exprs(df_can, CAN_NOTICE)
    can_k = _keys(df_can, dict(zip(["_k0", "_k1"], ka)))
    cfc_k = _keys(df_cfc, dict(zip(["_k0", "_k1"], kc)))
    return Split(semi_anti(df_cfc, kc, can_k, "left_semi"),
                 semi_anti(df_cfc, kc, can_k, "left_anti"),
                 semi_anti(df_can, ka, cfc_k, "left_semi"),
                 semi_anti(df_can, ka, cfc_k, "left_anti"))


def with_ids(df: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``df`` whose raw values of ``names`` occur together in ``ids``; the first
    one is never null there, others match null with null."""
    k = ids.select(*[F.col(n).alias(f"_w{i}") for i, n in enumerate(names)])
    on = F.col(names[0]) == F.col("_w0")
    for i, n in enumerate(names[1:], 1):
        on = on & F.col(n).eqNullSafe(F.col(f"_w{i}"))
    return df.join(k, on, "left_semi")


def tag_by_notice(df: DataFrame, side: str, other: DataFrame) -> DataFrame:
    """Tag rows of one side (``'cfc'``/``'can'``) as notice-matched or not."""
    mine, theirs = (CFC_NOTICE, CAN_NOTICE) if side == "cfc" else (CAN_NOTICE, CFC_NOTICE)
    return tag_matched(df, [_notice(df, mine)], _keys(other, {"_k0": _notice(other, theirs)}))


def tag_by_lot(df: DataFrame, side: str, other: DataFrame) -> DataFrame:
    """Tag rows of one side as lot-matched or not."""
    mine, theirs = (CFC_NOTICE, CAN_NOTICE) if side == "cfc" else (CAN_NOTICE, CFC_NOTICE)
    ok = _keys(other, dict(zip(["_k0", "_k1"], lot_key_exprs(other, theirs))))
    return tag_matched(df, lot_key_exprs(df, mine), ok)


def split_counts(df_cfc: DataFrame, df_can: DataFrame, level: str) -> DataFrame:
    """(Frame, Rows): matched and orphan rows of both sides and shared keys (J6),
    at ``'notice'`` or ``'lot'`` level, without building the four frames.

    One tagged union of the keys, counted per key and side (which combines before
    the shuffle, null keys as one group), then one conditional sum."""
    def keyed(df: DataFrame, notice: str, side: str) -> DataFrame:
        _require(df, [notice])
        exprs = [_notice(df, notice)] if level == "notice" else lot_key_exprs(df, notice)
        return df.select(*[e.cast("string").alias(f"_k{i}") for i, e in enumerate(exprs)], F.lit(side).alias("_side"))

    both = keyed(df_cfc, CFC_NOTICE, "cfc").unionByName(keyed(df_can, CAN_NOTICE, "can"))
    names = [c for c in both.columns if c != "_side"]
    per = both.groupBy(*names).agg(*[F.count_if(F.col("_side") == s).alias(s) for s in ("cfc", "can")])
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    met = known & (F.col("cfc") > 0) & (F.col("can") > 0)
    total = lambda side, when: F.coalesce(F.sum(F.when(when, F.col(side)).otherwise(0)), F.lit(0)).cast("bigint")
    a = per.agg(*[total(s, w).alias(f"{s}_{n}") for s in ("cfc", "can") for n, w in (("matched", met), ("orphans", ~met))], F.count_if(met).alias("shared_keys"))
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("Frame"), F.col(c).alias("Rows")) for c in a.columns])))
