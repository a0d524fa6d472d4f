"""Distributed exact DBSCAN (M5) as DataFrame joins and aggregations.

Semantics (the usual library's): a point's neighbourhood is every point
within ``eps`` (itself and duplicates included); a point is core when the
neighbourhood holds >= ``min_samples`` points; clusters are the connected
components of core points; a non-core point within ``eps`` of a core point
joins the smallest such cluster; the rest is noise (-1). Clusters are
numbered in the order a sequential scan in ``pos`` order would find them
(by the smallest position of their core points), so the result does not
depend on partitioning.

Plan, with no row cap, no pair enumeration inside a group and no table of close
pairs:

1. identical vectors collapse into one weighted *site* (a hot duplicate
   becomes one row);
2. sites fall into *fine cells* of side ``eps / sqrt(d)``: every two points
   of one cell are neighbours, so within-cell neighbourhoods are cell
   weights, never pairs;
3. cell pairs that can hold neighbours are found on the cell table alone
   (an equi-join on blocks of ``floor(sqrt(d)) + 1`` cells and the 3^d
   neighbouring blocks); a pair whose farthest corners are within ``eps``
   counts by weight. A cell that holds ``min_samples`` points with its full
   neighbours is core without looking at its points;
4. what is left is answered by *descent*: cells are cut into sub-cells of half
   the side, known by the tight box around their points. A sub-cell inside the
   radius counts whole, one outside is dropped, only those on the edge are cut
   again, and a question ends with its first sufficient answer: a site with
   ``min_samples`` neighbours, two core cells with one close pair (the first
   points of two sub-cells are tried as witnesses at each step);
5. core cells are linked by min-label propagation with pointer jumping
   (a cell takes its label's label), so chains converge in about
   log(diameter) rounds; a written table per round, until no label
   changes. The join on labels is salted, as one cluster may own most cells.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import ordered
from noticeflow.session import materialize


# The dimension is known when the plan is built, so distances are written as
# explicit per-index arithmetic: whole-stage codegen compiles it, whereas
# higher-order lambdas would be interpreted for every candidate pair.

def _sq(a: Column, b: Column, dim: int) -> Column:
    return sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(1, dim)),
               (a[0] - b[0]) * (a[0] - b[0]))


def _box(a: Column, b: Column, dim: int, far: bool) -> Column:
    """Squared min (``far=False``) or max distance between two cells, in cell units."""
    def g(i):
        d = F.abs(a[i] - b[i])
        return (d + 1) if far else F.greatest(d - 1, F.lit(0))
    return sum((g(i) * g(i) for i in range(1, dim)), g(0) * g(0)).cast("double")


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the input, by sorting both sides.

    Their Parquet files hold few bytes for many equal coordinates, so by the files'
    size Spark would take a large table for one to broadcast, which the driver then
    holds unpacked."""
    return left.join(right.hint("merge"), on, how)


#: Halvings of a cell before points are compared with points, and parts of a hot label.
LEVELS, SALTS = 8, 8


def _nodes(members: DataFrame, level: int, side: float, dim: int) -> DataFrame:
    """Sub-cells of the members' cells: key, key of the parent, tight box, weight, one of the points."""
    key = F.array(*[F.floor(F.col("_vec")[i] / side * float(1 << level)) for i in range(dim)])
    t = members.select("_fc", "_sid", "_vec", "_w", key.alias("_key")).groupBy("_fc", "_key").agg(
        F.array(*[F.min(F.col("_vec")[i]) for i in range(dim)]).alias("_lo"), F.array(*[F.max(F.col("_vec")[i]) for i in range(dim)]).alias("_hi"),
        F.sum("_w").alias("_w"), F.min(F.struct("_sid", "_vec")).alias("_one"))
    return t.select("_fc", "_key", F.array(*[F.floor(F.col("_key")[i] / 2) for i in range(dim)]).alias("_up"), "_lo", "_hi", "_w", F.col("_one._vec").alias("_one"))


def _sum_sq(terms: list[Column]) -> Column:
    return sum((t * t for t in terms[1:]), terms[0] * terms[0])


def _least_sq(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, dim: int) -> Column:
    return _sum_sq([F.greatest(F.lit(0.0), b_lo[i] - a_hi[i], a_lo[i] - b_hi[i]) for i in range(dim)])


def _most_sq(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, dim: int) -> Column:
    return _sum_sq([F.greatest(a_hi[i] - b_lo[i], b_hi[i] - a_lo[i]) for i in range(dim)])


def _neighbours(asked: DataFrame, group: list[str], members: DataFrame, side: float, dim: int, eps2: float, witness: bool) -> DataFrame:
    """The groups of ``asked`` (point _va, cell _b, _need) whose points have
    members of weight _need within the radius.

    ``witness``: a need of one point, so a sub-cell's first point may answer."""
    c = F.col
    kept = [*dict.fromkeys([*group, "_sid", "_va", "_b", "_need"])]
    open_, key, met = asked.select(*kept), None, []
    seen = None  # (group, weight found so far)
    for level in range(LEVELS + 1):
        nodes = _nodes(members, level, side, dim).withColumnRenamed("_fc", "_b")
        f = _join(open_, nodes, "_b") if key is None else _join(open_.withColumnRenamed("_k", "_up"), nodes, ["_b", "_up"])
        inside = _most_sq(c("_va"), c("_va"), c("_lo"), c("_hi"), dim) <= eps2
        if witness:
            inside = inside | (_sq(c("_va"), c("_one"), dim) <= eps2)
        f = f.where(_least_sq(c("_va"), c("_va"), c("_lo"), c("_hi"), dim) <= eps2)
        f = materialize(f.select(*kept, c("_key").alias("_k"), inside.alias("_in"), "_w"))
        now = f.where("_in").groupBy(*group).agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need"))
        seen = now if seen is None else seen.unionByName(now).groupBy(*group).agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need"))
        seen = materialize(seen)
        done = seen.where("_w >= _need").select(*group)
        open_, key = materialize(_join(f.where("not _in"), done, group, "left_anti").select(*kept, "_k")), "_k"
        if open_.isEmpty():
            return done
    last = members.select(c("_fc").alias("_b"), "_vec", "_w", F.array(*[F.floor(c("_vec")[i] / side * float(1 << LEVELS)) for i in range(dim)]).alias("_k"))
    now = _join(open_, last, ["_b", "_k"]).where(_sq(c("_va"), c("_vec"), dim) <= eps2).groupBy(*group).agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need"))
    return materialize(seen.unionByName(now).groupBy(*group).agg(F.sum("_w").alias("_w"), F.max("_need").alias("_need")).where("_w >= _need").select(*group))


def _linked(pairs: DataFrame, members: DataFrame, side: float, dim: int, eps2: float) -> DataFrame:
    """The cell pairs (_a, _b) with a close pair of members, by descent on both sides."""
    c = F.col
    open_, found = pairs, None
    for level in range(LEVELS + 1):
        nodes = _nodes(members, level, side, dim)
        a = nodes.select(*[c(x).alias(x + "a") for x in nodes.columns])
        b = nodes.select(*[c(x).alias(x + "b") for x in nodes.columns])
        if level == 0:
            f = _join(_join(open_, a, c("_a") == c("_fca")), b, c("_b") == c("_fcb"))
        else:
            f = _join(_join(open_, a, (c("_a") == c("_fca")) & (c("_ka") == c("_upa"))), b, (c("_b") == c("_fcb")) & (c("_kb") == c("_upb")))
        close = (_most_sq(c("_loa"), c("_hia"), c("_lob"), c("_hib"), dim) <= eps2) | (_sq(c("_onea"), c("_oneb"), dim) <= eps2)
        f = f.where(_least_sq(c("_loa"), c("_hia"), c("_lob"), c("_hib"), dim) <= eps2)
        f = materialize(f.select("_a", "_b", c("_keya").alias("_ka"), c("_keyb").alias("_kb"), close.alias("_in")))
        now = f.where("_in").select("_a", "_b").distinct()
        found = materialize(now if found is None else found.unionByName(now))
        open_ = materialize(_join(f, now, ["_a", "_b"], "left_anti").select("_a", "_b", "_ka", "_kb"))
        if open_.isEmpty():
            return found
    key = F.array(*[F.floor(c("_vec")[i] / side * float(1 << LEVELS)) for i in range(dim)])
    last = members.select("_fc", "_vec", key.alias("_k"))
    a = last.select(c("_fc").alias("_a"), c("_k").alias("_ka"), c("_vec").alias("_va"))
    b = last.select(c("_fc").alias("_b"), c("_k").alias("_kb"), c("_vec").alias("_vb"))
    now = _join(_join(open_, a, ["_a", "_ka"]), b, ["_b", "_kb"]).where(_sq(c("_va"), c("_vb"), dim) <= eps2).select("_a", "_b").distinct()
    return materialize(found.unionByName(now))


def dbscan(df: DataFrame, pos: str, vec: str, dim: int, eps: float = 0.5,
           min_samples: int = 5, out: str = "cluster") -> DataFrame:
    """Label every row of ``df`` (``vec``: array<double> of length ``dim``;
    ``pos``: unique row position used for the cluster numbering)."""
    s = eps / math.sqrt(dim)
    r = int(math.floor(math.sqrt(dim))) + 1
    eps2 = eps * eps
    lim = (eps / s) ** 2 + 1e-9  # eps^2 in squared cell units

    v = F.array(*[F.col(vec)[i].cast("double") for i in range(dim)])
    pts = df.select(F.col(pos).alias("_pos"), v.alias("_vec"))
    sites = pts.groupBy("_vec").agg(F.count(F.lit(1)).alias("_w"), F.min("_pos").alias("_sid"))
    sites = sites.withColumn("_fc", F.array(*[F.floor(F.col("_vec")[i] / s) for i in range(dim)])) \
                 .withColumn("_blk", F.array(*[F.floor(F.col("_fc")[i] / r) for i in range(dim)]))
    sites = materialize(sites)

    cells = sites.groupBy("_fc", "_blk").agg(F.sum("_w").alias("_W"))
    offsets = F.array(*[F.array(*[F.lit(o) for o in off])
                        for off in itertools.product((-1, 0, 1), repeat=dim)])
    probe = cells.select(F.col("_fc").alias("_a"), F.explode(offsets).alias("_off"), "_blk") \
                 .select("_a", F.array(*[F.col("_blk")[i] + F.col("_off")[i]
                                         for i in range(dim)]).alias("_blk"))
    other = cells.select(F.col("_fc").alias("_b"), "_blk", F.col("_W").alias("_Wb"))
    pairs = _join(probe, other, "_blk").where(F.col("_a") != F.col("_b")) \
                 .where(_box(F.col("_a"), F.col("_b"), dim, False) <= lim) \
                 .withColumn("_full", _box(F.col("_a"), F.col("_b"), dim, True) <= lim) \
                 .select("_a", "_b", "_Wb", "_full")
    pairs = materialize(pairs)

    # neighbourhood weights: own cell + fully-covered cells; sites of other cells ask for the rest
    full_w = pairs.where("_full").groupBy(F.col("_a").alias("_fc")).agg(F.sum("_Wb").alias("_fw"))
    known = materialize(_join(cells, full_w, "_fc", "left").select("_fc", (F.col("_W") + F.coalesce("_fw", F.lit(0))).alias("_have")))
    part = pairs.where(~F.col("_full")).select("_a", "_b")
    unsure = _join(sites, known.where(F.col("_have") < min_samples), "_fc")
    asked = _join(unsure, part.withColumnRenamed("_a", "_fc"), "_fc") \
                  .select("_sid", F.col("_vec").alias("_va"), "_b", (F.lit(min_samples) - F.col("_have")).alias("_need"))
    crowded = _neighbours(asked, ["_sid"], sites, s, dim, eps2, witness=False)
    marked = _join(_join(sites, known, "_fc"), crowded.select("_sid", F.lit(True).alias("_met")), "_sid", "left")
    sites_n = materialize(marked.select("_sid", "_fc", "_vec", "_w", ((F.col("_have") >= min_samples) | F.coalesce("_met", F.lit(False))).alias("_core")))

    # core cells and their links
    core = sites_n.where("_core")
    ccell = core.groupBy("_fc").agg(F.min("_sid").alias("_lab"))
    cset = ccell.select(F.col("_fc").alias("_x"))
    both = _join(_join(pairs.select("_a", "_b", "_full"), cset.withColumnRenamed("_x", "_a"), "_a", "left_semi"),
                 cset.withColumnRenamed("_x", "_b"), "_b", "left_semi")
    e_part = _linked(both.where(~F.col("_full") & (F.col("_a") < F.col("_b"))).select("_a", "_b"), core, s, dim, eps2)
    edges = both.where("_full").select("_a", "_b").unionByName(e_part).unionByName(e_part.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    edges = materialize(edges.distinct())

    # node id of a core cell = its smallest core site; labels are node ids
    lab = materialize(ccell.select("_fc", F.col("_lab").alias("_id"), "_lab"))
    while True:  # until no label changes
        nb = _join(edges, lab.select(F.col("_fc").alias("_b"), F.col("_lab").alias("_nl")), "_b") \
                  .groupBy(F.col("_a").alias("_fc")).agg(F.min("_nl").alias("_nl"))
        hooked = _join(lab, nb, "_fc", "left") \
                    .select("_fc", "_id", F.least("_lab", F.coalesce("_nl", "_lab")).alias("_lab"),
                            F.coalesce(F.col("_nl") < F.col("_lab"), F.lit(False)).alias("_chg"))
        # pointer jumping: take the label of the node named by the label
        ref = hooked.select(F.col("_id").alias("_lab"), F.col("_lab").alias("_ll"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salted = hooked.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        new = materialize(_join(salted, ref, ["_lab", "_salt"], "left").select(
            "_fc", "_id", F.least("_lab", F.coalesce("_ll", "_lab")).alias("_lab"),
            (F.col("_chg") | F.coalesce(F.col("_ll") < F.col("_lab"), F.lit(False))).alias("_chg")))
        changed = new.where("_chg").limit(1).count()
        lab = new.drop("_chg")
        if changed == 0:
            break
    lab = lab.select("_fc", "_lab")

    ids = ordered.global_index(lab.select("_lab").distinct(), ["_lab"], idx="_cid")
    cell_cid = _join(lab, ids, "_lab").select("_fc", "_cid")
    core_lab = _join(core, cell_cid, "_fc").select("_sid", "_cid")

    # border sites: smallest cluster among the core sites within eps
    border = sites_n.where(~F.col("_core")).select("_sid", "_fc")
    via_own = _join(border, cell_cid, "_fc")
    via_full = _join(_join(border, pairs.where("_full").select(F.col("_a").alias("_fc"), "_b"), "_fc"),
                     cell_cid.withColumnRenamed("_fc", "_b"), "_b")
    near = _join(_join(border, sites_n.select("_sid", "_vec"), "_sid"), part.withColumnRenamed("_a", "_fc"), "_fc")
    ask = _join(near, cset.withColumnRenamed("_x", "_b"), "_b", "left_semi") \
                .select("_sid", F.col("_vec").alias("_va"), "_b", F.lit(1).alias("_need"))
    via_part = _join(_neighbours(ask, ["_sid", "_b"], core, s, dim, eps2, witness=True), cell_cid.withColumnRenamed("_fc", "_b"), "_b")
    border_lab = via_own.select("_sid", "_cid").unionByName(via_full.select("_sid", "_cid")) \
                        .unionByName(via_part.select("_sid", "_cid")) \
                        .groupBy("_sid").agg(F.min("_cid").alias("_cid"))
    site_lab = core_lab.unionByName(border_lab)
    labelled = _join(sites_n.select("_sid", "_vec"), site_lab, "_sid", "left") \
                      .select("_vec", F.coalesce(F.col("_cid"), F.lit(-1)).cast("int").alias(out))
    return _join(df.withColumn("_vec", v), labelled, "_vec").drop("_vec")
