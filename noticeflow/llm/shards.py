"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their md5. The
smallest shard capacity for which a greedy left-to-right filling needs no more
than the wanted number of shards is found by binary search, and the groups are
cut where that filling cuts them.

The search never sees all groups. A table of (prefix of the md5, sum, count) is
refined only where a cut may fall: with a lower and an upper bound of the
capacity, greedy filling in the coarse table shows the prefixes that may hold a
cut for any capacity between them; those are split into longer prefixes by a
grouped aggregate, until each is a single group. The first table has 16 ** 3
rows, and a refinement splits about shards ** 2 / 2 prefixes at most, so the
driver holds a bounded table at any input size. Shards of rows then
come from comparing the md5 with at most 39 constants; slots are numbered within
salted parts of a shard, so no window holds a whole shard.

Rows: size is the UTF-8 bytes of the text plus 16; a null text has none, and
its group is that of the empty text; repeated rows get slots of their own; an
empty table gives an empty table; other columns are not read. A group larger
than an even share has a shard of its own, as large as it is; the others share
what is left evenly.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from noticeflow.llm.common import checkpointed

#: Hex digits of the first table's prefixes (16 ** 3 rows), and how many more each refinement adds.
FIRST, MORE = 3, 2
#: Rows per salted part of a shard, about.
PART_ROWS = 200_000


def _next(prefix: list[int], whole: list[bool], at: int, capacity: int, fluid: bool) -> int:
    """Where a shard that starts at byte ``at`` ends if filled greedily.

    A cut falls between items; with ``fluid`` it may also fall inside an item
    that is not one group (``whole`` says which are).
    """
    end = at + capacity
    if end >= prefix[-1]:
        return prefix[-1]
    k = bisect_right(prefix, end) - 1
    return end if fluid and not whole[k] else prefix[k]


def _ends(prefix: list[int], whole: list[bool], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Ends of the greedily filled shards, up to ``shards`` of them."""
    out: list[int] = []
    at = 0
    while at < prefix[-1] and len(out) < shards:
        at = _next(prefix, whole, at, capacity, fluid)
        out.append(at)
    return out


def smallest_capacity(sizes: list[int], whole: list[bool], shards: int, least: int, fluid: bool) -> int:
    """Binary search of the smallest capacity (from ``least``) whose greedy filling holds everything in ``shards`` shards."""
    prefix = list(accumulate(sizes, initial=0))
    lo, hi = max([least, -(-prefix[-1] // shards)] + ([] if fluid else sizes)), max(prefix[-1], least)
    while lo < hi:
        mid = (lo + hi) // 2
        done = _ends(prefix, whole, mid, shards, fluid)[-1:] == [prefix[-1]]
        lo, hi = (lo, mid) if done else (mid + 1, hi)
    return lo


def cut_keys(groups: DataFrame, shards: int) -> list[str]:
    """First md5 of every shard but the first, of ``groups`` (key, bytes)."""
    def table(digits: int, among: list[str] | None = None) -> dict[str, tuple[int, int, int]]:
        rows = groups if among is None else groups.where(F.substring("key", 1, len(among[0])).isin(among))
        found = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m"))
        return {r.p: (r.s, r.n, r.m) for r in found.collect()}

    items = table(FIRST)
    biggest = max([0, *(m for _, _, m in items.values())])
    while items:
        keys = sorted(items)
        sums, whole = [items[k][0] for k in keys], [items[k][1] == 1 for k in keys]
        prefix = list(accumulate(sums, initial=0))
        # cuts anywhere inside items of several groups: no capacity below works; no cuts inside: this one works
        low = smallest_capacity(sums, whole, shards, biggest, True)
        high = smallest_capacity(sums, whole, shards, biggest, False)
        late = _ends(prefix, whole, high, shards, True)
        at, open_ = 0, set()
        for k in range(shards):
            # the k-th cut of the best filling lies between these two places
            at = _next(prefix, whole, at, low, False)
            top = late[k] if k < len(late) else prefix[-1]
            a, b = bisect_right(prefix, at) - 1, bisect_right(prefix, top) - 1
            open_.update(x for x in range(a, min(b, len(keys) - 1) + 1) if not whole[x])
            if at >= prefix[-1]:
                break
        if not open_:
            starts = {x: k for k, x in zip(keys, prefix)}
            return [starts[x] for x in _ends(prefix, whole, high, shards, False) if x in starts]
        for n in sorted({len(keys[x]) for x in open_}):
            among = [keys[x] for x in sorted(open_) if len(keys[x]) == n]
            for p in among:
                del items[p]
            items |= table(n + MORE, among)
    return []


def _shard(cuts: list[str]) -> Column:
    out: Column = F.lit(0)
    for c in cuts:
        out = out + F.when(F.col("key") >= c, 1).otherwise(0)
    return out.cast("int")


def _largest(groups: DataFrame, cuts: list[str]) -> int:
    return groups.groupBy(_shard(cuts).alias("s")).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] or 0


def even_cuts(groups: DataFrame, shards: int) -> list[str]:
    """First md5 of every shard but the first.

    A group of more than an even share sets the smallest capacity, and filling all
    shards up to it would leave most of them empty. Such a group gets a shard of
    its own, and each stretch between these groups an own minimax partition, with
    shards in proportion to its bytes, as long as no shard grows beyond the smallest capacity.
    """
    plain = cut_keys(groups, shards)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = sorted((r.bytes, r.key) for r in groups.where(F.col("bytes") * shards > total).collect())  # fewer than ``shards``
    if shards < 2 or not large:
        return plain
    capacity = _largest(groups, plain)
    for k in range(len(large)):
        own = sorted(key for _, key in large[k:])
        place = F.size(F.filter(F.array(*map(F.lit, own)), lambda x: x < F.col("key")))
        rest = groups.where(~F.col("key").isin(own)).withColumn("stretch", place)
        sizes = {r.stretch: (r.b, r.first) for r in rest.groupBy("stretch").agg(F.sum("bytes").alias("b"), F.min("key").alias("first")).collect()}
        if len(own) + len(sizes) > shards:
            continue
        many = dict.fromkeys(sizes, 1)
        for _ in range(shards - len(own) - len(sizes)):
            if many:
                many[max(many, key=lambda x: (sizes[x][0] / many[x], -x))] += 1
        starts = {*own, *(first for _, first in sizes.values())}
        for x, n in many.items():
            if n > 1:
                starts.update(cut_keys(rest.where(F.col("stretch") == x).select("key", "bytes"), n))
        cuts = sorted(starts)[1:]
        if _largest(groups, cuts) <= capacity:
            return cuts
    return plain


def assign(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, by law ``bytes``."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), (F.when(F.col(text_col).isNull(), 0).otherwise(F.length(raw)) + 16).cast("long").alias("size"),
                     F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts = even_cuts(groups, shards)
    parts = max(8, rows.count() // (shards * PART_ROWS) + 1)
    salted = rows.withColumn("shard", _shard(cuts)).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    counts = salted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "part", F.coalesce("base", F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "id")) - 1
    placed = salted.withColumn("own", own).join(before, ["shard", "part"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
