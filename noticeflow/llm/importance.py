"""Resampling documents towards a target's distribution by hashed n-gram importance.

Each text becomes a bag of hashed n-grams. A bucket's gain is the logarithm of
its smoothed share among the target's features over that among all documents';
a document's weight is the sum of the gains of its features. Documents are drawn
without replacement by the Gumbel trick: the greatest scores, weight plus a noise
that the document's id fixes.

The n-grams come from an overlapped scan: all separators become one space, then
``regex.finditer(..., overlapped=True)`` with look-arounds for word boundaries
gives the span of every run of n words, and the checksum of the bytes in the
span its bucket. Texts are scanned once; their bucket numbers are kept as a
table, from which counts and weights are taken. The table of gains has one entry
per bucket at any input size. Ranks come from a range-partitioned sort and
offsets per partition, so no task sees all scores.

Rows: null texts or texts without words have no features and weight 0; a null id
takes part with an empty id in its noise and comes before others of its score;
repeated rows are rows of their own and are drawn one by one; an empty table
gives an empty table; without target texts all gains come from smoothing; columns
other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import checkpointed, pieces

#: A-Z become a-z, all bytes of the class [\x00-\x2F\x3A-\x60\x7B-\x7F] a space; bytes from 0x80 on belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_SPACES = regex.compile(rb" {2,}")


def patterns(max_n: int) -> list[regex.Pattern]:
    """One pattern per n: n words between single spaces, from a word's start to a word's end."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1) if n > 1 else rb"(?<![^ ])[^ ]+(?![^ ])") for n in range(1, max_n + 1)]


def features(text: str | None, scans: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature) of a text."""
    raw = _SPACES.sub(b" ", (text or "").encode("utf-8").translate(_TABLE)).strip(b" ")
    view, n_words, out = memoryview(raw), 0, []
    for scan in scans:
        spans = [m.span() for m in scan.finditer(raw, overlapped=True)]
        n_words = n_words or len(spans)
        out += [zlib.crc32(view[a:b]) for a, b in spans]
    return n_words, np.array(out, np.int64) % buckets


def scanned(df: DataFrame, id_col: str, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(id, n_words, features) of every row; ``features`` holds 32-bit bucket numbers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = patterns(max_n)
        for b in pieces(batches):
            n, found = [], []
            for t in b.column(1).to_pylist():
                words, f = features(t, scans, buckets)
                n.append(words)
                found.append(f.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["id", "n_words", "features"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, features binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; at most ``buckets`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in pieces(batches):
            for f in b.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(f, "<i4"), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the source)) of each bucket, both smoothed by one."""
    k = source.size
    s, t = float(int(source.sum()) + k), float(int(target.sum()) + k)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of scanned rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [np.frombuffer(f, "<i4") for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.size for f in found], pa.int64()), pa.array([int(gain[f].sum()) for f in found], pa.int64())],
                                             names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "n_words", "features").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; rows that are not drawn have no rank.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100)
    greatest scores are drawn; equal scores by id.
    """
    held = checkpointed(scanned(docs, id_col, text_col, max_n, buckets))
    wanted = scanned(target, text_col, text_col, max_n, buckets)
    rows = weighted(held, gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)

    # range partitions in the order of the draw; a row's place is its partition's offset and its place in it
    order = [F.desc("able"), F.desc("score"), F.asc("id"), F.asc("salt")]
    task = F.spark_partition_id().cast("long")
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("part", task).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(task, 33)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("able").alias("n_able"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n_able").over(Window.partitionBy()).alias("total"))
    rank = F.col("offset") + F.col("at") - F.col("first") + 1
    drawn = F.col("able") & (rank <= F.expr(f"{int(percent)} * total div 100"))
    return placed.join(sizes, "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
