"""Sources and sinks (S1-S3): CSV ingestion, stage checkpoints.

* CSV is read with an explicit schema when one is given (inference costs a
  full pass and turns ``'02'`` into ``2``), line breaks inside quoted values
  in splittable files, and the extra null tokens the reference's reader treats as missing.
* Doubles: NaN becomes null (NaN compares true with ``>=`` in Spark and
  takes part in ``max``/``percentile``).
* ``_row_pos``: the 0-based position in file order (file, split offset,
  position in the split), made dense with the distributed prefix operator;
  order-sensitive operators (first row per notice, first-appearance codes)
  rely on it.
* Stages are written to their own folder; a stage never overwrites the
  folder it reads (that deletes the input before it is read).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from noticeflow.operators import ordered
from noticeflow.session import materialize

# Text tokens read as missing by the reference's CSV reader.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null"]

_CSV_OPTS = {"header": "true", "escape": '"', "quote": '"',
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def clean_types(df: DataFrame) -> DataFrame:
    """NaN -> null for floating columns; null tokens -> null for text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            out[f.name] = F.when(F.col(f.name).isin(*NULL_TOKENS), F.lit(None).cast("string")) \
                           .otherwise(F.col(f.name))
    return df.withColumns(out) if out else df


def with_row_pos(df: DataFrame, col: str = "_row_pos") -> DataFrame:
    """Dense 0-based file-order position; call directly on a file scan."""
    # shorter names first: part-99999 comes before part-100000
    key = F.struct(F.length("_metadata.file_path").alias("n"), F.col("_metadata.file_path").alias("f"),
                   F.col("_metadata.file_block_start").alias("b"),
                   (F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("i"))
    tagged = df.select("*", key.alias("_pos_key"))
    return ordered.global_index(tagged, ["_pos_key"], idx=col).drop("_pos_key")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """Spark's own reader. ``multi_line`` allows line breaks inside quoted
    values, at the price of one task per file; without it large files are split.
    ``read_quoted_csv`` does both."""
    r = spark.read.options(**_CSV_OPTS, multiLine=multi_line)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return clean_types(r.csv(path))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and split; a carriage return stays in the line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _records(batches):
    """Records of the splits of a task, from lines (file, block, quotes before, line).

    A line starts a record if the quotes before it are even. Records that begin
    and end in the split come out whole (part 0); the pieces of those that cross
    its edges as part 1 (begun here), 2 (neither begun nor ended here) or 3 (ended here).
    """
    split, rows, held, odd, number, begun = None, [], [], False, 0, True

    def close(part):
        rows.append((*split, number, part, "\n".join(held)))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES)], names=_RECORD_NAMES)
        rows.clear()
        return out

    for b in batches:
        for f, k, before, line in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (f, k) != split:
                if held:
                    close(1 if begun else 2)
                split, held, odd, number = (f, k), [], before % 2 == 1, 0
                begun = not odd
            held.append(line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                close(0 if begun else 3)
                held, begun, number = [], True, number + 1
            if len(rows) >= 5_000:
                yield batch()
    if held:
        close(1 if begun else 2)
    if rows:
        yield batch()


_RECORD_NAMES = ["file", "block", "number", "part", "record"]
_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, record) of every record of quoted CSV files, header included.

    Whether a line break is inside quotes depends on all quotes before it. They
    are counted per split, summed over the splits before it (one row per split),
    and a second pass starts each split with the right parity, so a large file is
    read by many tasks. A quote inside a value is doubled, which keeps the parity.
    Only the pieces of records that cross a split's edge, two per split at most,
    are shuffled to be joined.
    """
    lines = _lines(spark, path)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q")).select("file", "block", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("before"))
    # one row per split of spark.sql.files.maxPartitionBytes; only in this form lines stay in order and in place
    tagged = lines.join(F.broadcast(materialize(parity)), ["file", "block"]).select("file", "block", "before", "line")
    found = materialize(tagged.mapInArrow(_records, "file string, block long, number long, part int, record string"))
    pieces = found.where("part > 0")
    upto = Window.partitionBy("file").orderBy("block", "number")
    opened = F.count_if(F.col("part") == 1).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = pieces.withColumn("of", opened).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "number", "record"))).alias("p"))
    joined = whole.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["number"].alias("number"), F.array_join(F.col("p.record"), "\n").alias("record"))
    return found.where("part = 0").drop("part").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | None = None, row_pos: str | None = None) -> DataFrame:
    """CSV files with a header whose quoted values may hold line breaks, read in
    many tasks per file. Equals the reader with ``multi_line``; ``row_pos`` adds
    the dense position in file order. Empty lines are no records."""
    if schema is None:
        schema = spark.read.options(**_CSV_OPTS, multiLine=True, inferSchema=True).csv(path).schema
    rows = csv_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
    # the first record of each file is its header
    heads = rows.where("block = 0").groupBy("file").agg(F.min("number").alias("head"))
    rows = rows.join(F.broadcast(heads), "file", "left").where((F.col("block") > 0) | (F.col("number") > F.col("head"))).drop("head")  # one row per file
    opts = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    # names of the schema, not of the file, as with the reader's enforced schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = rows.select("file", "block", "number", F.from_csv("record", fields, opts).alias("_r"))
    if row_pos is None:
        return clean_types(parsed.select("_r.*"))
    key = F.struct(F.length("file").alias("n"), F.col("file").alias("f"), F.col("block").alias("b"), F.col("number").alias("i"))
    placed = ordered.global_index(clean_types(parsed.select("_r.*", key.alias("_pos_key"))), ["_pos_key"], idx=row_pos)
    return placed.drop("_pos_key")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV_OPTS).csv(path)


def convert_csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                           schema: StructType | None = None) -> DataFrame:
    """CSV -> typed, cleaned Parquet with ``_row_pos``; returns the
    re-read Parquet frame."""
    df = read_quoted_csv(spark, csv_path, schema, row_pos="_row_pos")
    write_stage(df, parquet_path)
    return spark.read.parquet(parquet_path)


def write_stage(df: DataFrame, path: str) -> None:
    """S3: one folder per stage (never the folder the stage reads)."""
    df.write.mode("overwrite").parquet(path)

