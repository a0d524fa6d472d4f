"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local master without that setting (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it from there.

    The rows survive lost executors, later readers take single columns, and the
    plan of a loop starts anew (a checkpointed plan would keep the constraints
    of all earlier rounds).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the written plan is garbage now; when the driver collects it, Spark's cleaner frees its shuffle files
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``checkpointed`` wrote and that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))



def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of ``key``.

    Two narrow passes: a count and a filter on the hash; no sort, no merge on
    one task. Only fits of classifiers use it.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) < int(2**32 * rows / n))


def one_text_per_id(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, but of an id with several rows one, with the smallest text.

    Only ids are counted at first; texts are grouped only where ids repeat."""
    repeated = checkpointed(rows.groupBy(id_col).count().where("count > 1").select(id_col))
    if repeated.isEmpty():
        return rows
    others = [F.max(c).alias(c) for c in rows.columns if c not in (id_col, text_col)]
    one = rows.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias(text_col), *others)
    return rows.join(repeated, id_col, "left_anti").unionByName(one)


def settled(df: DataFrame, carried: list[str]) -> DataFrame:
    """The same rows, with all but ``carried`` behind a generator.

    A later filter on a costly column is then not pushed below it, where the
    optimizer would spell the column's whole expression out once more.
    """
    made = [c for c in df.columns if c not in carried]
    return df.select(*carried, F.inline(F.array(F.struct(*made))))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task's working set stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
