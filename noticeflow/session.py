"""Session helpers: building a local session for tests/bench, and finding the
shared checkpoint directory the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for correctness/scale regardless of where we run.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "noticeflow", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster,
    where the session comes from the launcher)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("NOTICEFLOW_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) do we create a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext access: the configured folder is used
        sc = None
    if sc is not None and not d:
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="noticeflow-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() if sc is not None else None) or d


def stage_dir(spark: SparkSession, name: str) -> str:
    """A folder for a written stage table under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/stages/{name}"


def materialize(df):
    """Write ``df`` as Parquet below the shared checkpoint folder and read it.

    Used where one intermediate table feeds several readers (fences, codes,
    stage tables), so the upstream joins run once. Later readers take only the
    columns they need, with filters pushed into the scan, and the table
    survives the loss of executors. Every call has a folder of its own, so a
    table is never stale within the run that wrote it."""
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def materialized(df):
    """``df`` itself if it is a written table already, else its written form."""
    return df if "_written_to" in vars(df) else materialize(df)


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads again."""
    for df in tables:
        delete_folder(df.sparkSession, df._written_to)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder through Spark's file systems, wherever it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
