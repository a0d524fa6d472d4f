"""Stage 01 on Structured Streaming.

The reference reads whole files only and has no streaming operator. The
preparation stage is a chain of stateless row operators, so the same
``prepare`` function runs unchanged on a streaming DataFrame: new notice
files landing in a folder are cleaned incrementally into a stage folder.
Matching and merging need both tables complete and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from noticeflow.plans.prepare import prepare


def prepare_stream(spark: SparkSession, source_dir: str, schema: StructType, side: str,
                   sink_dir: str, checkpoint: str,
                   once: bool = False) -> StreamingQuery:
    """Read Parquet notice files from ``source_dir`` as a stream, apply stage
    01 and append to ``sink_dir``. ``checkpoint`` names the stream's own
    folder on shared storage; a restart with the same folder goes on
    exactly-once."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    w = (prepare(src, side).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w
    return w.start()
