"""Stage 01 on Structured Streaming equals the batch stage."""

import tempfile

from noticeflow.plans.prepare import prepare
from noticeflow.sources import fixtures
from noticeflow.streaming import prepare_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="nf-stream-src-", dir="/tmp")
    sink = tempfile.mkdtemp(prefix="nf-stream-sink-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="nf-stream-ckpt-", dir="/tmp")
    raw = fixtures.cfc(spark, SF_SMALL)
    raw.write.mode("overwrite").parquet(src + "/part")
    q = prepare_stream(spark, src + "/part", raw.schema, "cfc", sink, ckpt, once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    want = prepare(raw, "cfc")
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
