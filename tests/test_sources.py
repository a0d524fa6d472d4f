"""Quoted CSV in many tasks against Spark's own multi-line reader."""

import random

import pytest

from noticeflow.sources import io

SCHEMA = "a int, b string, c string, d double"


def _write(path, rows, sep="\n"):
    q = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    body = sep.join(f"{a},{q(b)},{q(c)},{d}" for a, b, c, d in rows)
    path.write_bytes(("a,b,c,d" + sep + body + sep).encode("utf-8"))


def _rows(n, seed):
    rng = random.Random(seed)
    parts = ["x", "é", '"', ",", "\n", "\n\n", '""', " end", "\r\n", "long " * 30]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), rng.choice([None, "NA", "y", "p\nq"]), rng.choice([1.5, 2.0])) for i in range(n)]


@pytest.mark.parametrize("split", [64, 300, 4096, 1 << 20])
def test_equals_the_multi_line_reader(spark, tmp_path, split):
    for k in range(3):
        _write(tmp_path / f"part-{k}.csv", _rows(120, k))
    (tmp_path / "part-3.csv").write_bytes(b"a,b,c,d\n")          # header only
    (tmp_path / "part-4.csv").write_bytes(b'a,b,c,d\n7,"no end of line\nat all",z,1.0')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        schema = spark.createDataFrame([], SCHEMA).schema
        want = io.read_csv(spark, str(tmp_path), schema, multi_line=True)
        got = io.read_quoted_csv(spark, str(tmp_path), schema, row_pos="_row_pos")
        assert io._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= (30 if split <= 300 else 1)
        assert got.dtypes[:4] == want.dtypes
        assert sorted(map(str, got.drop("_row_pos").collect())) == sorted(map(str, want.collect()))
        order = [r.a for r in got.orderBy("_row_pos").collect()]
        assert order == [*range(120)] * 3 + [7]
        assert sorted(r._row_pos for r in got.collect()) == list(range(361))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_inferred_types_and_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "x.csv", [(1, "one\ntwo", "NA", 1.5), (2, 'say "hi"', None, 2.0)], sep="\r\n")
    out = io.convert_csv_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.dtypes == [("a", "int"), ("b", "string"), ("c", "string"), ("d", "double"), ("_row_pos", "bigint")]
    assert sorted(map(tuple, out.collect())) == [(1, "one\ntwo", None, 1.5, 0), (2, 'say "hi"', None, 2.0, 1)]
