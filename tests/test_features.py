"""The encoded vector, slot by slot."""

from pyspark.ml.functions import vector_to_array

from noticeflow.operators.features import fit_preprocessor


def test_slots_of_several_category_columns(spark):
    train = spark.createDataFrame([("a", "x", "p", 0.0), ("b", "y", "q", 1.0), ("c", "z", "q", 3.0), (None, "z", "q", 3.0)], "c1 string, c2 string, c3 string, n double")
    pre = fit_preprocessor(train, ["c1", "c2", "c3"], ["n"])
    assert pre.feature_names() == ["n", "c1_b", "c1_c", "c2_y", "c2_z", "c3_q"]
    rows = spark.createDataFrame([(1, "a", "x", "p", 0.0), (2, "c", "y", "q", None), (3, "new", "z", "new", 1.0), (4, None, None, None, 1.0)], "id int, c1 string, c2 string, c3 string, n double")
    got = {r.id: list(r.v[1:]) for r in pre.transform(rows).select("id", vector_to_array("features").alias("v")).collect()}
    # the mode stands in for nulls: a (smallest of equals), z, q
    assert got == {1: [0, 0, 0, 0, 0], 2: [0, 1, 1, 0, 1], 3: [0, 0, 0, 1, 0], 4: [0, 0, 0, 1, 1]}
    coded = {r.id: list(r._cat) for r in pre.coded(rows).select("id", "_cat").collect()}
    assert coded == {1: [0, 0, 0], 2: [2, 1, 1], 3: [3, 2, 2], 4: [0, 2, 1]}


def test_category_table_equals_the_vector(spark):
    from noticeflow.operators.features import fit_category_table
    train = spark.createDataFrame([("a", "x", "p"), ("b", "y", "q"), ("c", "z", "q"), (None, "z", "q")], "c1 string, c2 string, c3 string")
    rows = spark.createDataFrame([(1, "a", "x", "p"), (2, "c", "y", "q"), (3, "new", "z", "new"), (4, None, None, None)], "id int, c1 string, c2 string, c3 string")
    pre = fit_preprocessor(train, ["c1", "c2", "c3"], [])
    dense = {r.id: [k for k, v in enumerate(r.v) if v] for r in pre.transform(rows).select("id", vector_to_array("features").alias("v")).collect()}
    assert {r.id: list(r.indices) for r in fit_category_table(train, ["c1", "c2", "c3"]).vectors(rows, "id").collect()} == dense


def test_a_hundred_thousand_categories(spark):
    from pyspark.sql import functions as F
    from noticeflow.operators.features import fit_category_table
    # every third row has one value
    df = spark.range(150_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("k%06d", "id")).alias("c"))
    table = fit_category_table(df, ["c"])
    assert table.modes.first()["_mode"] == "hot" and table.codes.count() == 100_001
    got = table.vectors(df, "id")
    # 'hot' sorts first, so it has no slot
    assert got.count() == 150_000 and got.where(F.size("indices") == 1).count() == 100_000
