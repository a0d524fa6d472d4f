"""Literal-frame unit tests, one per Spark/pandas trap."""

import datetime

from pyspark.sql import functions as F

from noticeflow.functions import (cpv_prefix, days_between, normalize_id, nuts_level,
                                  nuts_region_count, parse_ddmmyy, sme_winner_count, strip_ws,
                                  winner_count, winner_country_count, yes_no_binary)
from noticeflow.functions.text import as_text


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("r")).first().r


def test_date_pivot_and_widths(spark):
    p = lambda v: one(spark, parse_ddmmyy, v)
    assert p("5/3/18") == datetime.date(2018, 3, 5)
    assert p("05/03/95") == datetime.date(1995, 3, 5)
    assert p("05/03/68") == datetime.date(2068, 3, 5)
    assert p("05/03/69") == datetime.date(1969, 3, 5)
    assert p("31/02/18") is None
    assert p("unknown") is None
    assert p(None) is None


def test_days_between_negative(spark):
    df = spark.createDataFrame([("10/01/20", "05/01/20")], "a string, b string")
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == -5


def test_normalize_id_text_and_double(spark):
    assert one(spark, normalize_id, " 45200000.0\t") == "45200000"
    df = spark.createDataFrame([(45200000.0,)], "x double")
    assert df.select(normalize_id(F.col("x"), df.schema["x"].dataType)).first()[0] == "45200000"
    assert df.select(as_text(F.col("x"), df.schema["x"].dataType)).first()[0] == "45200000"


def test_strip_all_whitespace(spark):
    assert one(spark, strip_ws, "\t ab \n") == "ab"


def test_yes_no(spark):
    assert one(spark, yes_no_binary, " y ") == 1
    assert one(spark, yes_no_binary, "n") == 0
    assert one(spark, yes_no_binary, "maybe") is None
    assert one(spark, yes_no_binary, None) is None


def test_cpv(spark):
    assert one(spark, cpv_prefix, "45200000.0") == "45"
    assert one(spark, cpv_prefix, "3000000") == "03"
    assert one(spark, cpv_prefix, "N/A") == "N/A"
    assert one(spark, cpv_prefix, "-123") == "-123"
    assert one(spark, cpv_prefix, "12.5") == "12.5"
    assert one(spark, cpv_prefix, None) is None


def test_nuts(spark):
    assert one(spark, nuts_region_count, "DE11,FR,X") == 3
    assert one(spark, nuts_region_count, "") == 0
    assert one(spark, nuts_region_count, None) == 0
    assert abs(one(spark, nuts_level, " DE1 , DE2") - 1.0) < 1e-12
    assert one(spark, nuts_level, "X") is None
    assert abs(one(spark, nuts_level, "DE11,FR,X") - 1.0) < 1e-12


def test_winners(spark):
    assert one(spark, winner_count, "DE---FR---DE ") == 3
    assert one(spark, winner_count, "") == 0
    assert one(spark, winner_count, "------") == 3
    assert one(spark, winner_country_count, "DE---FR---DE ") == 2
    assert one(spark, winner_country_count, "---IT") == 1
    assert one(spark, sme_winner_count, "Y---n---y") == 2
    assert one(spark, sme_winner_count, None) == 0


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.665,), (0.125,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 2)).collect()]
    assert got == [2.66, 0.12]


def test_log1p_minus_one_is_null(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,)], "x double")
    assert [r[0] for r in df.select(F.log1p("x")).collect()] == [None, None]


def test_numeric_text_and_unicode_blanks(spark):
    from pyspark.sql import functions as F

    from noticeflow.functions.codes import cpv_prefix
    from noticeflow.functions.text import as_number, strip_ws
    rows = ["45d", "3F", "1e3", " 7 ", ".5", "x", "", "\xa0Y\xa0", "45200000d", "45200000.0", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [tuple(r) for r in df.select("t", as_number(F.col("t")), strip_ws(F.col("t")), cpv_prefix(F.col("t"))).collect()]
    by = {r[0]: r[1:] for r in got}
    assert [by[t][0] for t in ("45d", "3F", "1e3", " 7 ", ".5", "x", "")] == [None, None, 1000.0, 7.0, 0.5, None, None]
    assert by["\xa0Y\xa0"][1] == "Y" and by["45200000d"][2] == "45200000d" and by["45200000.0"][2] == "45"
