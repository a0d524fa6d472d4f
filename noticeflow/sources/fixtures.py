"""The ``cfc`` and ``can`` fixtures: contract-notice and award-notice tables
derived from the driver's star-schema tables (FIXTURES.md section 3).

``cfc`` = lines with ``l_linestatus = 'O'``, ``can`` = lines with ``'F'``,
both from ``lineitem JOIN orders JOIN customer JOIN nation JOIN part``.

Each column is defined once per engine: as DataFrame expressions for Spark
(``cfc``/``can``) and as SQL text for the DuckDB oracle (``fixture_ctes``).
The joins are plain equi-joins; Catalyst/AQE pick the strategy from
table statistics (``nation`` is always broadcast; ``orders``, ``customer``
and ``part`` are sort-merge joined once they exceed the broadcast threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
             "l_linestatus", "l_shipdate"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str, status: str, notice: Column | None = None) -> DataFrame:
    """The joined lines; ids come from the line alone and are computed before the joins,
    so that a semi-join on them is pushed to the lines."""
    li = (read_table(spark, sf_dir, "lineitem").select(*LINE_COLS).where(
        F.col("l_linestatus") == status))
    ids = {"ID_LOT": F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lit(" l"), F.col("l_linenumber").cast("string"), F.lit(" ")))}
    li = li.withColumns(ids if notice is None else ids | {"_notice": notice})
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey",
                                                      "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    # orders meet their customers, and lines their parts, before lines meet orders: a
    # line then moves at most twice, and never with the columns of all tables
    oc = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return li.join(p, li.l_partkey == p.p_partkey).join(oc, li.l_orderkey == o.o_orderkey)


def _ddmmyy(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yy")


def _by(c: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(c == k, v) if out is None else out.when(c == k, v))
    return out


def _shared_cols() -> list[Column]:
    q, ep, tax, disc = (F.col("l_quantity"), F.col("l_extendedprice"),
                        F.col("l_tax"), F.col("l_discount"))
    size = F.col("p_size")
    row_pos = (F.col("l_orderkey").cast("bigint") * F.lit(10000000000)
               + F.col("l_linenumber").cast("bigint") * F.lit(1000000000)
               + F.col("l_partkey") * 10000 + F.col("l_suppkey"))
    prio = F.substring("o_orderpriority", 1, 1)
    return [
        row_pos.alias("_row_pos"),
        F.col("ID_LOT"),
        F.year("o_orderdate").cast("int").alias("YEAR"),
        _by(prio, {"1": "COD", "2": " res", "3": "OPE", "5": "ope "}).alias("TOP_TYPE"),
        F.when(F.col("l_returnflag") == "N", "nan")
         .otherwise(F.concat(F.lit(" c"), F.col("n_nationkey").cast("string")))
         .alias("ISO_COUNTRY_CODE"),
        F.when(q == 50, "N/A").when(q == 49, F.lit(None).cast("string"))
         .otherwise(F.concat((F.col("l_partkey") * 20011).cast("string"), F.lit(".0")))
         .alias("CPV"),
        F.when(tax >= 0.08, F.lit(None).cast("string"))
         .otherwise(_by(size % 5, {0: "DE11,FR,X", 1: " DE1 , DE2", 2: ""})
                    .otherwise("IT")).alias("TAL_LOCATION_NUTS"),
        _ddmmyy(F.col("o_orderdate")).alias("DT_DISPATCH"),
        F.when(disc == 0.05, "unknown").otherwise(_ddmmyy(F.col("l_shipdate")))
         .alias("DT_END"),
        F.when(q <= 2, F.lit(None).cast("double")).when(q <= 10, ep * 100)
         .otherwise(ep).alias("VALUE_EURO_FIN_2"),
        F.when(q == 1, F.lit(None).cast("double")).when(tax == 0, -ep)
         .otherwise(ep * 0.9).alias("VALUE_EURO"),
        _by(size % 3, {0: "Y", 1: " n"}).alias("B_EU_FUNDS"),
        _by(size % 4, {0: "y", 1: "N"}).alias("B_FRA_AGREEMENT"),
        _by(size % 7, {0: "A,B", 1: "A"}).alias("FRA_ESTIMATED"),
        F.when(size == 50, 1).when(size == 49, F.lit(None).cast("int")).otherwise(0)
         .cast("int").alias("CANCELLED"),
        F.when(size == 48, "2.0.8").when(size == 47, F.lit(None).cast("string"))
         .otherwise("2.0.9").alias("XSD_VERSION"),
        # Additional columns of this repository (FIXTURES.md section 3, "extra").
        F.col("c_mktsegment").alias("CAE_TYPE"),
        F.col("p_type").alias("MAIN_ACTIVITY"),
        _by(size % 3, {0: "WORKS", 1: "SERVICES"}).otherwise("SUPPLIES")
         .alias("TYPE_OF_CONTRACT"),
        F.when(disc >= 0.09, F.lit(None).cast("string"))
         .when(tax < 0.04, "l ").otherwise("M").alias("CRIT_CODE"),
        _by(F.col("o_orderstatus"), {"F": "F02", "O": "F03"}).otherwise("F05")
         .alias("ID_TYPE"),
        F.when(F.col("o_custkey") % 17 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("o_custkey") % 7 + 1).cast("double")).alias("LOTS_NUMBER"),
        F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0).cast("int").alias("B_ON_BEHALF"),
        F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0).cast("int")
         .alias("OUT_OF_DIRECTIVES"),
    ]


def memo(spark: SparkSession, key: tuple, build):
    """Reuse a fixture plan or a written stage table within one session.

    Keys hold the input path only: after a change of the data below a path,
    start a new session or call ``forget``."""
    store = getattr(spark, "_noticeflow_plans", None)
    if store is None:
        store = {}
        spark._noticeflow_plans = store
    if key not in store:
        store[key] = build()
    return store[key]


def forget(spark: SparkSession) -> None:
    """Drop all plans and stage tables that ``memo`` keeps."""
    spark._noticeflow_plans = {}


def cfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contract notices (one row per planned lot)."""
    return memo(spark, ("cfc", sf_dir), lambda: _cfc(spark, sf_dir))


def can(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contract award notices (one row per awarded lot)."""
    return memo(spark, ("can", sf_dir), lambda: _can(spark, sf_dir))


def cfc_of(spark: SparkSession, sf_dir: str, only) -> DataFrame:
    """The raw contract notices that ``only`` keeps: it takes the joined lines, with their
    ids ``_notice`` and ``ID_LOT``, and is pushed to the lines where it is a semi-join on these
    (Spark pushes none below computed columns)."""
    return _cfc(spark, sf_dir, only)


def can_of(spark: SparkSession, sf_dir: str, only) -> DataFrame:
    """``cfc_of`` for the award notices."""
    return _can(spark, sf_dir, only)


def _cfc(spark: SparkSession, sf_dir: str, only=lambda lines: lines) -> DataFrame:
    k = F.col("l_orderkey")
    disc, size = F.col("l_discount"), F.col("p_size")
    notice = F.when(k % 11 == 0, F.lit(None).cast("string")) \
              .when(k % 13 == 0, F.concat(k.cast("string"), F.lit(".0"))) \
              .otherwise(k.cast("string"))
    df = only(_base(spark, sf_dir, "O", notice)).select(
        *_shared_cols(),
        F.col("_notice").alias("FUTURE_CAN_ID"),
        F.when(disc == 0.1, F.lit(None).cast("double"))
         .otherwise((size * 6 - 20).cast("double")).alias("DURATION"),
        _by(F.col("l_suppkey") % 4, {0: "Y", 1: "N"}).alias("B_RECURRENT_PROCUREMENT"),
    )
    return df.withColumnRenamed("DT_END", "DT_APPLICATIONS")


def _can(spark: SparkSession, sf_dir: str, only=lambda lines: lines) -> DataFrame:
    q, size = F.col("l_quantity"), F.col("p_size")
    ep, disc = F.col("l_extendedprice"), F.col("l_discount")
    df = only(_base(spark, sf_dir, "F", F.col("l_orderkey").cast("string"))).select(
        *_shared_cols(),
        F.col("_notice").alias("ID_NOTICE_CAN"),
        F.when(q == 3, "PROCUREMENT_DISCONTINUED").when(q == 4, "PROCUREMENT_UNSUCCESSFUL")
         .alias("INFO_ON_NON_AWARD"),
        F.when(q <= 6, F.lit(None).cast("string")).otherwise((size % 6).cast("string"))
         .alias("NUMBER_TENDERS_SME"),
        F.when(q <= 8, "x").otherwise((size % 4).cast("string")).alias("NUMBER_TENDERS_OTHER_EU"),
        F.when(q <= 4, 1).otherwise(0).cast("int").alias("NOT_AWARDED"),
        _by(size % 5, {1: "DE", 2: "DE---FR---DE "}).when(size % 5 != 0, "---IT")
         .alias("WIN_COUNTRY_CODE"),
        _by(size % 3, {0: "Y---n---y", 1: "N"}).alias("B_CONTRACTOR_SME"),
        F.when(disc >= 0.08, F.lit(None).cast("double")).otherwise(ep * (1 - disc))
         .alias("AWARD_VALUE_EURO_FIN_1"),
        ep.alias("AWARD_EST_VALUE_EURO"),
    )
    return df.withColumnRenamed("DT_END", "DT_AWARD")


# ---------------------------------------------------------------------------
# The same fixtures as DuckDB SQL (for the oracle).  Column order equals the
# Spark side.
# ---------------------------------------------------------------------------

_SHARED_SQL = """
    cast(l_orderkey as bigint)*10000000000 + cast(l_linenumber as bigint)*1000000000
      + cast(l_partkey as bigint)*10000 + cast(l_suppkey as bigint) AS _row_pos,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE ' l' || cast(l_linenumber as varchar) || ' ' END AS ID_LOT,
    cast(year(o_orderdate) as int) AS "YEAR",
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'COD' WHEN '2' THEN ' res'
         WHEN '3' THEN 'OPE' WHEN '5' THEN 'ope ' END AS TOP_TYPE,
    CASE WHEN l_returnflag = 'N' THEN 'nan' ELSE ' c' || cast(n_nationkey as varchar) END AS ISO_COUNTRY_CODE,
    CASE WHEN l_quantity = 50 THEN 'N/A' WHEN l_quantity = 49 THEN NULL
         ELSE cast(l_partkey*20011 as varchar) || '.0' END AS CPV,
    CASE WHEN l_tax >= 0.08 THEN NULL WHEN p_size % 5 = 0 THEN 'DE11,FR,X'
         WHEN p_size % 5 = 1 THEN ' DE1 , DE2' WHEN p_size % 5 = 2 THEN '' ELSE 'IT' END AS TAL_LOCATION_NUTS,
    strftime(o_orderdate, '%d/%m/%y') AS DT_DISPATCH,
    CASE WHEN l_discount = 0.05 THEN 'unknown' ELSE strftime(l_shipdate, '%d/%m/%y') END AS {dt_end},
    CASE WHEN l_quantity <= 2 THEN NULL WHEN l_quantity <= 10 THEN l_extendedprice*100
         ELSE l_extendedprice END AS VALUE_EURO_FIN_2,
    CASE WHEN l_quantity = 1 THEN NULL WHEN l_tax = 0 THEN -l_extendedprice
         ELSE l_extendedprice*cast(0.9 as double) END AS VALUE_EURO,
    CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN ' n' END AS B_EU_FUNDS,
    CASE p_size % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'N' END AS B_FRA_AGREEMENT,
    CASE p_size % 7 WHEN 0 THEN 'A,B' WHEN 1 THEN 'A' END AS FRA_ESTIMATED,
    cast(CASE WHEN p_size = 50 THEN 1 WHEN p_size = 49 THEN NULL ELSE 0 END as int) AS CANCELLED,
    CASE WHEN p_size = 48 THEN '2.0.8' WHEN p_size = 47 THEN NULL ELSE '2.0.9' END AS XSD_VERSION,
    c_mktsegment AS CAE_TYPE,
    p_type AS MAIN_ACTIVITY,
    CASE p_size % 3 WHEN 0 THEN 'WORKS' WHEN 1 THEN 'SERVICES' ELSE 'SUPPLIES' END AS TYPE_OF_CONTRACT,
    CASE WHEN l_discount >= 0.09 THEN NULL WHEN l_tax < 0.04 THEN 'l ' ELSE 'M' END AS CRIT_CODE,
    CASE o_orderstatus WHEN 'F' THEN 'F02' WHEN 'O' THEN 'F03' ELSE 'F05' END AS ID_TYPE,
    CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE cast(o_custkey % 7 + 1 as double) END AS LOTS_NUMBER,
    cast(CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END as int) AS B_ON_BEHALF,
    cast(CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END as int) AS OUT_OF_DIRECTIVES"""

_FROM_SQL = """
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  WHERE l_linestatus = '{status}'"""

CFC_SQL = ("SELECT" + _SHARED_SQL.format(dt_end="DT_APPLICATIONS") + """,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL
         WHEN l_orderkey % 13 = 0 THEN cast(l_orderkey as varchar) || '.0'
         ELSE cast(l_orderkey as varchar) END AS FUTURE_CAN_ID,
    CASE WHEN l_discount = 0.1 THEN NULL ELSE cast(p_size*6 - 20 as double) END AS DURATION,
    CASE l_suppkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS B_RECURRENT_PROCUREMENT"""
           + _FROM_SQL.format(status="O"))

CAN_SQL = ("SELECT" + _SHARED_SQL.format(dt_end="DT_AWARD") + """,
    cast(l_orderkey as varchar) AS ID_NOTICE_CAN,
    CASE WHEN l_quantity = 3 THEN 'PROCUREMENT_DISCONTINUED'
         WHEN l_quantity = 4 THEN 'PROCUREMENT_UNSUCCESSFUL' END AS INFO_ON_NON_AWARD,
    CASE WHEN l_quantity <= 6 THEN NULL ELSE cast(p_size % 6 as varchar) END AS NUMBER_TENDERS_SME,
    CASE WHEN l_quantity <= 8 THEN 'x' ELSE cast(p_size % 4 as varchar) END AS NUMBER_TENDERS_OTHER_EU,
    cast(CASE WHEN l_quantity <= 4 THEN 1 ELSE 0 END as int) AS NOT_AWARDED,
    CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'DE' WHEN 2 THEN 'DE---FR---DE ' ELSE '---IT' END AS WIN_COUNTRY_CODE,
    CASE p_size % 3 WHEN 0 THEN 'Y---n---y' WHEN 1 THEN 'N' END AS B_CONTRACTOR_SME,
    CASE WHEN l_discount >= 0.08 THEN NULL ELSE l_extendedprice*(1 - l_discount) END AS AWARD_VALUE_EURO_FIN_1,
    l_extendedprice AS AWARD_EST_VALUE_EURO"""
           + _FROM_SQL.format(status="F"))


def fixture_ctes() -> str:
    """``cfc AS (...), can AS (...)`` for a ``WITH`` clause."""
    return f"cfc AS ({CFC_SQL}),\ncan AS ({CAN_SQL})"
