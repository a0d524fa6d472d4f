"""DuckDB oracle SQL, one statement per query key.

Every statement inlines the whole chain as CTEs over the driver's registered
tables: the ``cfc``/``can`` fixtures, stage 01 (``cfc_prep``/``can_prep``),
the notice and lot splits, the merge, the golden table and the cleaning
steps. It is an independent restatement of the operators in SQL (DuckDB
has no ``log1p``/``expm1``: ``ln(1+x)``/``exp(x)-1`` stand in, which is why
fence-derived outputs are rounded in both engines).
"""

from __future__ import annotations

from noticeflow.sources.fixtures import fixture_ctes


def S(x: str) -> str:
    """Strip all edge whitespace."""
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def US(x: str) -> str:
    return f"upper({S(x)})"


def NID(x: str) -> str:
    return rf"regexp_replace({US(x)}, '\.0$', '')"


def STD(x: str) -> str:
    return f"CASE WHEN {US(x)} IN ('NAN', 'NONE') THEN NULL ELSE {US(x)} END"


def YN(x: str) -> str:
    return f"cast(CASE {US(x)} WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END as int)"


def CPV(x: str) -> str:
    n = f"TRY_CAST({S(x)} AS DOUBLE)"
    return (f"CASE WHEN {n} IS NOT NULL AND {n} = floor({n}) AND {n} >= 0 AND {n} < 1e18 "
            f"THEN substr(lpad(cast(cast({n} as decimal(38,0)) as varchar), 8, '0'), 1, 2) "
            f"ELSE {x} END")


def NUTS_COUNT(x: str) -> str:
    return (f"cast(CASE WHEN coalesce({x}, '') = '' THEN 0 "
            f"ELSE len(string_split({x}, ',')) END as int)")


def NUTS_LEVEL(x: str) -> str:
    lens = (f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), "
            f"lambda c: length({S('c')})), lambda n: n >= 2)")
    return (f"CASE WHEN len({lens}) > 0 THEN cast(list_sum({lens}) as double) / "
            f"cast(len({lens}) as double) - 2.0 END")


def DAYS(a: str, b: str) -> str:
    return (f"cast(date_diff('day', cast(try_strptime({a}, '%d/%m/%y') as date), "
            f"cast(try_strptime({b}, '%d/%m/%y') as date)) as int)")


def WIN_N(x: str) -> str:
    return (f"cast(CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE "
            f"(length({x}) - length(replace({x}, '---', ''))) // 3 + 1 END as int)")


def WIN_C(x: str) -> str:
    return (f"cast(len(list_distinct(list_filter(list_transform(string_split(coalesce({x}, ''), "
            f"'---'), lambda c: {S('c')}), lambda c: c <> ''))) as int)")


def SME_N(x: str) -> str:
    u = f"upper(coalesce({x}, ''))"
    return f"cast(length({u}) - length(replace({u}, 'Y', '')) as int)"


FRA_FLAG = "cast(length(coalesce(FRA_ESTIMATED, '')) >= 2 as int)"
IS_FRAMEWORK = (f"cast(coalesce(B_FRA_AGREEMENT IN ('Y', 'y', '1'), false) OR "
                f"coalesce({FRA_FLAG} = 1, false) as int)")
COOP = "cast(coalesce(B_ON_BEHALF = 1, false) as int)"
REDUCE_WHERE = ("NOT coalesce(contains(cast(XSD_VERSION as varchar), '8'), false) "
                "AND coalesce(CANCELLED = 0, false) AND coalesce(OUT_OF_DIRECTIVES = 0, false)")
CATS = ["TOP_TYPE", "ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "TYPE_OF_CONTRACT",
        "CRIT_CODE", "ID_TYPE"]
_CAT_SQL = ", ".join(f"{STD(c)} AS {c}" for c in CATS)

# Stage 01 output columns (tests assert the Spark side equals these).
CFC_PREP_COLS = ["_row_pos", "ID_LOT", "YEAR", "CPV", "LOTS_NUMBER", "OUT_OF_DIRECTIVES",
                 "FUTURE_CAN_ID", "DURATION", "B_RECURRENT_PROCUREMENT", "B_EU_FUNDS",
                 "TOTAL_VALUE_EUR", "IS_FRAMEWORK", "COOPERATIVE_PURCHASING",
                 "NUTS_REGION_COUNT", "NUTS_LEVEL", "PREPARATION_DAYS"] + CATS
CAN_PREP_COLS = ["_row_pos", "ID_LOT", "YEAR", "CPV", "LOTS_NUMBER", "ID_NOTICE_CAN",
                 "NOT_AWARDED", "B_EU_FUNDS", "TOTAL_VALUE_EUR", "LOT_AWARD_VALUE_EUR",
                 "IS_FRAMEWORK", "COOPERATIVE_PURCHASING", "NUMBER_OF_TENDERS",
                 "NUTS_REGION_COUNT", "NUTS_LEVEL", "DAYS_TO_AWARD", "NUMBER_OF_WINNERS",
                 "NUMBER_WINNER_COUNTRIES", "NUMBER_SME_WINNERS"] + CATS

PREP_CTES = f"""
cfc_r AS (SELECT * FROM cfc WHERE {REDUCE_WHERE}),
cfc_prep AS (
  SELECT _row_pos, ID_LOT, "YEAR", {CPV('CPV')} AS CPV, LOTS_NUMBER, OUT_OF_DIRECTIVES,
         FUTURE_CAN_ID, DURATION, {YN('B_RECURRENT_PROCUREMENT')} AS B_RECURRENT_PROCUREMENT,
         {YN('B_EU_FUNDS')} AS B_EU_FUNDS, coalesce(VALUE_EURO_FIN_2, VALUE_EURO) AS TOTAL_VALUE_EUR,
         {IS_FRAMEWORK} AS IS_FRAMEWORK, {COOP} AS COOPERATIVE_PURCHASING,
         {NUTS_COUNT('TAL_LOCATION_NUTS')} AS NUTS_REGION_COUNT,
         {NUTS_LEVEL('TAL_LOCATION_NUTS')} AS NUTS_LEVEL,
         {DAYS('DT_DISPATCH', 'DT_APPLICATIONS')} AS PREPARATION_DAYS, {_CAT_SQL}
  FROM cfc_r),
can_r AS (
  SELECT *, TRY_CAST(NUMBER_TENDERS_SME AS DOUBLE) AS _t1,
         TRY_CAST(NUMBER_TENDERS_OTHER_EU AS DOUBLE) AS _t2
  FROM can WHERE {REDUCE_WHERE}
    AND INFO_ON_NON_AWARD IS DISTINCT FROM 'PROCUREMENT_DISCONTINUED'),
can_prep AS (
  SELECT _row_pos, ID_LOT, "YEAR", {CPV('CPV')} AS CPV, LOTS_NUMBER, ID_NOTICE_CAN, NOT_AWARDED,
         {YN('B_EU_FUNDS')} AS B_EU_FUNDS, coalesce(VALUE_EURO_FIN_2, VALUE_EURO) AS TOTAL_VALUE_EUR,
         coalesce(AWARD_VALUE_EURO_FIN_1, AWARD_EST_VALUE_EURO) AS LOT_AWARD_VALUE_EUR,
         {IS_FRAMEWORK} AS IS_FRAMEWORK, {COOP} AS COOPERATIVE_PURCHASING,
         CASE WHEN coalesce(_t1, _t2) IS NOT NULL THEN coalesce(_t1, 0.0) + coalesce(_t2, 0.0)
              WHEN INFO_ON_NON_AWARD = 'PROCUREMENT_UNSUCCESSFUL' THEN 0.0 END AS NUMBER_OF_TENDERS,
         {NUTS_COUNT('TAL_LOCATION_NUTS')} AS NUTS_REGION_COUNT,
         {NUTS_LEVEL('TAL_LOCATION_NUTS')} AS NUTS_LEVEL,
         {DAYS('DT_DISPATCH', 'DT_AWARD')} AS DAYS_TO_AWARD,
         {WIN_N('WIN_COUNTRY_CODE')} AS NUMBER_OF_WINNERS,
         {WIN_C('WIN_COUNTRY_CODE')} AS NUMBER_WINNER_COUNTRIES,
         {SME_N('B_CONTRACTOR_SME')} AS NUMBER_SME_WINNERS, {_CAT_SQL}
  FROM can_r)"""

_LOT = "coalesce(ID_LOT, 'NO_LOT_DEFINED')"

MATCH_CTES = f"""
cfc_tag AS (SELECT *, coalesce(FUTURE_CAN_ID IN (SELECT ID_NOTICE_CAN FROM can_prep), false) AS _m
            FROM cfc_prep),
can_tag AS (SELECT *, coalesce(ID_NOTICE_CAN IN (SELECT FUTURE_CAN_ID FROM cfc_prep
                                                WHERE FUTURE_CAN_ID IS NOT NULL), false) AS _m
            FROM can_prep),
cfc_n AS (SELECT * EXCLUDE (_m) FROM cfc_tag WHERE _m),
can_n AS (SELECT * EXCLUDE (_m) FROM can_tag WHERE _m),
cfc_nk AS (SELECT *, {NID('FUTURE_CAN_ID')} AS _kn, {NID(_LOT)} AS _kl FROM cfc_n),
can_nk AS (SELECT *, {NID('ID_NOTICE_CAN')} AS _kn, {NID(_LOT)} AS _kl FROM can_n),
cfc_ltag AS (SELECT *, EXISTS (SELECT 1 FROM can_nk b WHERE b._kn = a._kn AND b._kl = a._kl) AS _m
             FROM cfc_nk a),
can_ltag AS (SELECT *, EXISTS (SELECT 1 FROM cfc_nk b WHERE b._kn = a._kn AND b._kl = a._kl) AS _m
             FROM can_nk a),
cfc_l AS (SELECT * EXCLUDE (_m) FROM cfc_ltag WHERE _m),
can_l AS (SELECT * EXCLUDE (_m) FROM can_ltag WHERE _m)"""


def _master_select() -> str:
    common = set(CFC_PREP_COLS) & set(CAN_PREP_COLS)
    parts = ["a._kn AS JOIN_NOTICE", "a._kl AS JOIN_LOT"]
    for c in CFC_PREP_COLS:
        parts.append(f'a."{c}" AS "{c}_CFC"' if c in common else f'a."{c}" AS "{c}"')
    for c in CAN_PREP_COLS:
        parts.append(f'b."{c}" AS "{c}_CAN"' if c in common else f'b."{c}" AS "{c}"')
    return ", ".join(parts)


ML_COLS = ['"_row_pos_CFC" AS _row_pos', '"_row_pos_CAN" AS _row_pos2', "JOIN_NOTICE", "JOIN_LOT",
           "NUMBER_OF_TENDERS", "TOTAL_VALUE_EUR_CAN AS TARGET_AWARD_VALUE_EUR",
           "LOT_AWARD_VALUE_EUR", '"YEAR_CFC" AS "YEAR"', "ID_TYPE_CFC AS ID_TYPE",
           "ISO_COUNTRY_CODE_CFC AS ISO_COUNTRY_CODE", "CAE_TYPE_CFC AS CAE_TYPE",
           "MAIN_ACTIVITY_CFC AS MAIN_ACTIVITY", "CPV_CFC AS CPV", "LOTS_NUMBER_CFC AS LOTS_NUMBER",
           "B_EU_FUNDS_CFC AS B_EU_FUNDS", "DURATION", "TOP_TYPE_CFC AS TOP_TYPE",
           "B_RECURRENT_PROCUREMENT", "TOTAL_VALUE_EUR_CFC AS ESTIMATED_VALUE_EUR",
           "IS_FRAMEWORK_CFC AS IS_FRAMEWORK",
           "COOPERATIVE_PURCHASING_CFC AS COOPERATIVE_PURCHASING", "CRIT_CODE_CFC AS CRIT_CODE",
           "TYPE_OF_CONTRACT_CFC AS TYPE_OF_CONTRACT",
           "NUTS_REGION_COUNT_CFC AS NUTS_REGION_COUNT", "NUTS_LEVEL_CFC AS NUTS_LEVEL",
           "PREPARATION_DAYS"]

MERGE_CTES = f"""
master AS (SELECT {_master_select()}
           FROM cfc_l a JOIN can_l b ON a._kn = b._kn AND a._kl = b._kl),
ml0 AS (SELECT {", ".join(ML_COLS)} FROM master),
ncode AS (SELECT JOIN_NOTICE, cast(row_number() OVER (ORDER BY min(_row_pos), min(_row_pos2)) - 1
                                   as bigint) AS code FROM ml0 GROUP BY JOIN_NOTICE),
lcode AS (SELECT JOIN_LOT, cast(row_number() OVER (ORDER BY min(_row_pos), min(_row_pos2)) - 1
                                as bigint) AS code FROM ml0 GROUP BY JOIN_LOT),
ml AS (SELECT ml0.* EXCLUDE (JOIN_NOTICE, JOIN_LOT), ncode.code AS ID_NOTICE, lcode.code AS ID_LOT
       FROM ml0 JOIN ncode USING (JOIN_NOTICE) JOIN lcode USING (JOIN_LOT))"""

TARGETS = ["TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR", "NUMBER_OF_TENDERS"]
LOGICAL = ["PREPARATION_DAYS", "DURATION", "TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR",
           "ESTIMATED_VALUE_EUR", "NUMBER_OF_TENDERS"]
INPUT_LOG = ["ESTIMATED_VALUE_EUR", "LOTS_NUMBER"]
INPUT_STD = ["DURATION", "PREPARATION_DAYS", "NUTS_REGION_COUNT"]


def _fence(c: str, log: bool) -> str:
    v = f"ln(1 + {c})" if log else f"cast({c} as double)"
    q1, q3 = f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.75)"
    f = f"{q3} + 3.0 * ({q3} - {q1})"
    return f"exp({f}) - 1" if log else f


def _fences_cte(name: str, src: str, cols: list[str], log: bool) -> str:
    return f"{name} AS (SELECT {', '.join(f'{_fence(c, log)} AS f_{c}' for c in cols)} FROM {src})"


def _cap(cols):
    return ", ".join(f"CASE WHEN {c} > f_{c} THEN f_{c} ELSE cast({c} as double) END AS {c}"
                     for c in cols)


CLEAN_CTES = f"""
k1 AS (SELECT * FROM ml WHERE {" AND ".join(f"{c} IS NOT NULL" for c in TARGETS)}),
k2 AS (SELECT * FROM k1 WHERE {" AND ".join(f"({c} >= 0 OR {c} IS NULL)" for c in LOGICAL)}),
topmode AS (SELECT TOP_TYPE AS m FROM k2 WHERE TOP_TYPE IS NOT NULL GROUP BY TOP_TYPE
            ORDER BY count(*) DESC, TOP_TYPE LIMIT 1),
k3 AS (SELECT * REPLACE (coalesce(B_EU_FUNDS, 0) AS B_EU_FUNDS,
                         coalesce(B_RECURRENT_PROCUREMENT, 0) AS B_RECURRENT_PROCUREMENT,
                         coalesce(CRIT_CODE, 'MISSING') AS CRIT_CODE,
                         coalesce(TOP_TYPE, (SELECT m FROM topmode)) AS TOP_TYPE) FROM k2),
{_fences_cte("fz1", "k3", TARGETS, True)},
k4 AS (SELECT k3.* FROM k3, fz1 WHERE {" AND ".join(f"({c} <= f_{c} OR {c} IS NULL)" for c in TARGETS)}),
{_fences_cte("fz2", "k4", INPUT_LOG, True)},
k5 AS (SELECT k4.* REPLACE ({_cap(INPUT_LOG)}) FROM k4, fz2),
{_fences_cte("fz3", "k5", INPUT_STD, False)},
k6 AS (SELECT k5.* REPLACE ({_cap(INPUT_STD)}) FROM k5, fz3)"""


def with_all(select: str) -> str:
    """The full CTE chain followed by ``select``."""
    return (f"WITH {fixture_ctes()},{PREP_CTES},{MATCH_CTES},{MERGE_CTES},{CLEAN_CTES}\n"
            f"{select}")


def R(x: str, n: int = 6) -> str:
    return f"round_even(cast({x} as double), {n})"
