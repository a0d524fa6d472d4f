"""``ORACLE``: DuckDB SQL per query key (see ``plans.oracle`` for the chain)."""

from __future__ import annotations

from noticeflow.plans.oracle import (CAN_PREP_COLS, CATS, CFC_PREP_COLS, COOP, CPV, DAYS,
                                     FRA_FLAG, INPUT_LOG, INPUT_STD, IS_FRAMEWORK, NID,
                                     NUTS_COUNT, NUTS_LEVEL, R, SME_N, STD, TARGETS, WIN_C,
                                     WIN_N, YN, with_all)

ORACLE: dict[str, str] = {}


def sql(name: str, select: str) -> None:
    ORACLE[name] = with_all(select)


def _cols(cols) -> str:
    return ", ".join(f'"{c}"' for c in cols)


# ---------------------------------------------------------------- stage 01
_DROP_CFC = ["CANCELLED", "XSD_VERSION"]
sql("reduce_rows", f"""SELECT * EXCLUDE ({", ".join(_DROP_CFC)}) FROM cfc_r""")
sql("yes_no_binary", f"""SELECT _row_pos, {YN('B_EU_FUNDS')} AS B_EU_FUNDS,
    {YN('B_RECURRENT_PROCUREMENT')} AS B_RECURRENT_PROCUREMENT FROM cfc""")
sql("framework_flag", f"SELECT _row_pos, {FRA_FLAG} AS B_FRA_ESTIMATED_FLAG FROM cfc")
sql("categoricals_standardized",
    "SELECT _row_pos, " + ", ".join(f"{STD(c)} AS {c}" for c in CATS) + " FROM can")
sql("value_cascade", """SELECT _row_pos, coalesce(VALUE_EURO_FIN_2, VALUE_EURO) AS TOTAL_VALUE_EUR,
    coalesce(AWARD_VALUE_EURO_FIN_1, AWARD_EST_VALUE_EURO) AS LOT_AWARD_VALUE_EUR FROM can""")
sql("flag_or", f"""SELECT _row_pos, {IS_FRAMEWORK} AS IS_FRAMEWORK,
    {COOP} AS COOPERATIVE_PURCHASING FROM cfc""")
sql("tenders_consolidated", """SELECT _row_pos,
    CASE WHEN coalesce(_t1, _t2) IS NOT NULL THEN coalesce(_t1, 0.0) + coalesce(_t2, 0.0)
         WHEN INFO_ON_NON_AWARD = 'PROCUREMENT_UNSUCCESSFUL' THEN 0.0 END AS NUMBER_OF_TENDERS
    FROM (SELECT *, TRY_CAST(NUMBER_TENDERS_SME AS DOUBLE) AS _t1,
                 TRY_CAST(NUMBER_TENDERS_OTHER_EU AS DOUBLE) AS _t2 FROM can
          WHERE INFO_ON_NON_AWARD IS DISTINCT FROM 'PROCUREMENT_DISCONTINUED')""")
sql("days_between", f"SELECT _row_pos, {DAYS('DT_DISPATCH', 'DT_APPLICATIONS')} AS PREPARATION_DAYS FROM cfc")
sql("cpv_division", f"SELECT _row_pos, {CPV('CPV')} AS CPV FROM cfc")
sql("nuts_features", f"""SELECT _row_pos, {NUTS_COUNT('TAL_LOCATION_NUTS')} AS NUTS_REGION_COUNT,
    {NUTS_LEVEL('TAL_LOCATION_NUTS')} AS NUTS_LEVEL FROM cfc""")
sql("winner_features", f"""SELECT _row_pos, {WIN_N('WIN_COUNTRY_CODE')} AS NUMBER_OF_WINNERS,
    {WIN_C('WIN_COUNTRY_CODE')} AS NUMBER_WINNER_COUNTRIES,
    {SME_N('B_CONTRACTOR_SME')} AS NUMBER_SME_WINNERS FROM can""")
sql("normalized_ids", f"""SELECT _row_pos, {NID('FUTURE_CAN_ID')} AS JOIN_NOTICE,
    {NID("coalesce(ID_LOT, 'NO_LOT_DEFINED')")} AS JOIN_LOT FROM cfc""")
sql("prepared_cfc", f"SELECT {_cols(CFC_PREP_COLS)} FROM cfc_prep")
sql("prepared_can", f"SELECT {_cols(CAN_PREP_COLS)} FROM can_prep")
sql("cpv_cardinality", f"""SELECT Dataset, cast(count(DISTINCT CPV) as bigint) AS Before,
    cast(count(DISTINCT {CPV('CPV')}) as bigint) AS After
    FROM (SELECT 'CFC' AS Dataset, CPV FROM cfc UNION ALL SELECT 'CAN', CPV FROM can) u
    GROUP BY Dataset""")


# ---------------------------------------------------------------- stage 02
def _rate(src: str, feat: str) -> str:
    return f"""SELECT {feat}, cast(sum(CASE WHEN _m THEN 1 ELSE 0 END) as bigint) AS Matched,
      cast(sum(CASE WHEN _m THEN 0 ELSE 1 END) as bigint) AS Orphans,
      round_even(cast(sum(CASE WHEN _m THEN 0 ELSE 1 END) as double) / cast(count(*) as double)
                 * 100.0, 2) AS Orphan_Rate_pct
    FROM {src} WHERE {feat} IS NOT NULL GROUP BY {feat}"""


def _share(src: str, feat: str) -> str:
    return f"""SELECT {feat},
      round_even(coalesce(cast(m as double) / cast(sum(m) OVER () as double) * 100.0, 0.0), 2) AS Matched_pct,
      round_even(coalesce(cast(o as double) / cast(sum(o) OVER () as double) * 100.0, 0.0), 2) AS Orphans_pct,
      round_even(coalesce(cast(o as double) / cast(sum(o) OVER () as double) * 100.0, 0.0)
               - coalesce(cast(m as double) / cast(sum(m) OVER () as double) * 100.0, 0.0), 2) AS Difference_pts
    FROM (SELECT {feat}, sum(CASE WHEN _m THEN 1 ELSE 0 END) AS m, sum(CASE WHEN _m THEN 0 ELSE 1 END) AS o
          FROM {src} WHERE {feat} IS NOT NULL GROUP BY {feat}) g"""


sql("orphan_rate_by_year", _rate("cfc_tag", '"YEAR"'))
sql("can_orphan_rate_by_year", _rate("can_tag", '"YEAR"'))
sql("procedure_share_diff", _share("can_tag", "TOP_TYPE"))
sql("ope_orphans_by_year", _share("(SELECT * FROM can_tag WHERE TOP_TYPE = 'OPE')", '"YEAR"'))


def _metrics(src: str, mets: list[str]) -> str:
    parts = []
    for m in mets:
        parts.append(f"""SELECT '{m}' AS Metric,
          round_even(quantile_cont(CASE WHEN _m THEN {m} END, 0.5), 2) AS Matched_Median,
          round_even(quantile_cont(CASE WHEN NOT _m THEN {m} END, 0.5), 2) AS Orphan_Median,
          round_even(avg(CASE WHEN _m THEN {m} END), 2) AS Matched_Mean,
          round_even(avg(CASE WHEN NOT _m THEN {m} END), 2) AS Orphan_Mean FROM {src}""")
    return " UNION ALL ".join(parts)


sql("metric_bias", _metrics("(SELECT * FROM can_tag WHERE TOP_TYPE = 'OPE')", ["TOTAL_VALUE_EUR"]))
sql("non_award_rate", """SELECT * FROM (
    SELECT 'Total CAN Orphans' AS Metric, cast(count(*) as double) AS Value FROM can_tag WHERE NOT _m
    UNION ALL SELECT 'Non-Awarded Orphans', cast(coalesce(sum(NOT_AWARDED), 0) as double)
      FROM can_tag WHERE NOT _m
    UNION ALL SELECT 'Non-Award Rate (%)', coalesce(round_even(cast(sum(NOT_AWARDED) as double)
      / cast(count(*) as double) * 100.0, 2), 0.0) FROM can_tag WHERE NOT _m)""")


def _counts(tag_cfc: str, tag_can: str, shared: str) -> str:
    return f"""
    SELECT 'cfc_matched' AS Frame, cast(count(*) as bigint) AS "Rows" FROM {tag_cfc} WHERE _m
    UNION ALL SELECT 'cfc_orphans', cast(count(*) as bigint) FROM {tag_cfc} WHERE NOT _m
    UNION ALL SELECT 'can_matched', cast(count(*) as bigint) FROM {tag_can} WHERE _m
    UNION ALL SELECT 'can_orphans', cast(count(*) as bigint) FROM {tag_can} WHERE NOT _m
    UNION ALL SELECT 'shared_keys', cast(count(*) as bigint) FROM ({shared}) s"""


sql("notice_split_counts", _counts("cfc_tag", "can_tag", """
    SELECT FUTURE_CAN_ID FROM cfc_prep WHERE FUTURE_CAN_ID IS NOT NULL
    INTERSECT SELECT ID_NOTICE_CAN FROM can_prep WHERE ID_NOTICE_CAN IS NOT NULL"""))
sql("matched_notices", f"SELECT {_cols(CAN_PREP_COLS)} FROM can_n")
sql("lot_split_counts", _counts("cfc_ltag", "can_ltag", """
    SELECT _kn, _kl FROM cfc_nk WHERE _kn IS NOT NULL INTERSECT SELECT _kn, _kl FROM can_nk"""))
sql("matched_lots", f"SELECT {_cols(CFC_PREP_COLS)} FROM cfc_l")
sql("cross_orphans", """
    SELECT 'CFC Lot Orphan in Matched CAN' AS Direction, cast(count(*) as bigint) AS Affected_Notices
    FROM (SELECT FUTURE_CAN_ID FROM cfc_ltag WHERE NOT _m AND FUTURE_CAN_ID IS NOT NULL
          INTERSECT SELECT ID_NOTICE_CAN FROM can_ltag WHERE NOT _m AND ID_NOTICE_CAN IS NOT NULL)
    UNION ALL
    SELECT 'CAN Lot Orphan in Matched CFC', cast(count(*) as bigint)
    FROM (SELECT ID_NOTICE_CAN FROM can_ltag WHERE NOT _m AND ID_NOTICE_CAN IS NOT NULL
          INTERSECT SELECT FUTURE_CAN_ID FROM cfc_ltag WHERE NOT _m AND FUTURE_CAN_ID IS NOT NULL)""")
_PER = """(SELECT FUTURE_CAN_ID, count(*) AS tot, sum(CASE WHEN _m THEN 0 ELSE 1 END) AS orph
            FROM cfc_ltag WHERE FUTURE_CAN_ID IS NOT NULL GROUP BY FUTURE_CAN_ID)"""
_F = f"""(SELECT count(*) AS n, sum(CASE WHEN tot = orph THEN 1 ELSE 0 END) AS tf,
                 sum(CASE WHEN tot > orph THEN 1 ELSE 0 END) AS ps FROM {_PER} WHERE orph > 0)"""
sql("partial_success", f"""
    SELECT 'Total Failure (0% Lots Awarded)' AS Scenario, cast(coalesce(tf, 0) as bigint) AS Notice_Count,
           coalesce(round_even(cast(tf as double) / cast(n as double) * 100.0, 2), 0.0) AS Share_pct FROM {_F}
    UNION ALL
    SELECT 'Partial Success (>0% Lots Awarded)', cast(coalesce(ps, 0) as bigint),
           coalesce(round_even(cast(ps as double) / cast(n as double) * 100.0, 2), 0.0) FROM {_F}""")
sql("lot_metric_bias", _metrics("cfc_ltag", ["TOTAL_VALUE_EUR", "DURATION"]))

# ---------------------------------------------------------------- stage 04
sql("master_merge", "SELECT * FROM master")
_FEATS = ["YEAR", "ID_TYPE", "ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "CPV", "LOTS_NUMBER",
          "B_EU_FUNDS", "TOP_TYPE", "TOTAL_VALUE_EUR", "IS_FRAMEWORK", "COOPERATIVE_PURCHASING",
          "TYPE_OF_CONTRACT", "CRIT_CODE", "NUTS_REGION_COUNT", "NUTS_LEVEL"]
sql("feature_consistency", " UNION ALL ".join(
    f"""SELECT '{f}' AS Feature,
        cast(sum(CASE WHEN "{f}_CFC" IS NOT DISTINCT FROM "{f}_CAN" THEN 1 ELSE 0 END) as bigint) AS Match_Count,
        cast(count(*) as bigint) AS Total_Count,
        round_even(cast(sum(CASE WHEN "{f}_CFC" IS NOT DISTINCT FROM "{f}_CAN" THEN 1 ELSE 0 END) as double)
                   / cast(count(*) as double) * 100.0, 2) AS Consistency_Rate_pct FROM master"""
    for f in _FEATS))
sql("ml_dataset", "SELECT * FROM ml")
sql("id_codes", """SELECT 'ID_NOTICE' AS Feature, JOIN_NOTICE AS "Value", code AS Code FROM ncode
    UNION ALL SELECT 'ID_LOT', JOIN_LOT, code FROM lcode""")
_SKEWED = ["NUMBER_OF_TENDERS", "LOTS_NUMBER", "DURATION", "NUTS_LEVEL", "PREPARATION_DAYS",
           "LOT_AWARD_VALUE_EUR", "TARGET_AWARD_VALUE_EUR", "ESTIMATED_VALUE_EUR"]
sql("log1p_features", "SELECT _row_pos, _row_pos2, " + ", ".join(
    f"round_even(CASE WHEN {c} > -1 THEN ln(1 + {c}) END, 9) AS {c}_LOG1P" for c in _SKEWED)
    + " FROM ml")

# ---------------------------------------------------------------- stage 05
sql("targets_present", "SELECT * FROM k1")
sql("logical_errors_removed", "SELECT * FROM k2")
sql("imputed_counts", "SELECT * FROM k3")


def _fence_rows(step: str, src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{step}' AS Step, '{c}' AS \"Column\", round_even(f_{c}, 4) AS Fence FROM {src}"
        for c in cols)


sql("iqr_thresholds", " UNION ALL ".join([
    _fence_rows("trim_log", "fz1", TARGETS), _fence_rows("cap_log", "fz2", INPUT_LOG),
    _fence_rows("cap_standard", "fz3", INPUT_STD)]))
sql("outliers_trimmed", "SELECT * FROM k4")
_CAPPED = ", ".join(f"round_even({c}, 4) AS {c}" for c in INPUT_LOG + INPUT_STD)
sql("winsorized", f"SELECT * REPLACE ({_CAPPED}) FROM k6")
sql("notice_first_row", f"""SELECT * REPLACE ({_CAPPED}) FROM (
    SELECT *, row_number() OVER (PARTITION BY ID_NOTICE ORDER BY _row_pos, _row_pos2) AS _rn FROM k6)
    WHERE _rn = 1""".replace("SELECT * REPLACE", "SELECT * EXCLUDE (_rn) REPLACE"))
_FAIL = "cast(coalesce(NUMBER_OF_TENDERS <= 1, false) as int)"
sql("failure_target", f"SELECT _row_pos, _row_pos2, ID_NOTICE, {_FAIL} AS TARGET_MARKET_FAILURE FROM k6")
sql("class_imbalance", f"""SELECT cast(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) as bigint) AS Negatives,
    cast(sum(y) as bigint) AS Positives,
    round_even(CASE WHEN sum(y) > 0 THEN cast(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) as double)
               / cast(sum(y) as double) ELSE 1.0 END, 6) AS Scale_Pos_Weight
    FROM (SELECT {_FAIL} AS y FROM k6)""")
sql("topk_categories", """SELECT ISO_COUNTRY_CODE, cast(count(*) as bigint) AS Count FROM k6
    WHERE ISO_COUNTRY_CODE IS NOT NULL GROUP BY ISO_COUNTRY_CODE
    ORDER BY Count DESC, ISO_COUNTRY_CODE LIMIT 10""")

# ---------------------------------------------------------------- splits
_KEY = "cast(_row_pos as varchar) || '-' || cast(_row_pos2 as varchar)"


def _h(key: str, seed: int) -> str:
    return f"cast(('0x' || substr(md5(cast({key} as varchar) || '|{seed}'), 1, 8)) as bigint)"


sql("hash_sample", f"""SELECT _row_key, ID_NOTICE FROM (SELECT {_KEY} AS _row_key, ID_NOTICE FROM k6)
    ORDER BY {_h('_row_key', 42)}, _row_key LIMIT 500""")
sql("group_split", f"""SELECT {_KEY} AS _row_key, ID_NOTICE,
    cast({_h('ID_NOTICE', 42)} % 1000 < 200 as int) AS _is_test FROM k6""")
sql("row_split", f"""SELECT _row_key, cast({_h('_row_key', 42)} % 1000 < 200 as int) AS _is_test
    FROM (SELECT {_KEY} AS _row_key FROM k6)""")
sql("group_folds", f"""SELECT {_KEY} AS _row_key, ID_NOTICE,
    cast({_h('ID_NOTICE', 43)} % 3 as int) AS fold FROM k6""")
sql("row_folds", f"""SELECT _row_key, cast({_h('_row_key', 43)} % 3 as int) AS fold
    FROM (SELECT {_KEY} AS _row_key FROM k6)""")


# ---------------------------------------------------------------- sources
_TOKENS = ", ".join("'" + t + "'" for t in ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN",
                                              "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                                              "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
_STR_CFC = ["ID_LOT", "TOP_TYPE", "ISO_COUNTRY_CODE", "CPV", "TAL_LOCATION_NUTS", "DT_DISPATCH",
            "DT_APPLICATIONS", "B_EU_FUNDS", "B_FRA_AGREEMENT", "FRA_ESTIMATED", "XSD_VERSION",
            "CAE_TYPE", "MAIN_ACTIVITY", "TYPE_OF_CONTRACT", "CRIT_CODE", "ID_TYPE", "FUTURE_CAN_ID",
            "B_RECURRENT_PROCUREMENT"]
sql("ingest_roundtrip", "SELECT * EXCLUDE (_row_pos) REPLACE ("
    + ", ".join(f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}" for c in _STR_CFC)
    + "), _row_pos AS _src_pos, cast(row_number() OVER (ORDER BY _row_pos) - 1 as bigint) AS _row_pos FROM cfc")


# ids as numbers: equality of the values themselves, nulls match nothing
_NUM_SIDES = """
WITH k AS (SELECT *, l_orderkey * CASE WHEN l_orderkey % 2 = 0 THEN 100000 ELSE 1 END AS key FROM lineitem),
a AS (SELECT CASE WHEN l_orderkey % 5 <> 0 THEN key END AS n,
             CASE WHEN l_linenumber <> 2 THEN l_linenumber ELSE -1 END AS l FROM k WHERE l_linenumber <= 3),
b AS (SELECT key AS n, CASE WHEN l_linenumber <> 2 THEN l_linenumber ELSE -1 END AS l
      FROM k WHERE l_linenumber >= 2 AND l_orderkey % 3 <> 0),
na AS (SELECT DISTINCT n FROM a WHERE n IS NOT NULL), nb AS (SELECT DISTINCT n FROM b),
la AS (SELECT DISTINCT n, l FROM a WHERE n IS NOT NULL), lb AS (SELECT DISTINCT n, l FROM b),
ma AS (SELECT nb.n IS NOT NULL AS notice, lb.n IS NOT NULL AS lot FROM a LEFT JOIN nb ON a.n = nb.n LEFT JOIN lb ON a.n = lb.n AND a.l = lb.l),
mb AS (SELECT na.n IS NOT NULL AS notice, la.n IS NOT NULL AS lot FROM b LEFT JOIN na ON b.n = na.n LEFT JOIN la ON b.n = la.n AND b.l = la.l)
"""


def _numeric(level: str, shared: str) -> str:
    return " UNION ALL ".join(
        [f"SELECT '{level}' AS Level, '{side}_{name}' AS Frame, cast(count(*) FILTER ({test}) AS bigint) AS Rows FROM m{t}"
         for side, t in (("cfc", "a"), ("can", "b")) for name, test in (("matched", level), ("orphans", f"NOT {level}"))]
        + [f"SELECT '{level}', 'shared_keys', cast(count(*) AS bigint) FROM ({shared})"])


ORACLE["notice_split_numeric_ids"] = (_NUM_SIDES + _numeric("notice", "SELECT n FROM na INTERSECT SELECT n FROM nb") + " UNION ALL "
                                      + _numeric("lot", "SELECT n, l FROM la INTERSECT SELECT n, l FROM lb"))
