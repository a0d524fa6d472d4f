"""DuckDB oracles for ``plans.analytics``."""

from __future__ import annotations

from itertools import combinations

from noticeflow.plans.oracle import INPUT_LOG, INPUT_STD, with_all

ORACLE: dict[str, str] = {}

_GOLD = ("gold AS (SELECT * REPLACE ("
         + ", ".join(f"round_even({c}, 4) AS {c}" for c in INPUT_LOG + INPUT_STD)
         + ") FROM k6)")
_KEY = "cast(_row_pos as varchar) || '-' || cast(_row_pos2 as varchar)"
_H = f"cast(('0x' || substr(md5({_KEY} || '|42'), 1, 8)) as bigint)"
_SAMPLE = "gsample AS (SELECT * FROM gold)"


def sql(name: str, select: str) -> None:
    ORACLE[name] = _wrap(select)


def _wrap(select: str) -> str:
    base = with_all("SELECT 1")
    head = base[: base.rindex("SELECT 1")]
    return f"{head.rstrip()},\n{_GOLD},\n{_SAMPLE}\n{select}"


def SIG(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN cast(printf('%.9e', cast({x} as double)) as double) END"


GOLD_NUM = ["_row_pos", "_row_pos2", "NUMBER_OF_TENDERS", "TARGET_AWARD_VALUE_EUR",
            "LOT_AWARD_VALUE_EUR", "YEAR", "LOTS_NUMBER", "B_EU_FUNDS", "DURATION",
            "B_RECURRENT_PROCUREMENT", "ESTIMATED_VALUE_EUR", "IS_FRAMEWORK",
            "COOPERATIVE_PURCHASING", "NUTS_REGION_COUNT", "NUTS_LEVEL", "PREPARATION_DAYS",
            "ID_NOTICE", "ID_LOT"]
GOLD_STR = ["ID_TYPE", "ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "CPV", "TOP_TYPE",
            "CRIT_CODE", "TYPE_OF_CONTRACT"]
CATS = ["ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "TOP_TYPE", "CPV", "ID_TYPE",
        "TYPE_OF_CONTRACT", "CRIT_CODE"]
CORR = ["TARGET_AWARD_VALUE_EUR", "LOT_AWARD_VALUE_EUR", "ESTIMATED_VALUE_EUR",
        "NUMBER_OF_TENDERS", "DURATION", "PREPARATION_DAYS", "NUTS_LEVEL", "LOTS_NUMBER"]
CLUSTER_NUMERIC = ["TARGET_AWARD_VALUE_EUR", "LOTS_NUMBER", "PREPARATION_DAYS",
                   "NUTS_REGION_COUNT", "NUMBER_OF_TENDERS"]


def _prof_row(c: str, num: bool) -> str:
    q = f'"{c}"'
    nulls = f"count(*) - count({q})"
    base = (f"SELECT '{c}' AS \"Column\", cast(count({q}) as bigint) AS Count, "
            f"cast({nulls} as bigint) AS Nulls, "
            f"round_even(cast({nulls} as double) / cast(count(*) as double) * 100.0, 2) AS Null_pct, "
            f"cast(count(DISTINCT {q}) as bigint) AS \"Distinct\", ")
    if num:
        v = f"cast({q} as double)"
        return base + (f"cast(coalesce(sum(CASE WHEN {v} = 0 THEN 1 ELSE 0 END), 0) as bigint) AS Zeros, "
                       f"cast(coalesce(sum(CASE WHEN {v} < 0 THEN 1 ELSE 0 END), 0) as bigint) AS Negatives, "
                       f"min({v}) AS \"Min\", max({v}) AS \"Max\", {SIG(f'avg({v})')} AS Mean, "
                       f"{SIG(f'stddev_samp({v})')} AS Std FROM gold")
    return base + ("cast(NULL as bigint) AS Zeros, cast(NULL as bigint) AS Negatives, "
                   "cast(NULL as double) AS \"Min\", cast(NULL as double) AS \"Max\", "
                   "cast(NULL as double) AS Mean, cast(NULL as double) AS Std FROM gold")


sql("profile_minimal", " UNION ALL ".join(
    [_prof_row(c, True) for c in GOLD_NUM] + [_prof_row(c, False) for c in GOLD_STR]))

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"Column\", cast({c} as double) AS v FROM gsample"
                           for c in CORR)
sql("profile_histogram", f"""SELECT "Column", cast(CASE WHEN hi - lo > 0 THEN
      least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END as int) AS Bin, cast(count(*) as bigint) AS Count
    FROM (SELECT l.*, r.lo, r.hi FROM ({_LONG}) l JOIN
          (SELECT "Column", min(v) AS lo, max(v) AS hi FROM ({_LONG}) x WHERE v IS NOT NULL GROUP BY "Column") r
          USING ("Column") WHERE v IS NOT NULL) GROUP BY ALL""")
_SLONG = " UNION ALL ".join(f"SELECT '{c}' AS \"Column\", cast({c} as varchar) AS \"Value\" FROM gsample"
                            for c in CATS)
sql("profile_topk", f"""SELECT * FROM (
    SELECT "Column", "Value", cast(count(*) as bigint) AS Count,
           cast(row_number() OVER (PARTITION BY "Column" ORDER BY count(*) DESC, "Value") as int) AS Rank
    FROM ({_SLONG}) WHERE "Value" IS NOT NULL GROUP BY "Column", "Value") WHERE Rank <= 5""")
sql("profile_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS Column_A, '{b}' AS Column_B, {SIG(f'corr(cast({a} as double), cast({b} as double))')} AS Pearson FROM gsample"
    for a, b in combinations(CORR, 2)))
_CLONG = " UNION ALL ".join(f"SELECT '{c}' AS Feature, cast({c} as varchar) AS \"Value\" FROM gold"
                            for c in CATS)
sql("encoding_dictionary", f"""SELECT Feature, cast(row_number() OVER (PARTITION BY Feature
      ORDER BY CASE WHEN allnum THEN TRY_CAST("Value" AS DOUBLE) END, "Value") - 1 as bigint) AS Code, "Value"
    FROM (SELECT DISTINCT Feature, "Value" FROM ({_CLONG}) WHERE "Value" IS NOT NULL) v
    JOIN (SELECT Feature, bool_and(TRY_CAST("Value" AS DOUBLE) IS NOT NULL) AS allnum FROM ({_CLONG})
          WHERE "Value" IS NOT NULL GROUP BY Feature) f USING (Feature)""")

_XSD = "NOT coalesce(contains(cast(XSD_VERSION as varchar), '8'), false)"
_S2 = f"{_XSD} AND coalesce(CANCELLED = 0, false)"
_S3 = f"{_S2} AND coalesce(OUT_OF_DIRECTIVES = 0, false)"
_S4 = f"{_S3} AND INFO_ON_NON_AWARD IS DISTINCT FROM 'PROCUREMENT_DISCONTINUED'"
_T = "coalesce(TRY_CAST(NUMBER_TENDERS_SME AS DOUBLE), TRY_CAST(NUMBER_TENDERS_OTHER_EU AS DOUBLE)) IS NOT NULL"
_FILL = f"coalesce(INFO_ON_NON_AWARD = 'PROCUREMENT_UNSUCCESSFUL' AND NOT ({_T}), false)"


def _audit(ds: str, src: str, steps: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{ds}' AS Dataset, '{n}' AS Step, cast(coalesce(sum(CASE WHEN {e} THEN 1 ELSE 0 END), 0) as bigint) AS \"Rows\" FROM {src}"
        for n, e in steps)


_VAL = "coalesce(VALUE_EURO_FIN_2, VALUE_EURO) IS NOT NULL"
sql("pipeline_audit", _audit("CFC", "cfc", [
    ("input", "true"), ("after_xsd_version", _XSD), ("after_cancelled", _S2),
    ("after_out_of_directives", _S3), ("total_value_valid", f"{_S3} AND {_VAL}")])
    + " UNION ALL " + _audit("CAN", "can", [
    ("input", "true"), ("after_xsd_version", _XSD), ("after_cancelled", _S2),
    ("after_out_of_directives", _S3), ("after_discontinued", _S4),
    ("total_value_valid", f"{_S4} AND {_VAL}"), ("tenders_filled_zero", f"{_S4} AND {_FILL}"),
    ("tenders_valid", f"{_S4} AND (({_T}) OR {_FILL})")]))
sql("join_fanout", """SELECT a._kn AS JOIN_NOTICE, a._kl AS JOIN_LOT, a.n AS n_cfc, b.n AS n_can,
      a.n * b.n AS fanout
    FROM (SELECT _kn, _kl, cast(count(*) as bigint) AS n FROM cfc_nk WHERE _kn IS NOT NULL GROUP BY ALL) a
    JOIN (SELECT _kn, _kl, cast(count(*) as bigint) AS n FROM can_nk WHERE _kn IS NOT NULL GROUP BY ALL) b
      USING (_kn, _kl)
    ORDER BY fanout DESC, JOIN_NOTICE, JOIN_LOT LIMIT 20""")
sql("cluster_category_share", """SELECT TYPE_OF_CONTRACT AS Cluster, ISO_COUNTRY_CODE AS Category,
      round_even(cast(c as double) / cast(sum(c) OVER (PARTITION BY TYPE_OF_CONTRACT) as double) * 100.0, 6) AS Pct
    FROM (SELECT TYPE_OF_CONTRACT, ISO_COUNTRY_CODE, count(*) AS c FROM gold
          WHERE ISO_COUNTRY_CODE IN (SELECT ISO_COUNTRY_CODE FROM gold WHERE ISO_COUNTRY_CODE IS NOT NULL
                                     GROUP BY ISO_COUNTRY_CODE ORDER BY count(*) DESC, ISO_COUNTRY_CODE LIMIT 10)
            AND TYPE_OF_CONTRACT IS NOT NULL
          GROUP BY ALL)""")
_BLONG = " UNION ALL ".join(
    f"SELECT TYPE_OF_CONTRACT AS Cluster, '{c}' AS Feature, cast({c} as double) AS v FROM gold "
    f"WHERE {c} IS NOT NULL" for c in CLUSTER_NUMERIC)
sql("cluster_boxplot", f"""SELECT l.Cluster, l.Feature, Q1, Median, Q3,
      min(CASE WHEN v >= Q1 - 1.5 * (Q3 - Q1) AND v <= Q3 + 1.5 * (Q3 - Q1) THEN v END) AS Whisker_Low,
      max(CASE WHEN v >= Q1 - 1.5 * (Q3 - Q1) AND v <= Q3 + 1.5 * (Q3 - Q1) THEN v END) AS Whisker_High,
      cast(sum(CASE WHEN v >= Q1 - 1.5 * (Q3 - Q1) AND v <= Q3 + 1.5 * (Q3 - Q1) THEN 0 ELSE 1 END) as bigint) AS Outliers
    FROM ({_BLONG}) l JOIN (SELECT Cluster, Feature, quantile_cont(v, 0.25) AS Q1, quantile_cont(v, 0.5) AS Median,
                                   quantile_cont(v, 0.75) AS Q3 FROM ({_BLONG}) GROUP BY ALL) q
      ON l.Cluster IS NOT DISTINCT FROM q.Cluster AND l.Feature = q.Feature
    GROUP BY l.Cluster, l.Feature, Q1, Median, Q3""")
sql("deviation_target", f"""SELECT ID_NOTICE,
      {SIG('TARGET_AWARD_VALUE_EUR / ESTIMATED_VALUE_EUR')} AS TARGET_BUDGET_DEVIATION_RATIO,
      {SIG('ln(TARGET_AWARD_VALUE_EUR / ESTIMATED_VALUE_EUR)')} AS LOG_DEVIATION
    FROM (SELECT *, row_number() OVER (PARTITION BY ID_NOTICE ORDER BY _row_pos, _row_pos2) AS rn FROM gold)
    WHERE rn = 1 AND TARGET_AWARD_VALUE_EUR > 0 AND ESTIMATED_VALUE_EUR > 0""")

_REG = "(SELECT l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem)"
sql("regression_metrics", f"""SELECT {SIG('median(abs(y - p))')} AS MedAE, {SIG('avg(abs(y - p))')} AS MAE,
      {SIG('sqrt(avg((y - p) * (y - p)))')} AS RMSE,
      {SIG('1.0 - sum((y - p) * (y - p)) / sum((y - my) * (y - my))')} AS R2,
      {SIG('1.0 - (sum((y - p) * (y - p)) / sum((y - my) * (y - my))) * (cast(count(*) as double) - 1.0) / (cast(count(*) as double) - 6.0 - 1.0)')} AS Adj_R2
    FROM (SELECT y, p, avg(y) OVER () AS my FROM {_REG})""")
sql("regression_density", f"""SELECT
      cast(CASE WHEN hi > lo THEN least(floor((y - lo) / (hi - lo) * 50), 49) ELSE 0 END as int) AS Bin_Actual,
      cast(CASE WHEN hi > lo THEN least(floor((p - lo) / (hi - lo) * 50), 49) ELSE 0 END as int) AS Bin_Predicted,
      cast(count(*) as bigint) AS Count
    FROM {_REG}, (SELECT least(min(y), min(p)) AS lo, greatest(max(y), max(p)) AS hi FROM {_REG})
    GROUP BY ALL""")
_DOCS = ("(SELECT quality AS y, cast(n_chars as double) AS score, cast(n_chars >= 3000 as int) AS pred "
         "FROM labels JOIN documents USING (doc_id))")
_CM = f"""(SELECT a.l AS Actual, p.l AS Predicted, cast(coalesce(c, 0) as bigint) AS Count
    FROM (SELECT DISTINCT l FROM (SELECT y AS l FROM {_DOCS} UNION SELECT pred FROM {_DOCS})) a
    CROSS JOIN (SELECT DISTINCT l FROM (SELECT y AS l FROM {_DOCS} UNION SELECT pred FROM {_DOCS})) p
    LEFT JOIN (SELECT y, pred, count(*) AS c FROM {_DOCS} GROUP BY ALL) k ON k.y = a.l AND k.pred = p.l)"""
sql("confusion_matrix", f"SELECT * FROM {_CM}")
_PER = f"""(SELECT l, tp, sup, pp, coalesce(cast(tp as double) / nullif(cast(pp as double), 0), 0.0) AS pr,
      coalesce(cast(tp as double) / nullif(cast(sup as double), 0), 0.0) AS rc FROM (
      SELECT Actual AS l, sum(CASE WHEN Actual = Predicted THEN Count ELSE 0 END) AS tp, sum(Count) AS sup
      FROM {_CM} GROUP BY Actual) JOIN (SELECT Predicted AS l, sum(Count) AS pp FROM {_CM} GROUP BY Predicted)
      USING (l))"""
_PERF = f"(SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) AS f1 FROM {_PER})"
sql("classification_report", f"""
    SELECT cast(l as varchar) AS Label, {SIG('pr')} AS Precision, {SIG('rc')} AS Recall, {SIG('f1')} AS F1,
           cast(sup as bigint) AS Support FROM {_PERF}
    UNION ALL SELECT 'macro avg', {SIG('avg(pr)')}, {SIG('avg(rc)')}, {SIG('avg(f1)')}, cast(sum(sup) as bigint) FROM {_PERF}
    UNION ALL SELECT 'weighted avg', {SIG('sum(pr * sup) / sum(sup)')}, {SIG('sum(rc * sup) / sum(sup)')},
           {SIG('sum(f1 * sup) / sum(sup)')}, cast(sum(sup) as bigint) FROM {_PERF}
    UNION ALL SELECT 'accuracy', NULL, NULL, {SIG('cast(sum(tp) as double) / cast(sum(sup) as double)')},
           cast(sum(sup) as bigint) FROM {_PERF}""")
_SG = f"(SELECT score AS s, sum(y) AS pos, count(*) AS cnt FROM {_DOCS} WHERE score IS NOT NULL GROUP BY score)"
_DESC = f"(SELECT *, sum(pos) OVER (ORDER BY s DESC) AS pc, sum(cnt) OVER (ORDER BY s DESC) AS cc FROM {_SG})"
sql("average_precision", f"""SELECT {SIG('sum(pos * pc / cc) / cast(sum(pos) as double)')} AS Average_Precision
    FROM {_DESC}""")
sql("roc_auc", f"""SELECT {SIG('sum(pos * (nc - neg * 0.5)) / cast(sum(pos) * sum(neg) as double)')} AS ROC_AUC
    FROM (SELECT *, sum(neg) OVER (ORDER BY s) AS nc FROM (SELECT *, cnt - pos AS neg FROM {_SG}))""")
sql("pr_curve", f"""SELECT s AS Threshold, {SIG('cast(pc as double) / cast(cc as double)')} AS Precision,
      {SIG('cast(pc as double) / cast(sum(pos) OVER () as double)')} AS Recall FROM {_DESC}""")

_EX = ("(SELECT label AS l, vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i "
       "FROM embeddings WHERE label <> -1)")
_CENT = f"(SELECT l, i, avg(cast(x as double)) AS m FROM {_EX} GROUP BY l, i)"
_N = "(SELECT label AS l, count(*) AS n FROM embeddings WHERE label <> -1 GROUP BY label)"
_PD = f"""(SELECT e.l, e.vec_id, sum((cast(e.x as double) - c.m) * (cast(e.x as double) - c.m)) AS d2
    FROM {_EX} e JOIN {_CENT} c ON e.l = c.l AND e.i = c.i GROUP BY e.l, e.vec_id)"""
_S = f"(SELECT l, avg(sqrt(d2)) AS s FROM {_PD} GROUP BY l)"
_CD = f"""(SELECT a.l AS la, b.l AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d
    FROM {_CENT} a JOIN {_CENT} b ON a.i = b.i AND a.l <> b.l GROUP BY a.l, b.l)"""
sql("davies_bouldin", f"""SELECT {SIG('avg(r)')} AS Davies_Bouldin FROM (
    SELECT cd.la, max((sa.s + sb.s) / cd.d) AS r FROM {_CD} cd
    JOIN {_S} sa ON sa.l = cd.la JOIN {_S} sb ON sb.l = cd.lb GROUP BY cd.la)""")
_G = f"(SELECT i, avg(cast(x as double)) AS g FROM {_EX} GROUP BY i)"
sql("calinski_harabasz", f"""SELECT {SIG('CASE WHEN k >= 2 THEN (b / (k - 1)) / (w / (n - k)) END')}
    AS Calinski_Harabasz FROM
    (SELECT sum(d2) AS w, count(*) AS n FROM {_PD}),
    (SELECT sum(n * bl) AS b, count(*) AS k FROM
       (SELECT c.l, sum((c.m - g.g) * (c.m - g.g)) AS bl FROM {_CENT} c JOIN {_G} g USING (i) GROUP BY c.l)
       JOIN {_N} USING (l))""")

_PT = ("(SELECT label AS l, vec_id, list_transform(embedding, lambda v: cast(v as double)) AS x, "
       "list_sum(list_transform(embedding, lambda v: cast(v as double) * cast(v as double))) AS x2 "
       "FROM embeddings WHERE label <> -1)")
_CV = f"(SELECT l, list(m ORDER BY i) AS c FROM {_CENT} GROUP BY l)"
_CS = f"(SELECT c.l, n.n, c.c, m.m2 FROM {_CV} c JOIN {_N} n USING (l) JOIN (SELECT l, avg(x2) AS m2 FROM {_PT} GROUP BY l) m USING (l))"
_PD2 = f"""(SELECT p.vec_id, p.l AS pl, s.l AS cl, s.n,
      p.x2 - 2.0 * list_sum(list_transform(list_zip(p.x, s.c), lambda t: t[1] * t[2])) + s.m2 AS d
    FROM {_PT} p, {_CS} s)"""
_PER = f"""(SELECT vec_id, max(CASE WHEN cl = pl THEN n END) AS n1,
      max(CASE WHEN cl = pl AND n > 1 THEN d * cast(n as double) / cast(n - 1 as double) END) AS a,
      min(CASE WHEN cl <> pl THEN d END) AS b FROM {_PD2} GROUP BY vec_id)"""
sql("silhouette_sample", f"""SELECT {SIG('avg(CASE WHEN n1 <= 1 THEN 0.0 WHEN a < b THEN 1.0 - a / b WHEN a > b THEN b / a - 1.0 ELSE 0.0 END)')}
    AS Silhouette_SqEuclidean FROM {_PER}""")

_SAMP = ("(SELECT vec_id, label AS l, list_transform(embedding, lambda v: cast(v as double)) AS x FROM embeddings WHERE label <> -1 "
         "ORDER BY cast(('0x' || substr(md5(cast(vec_id as varchar) || '|42'), 1, 8)) as bigint), vec_id LIMIT 2000)")
_PAIR = f"""(SELECT p.vec_id, p.l AS pl, o.l AS cl, count(*) AS n,
      sum(sqrt(list_sum(list_transform(list_zip(p.x, o.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) AS d
    FROM {_SAMP} p, {_SAMP} o GROUP BY p.vec_id, p.l, o.l)"""
_PEU = f"""(SELECT vec_id, max(CASE WHEN cl = pl THEN n END) AS n1, max(CASE WHEN cl = pl AND n > 1 THEN d / (n - 1) END) AS a,
      min(CASE WHEN cl <> pl THEN d / n END) AS b FROM {_PAIR} GROUP BY vec_id)"""
sql("silhouette_euclidean", f"""SELECT CASE WHEN count(b) > 0 THEN {SIG('avg(CASE WHEN n1 <= 1 THEN 0.0 WHEN a < b THEN 1.0 - a / b WHEN a > b THEN b / a - 1.0 ELSE 0.0 END)')}
    ELSE -1.0 END AS Silhouette_Euclidean FROM {_PEU}""")


def _spread(c: str, num: bool) -> str:
    q = lambda p: SIG(f"(SELECT quantile_cont(cast({c} as double), {p}) FROM gold)") if num else "cast(null as double)"
    top = f"(SELECT {{}} FROM (SELECT cast({c} as varchar) AS v, count(*) AS n FROM gold WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
    return (f"SELECT '{c}' AS \"Column\", {q(0.25)} AS Q25, {q(0.5)} AS Median, {q(0.75)} AS Q75, {top.format('v')} AS Top, "
            f"cast({top.format('n')} as bigint) AS Top_Count")


sql("profile_spread", " UNION ALL ".join([_spread(c, True) for c in CORR] + [_spread(c, False) for c in CATS]))


def _audit2(rows: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS Stage, '{p}' AS Step, '{m}' AS Measure, cast({e} as bigint) AS Count" for s, p, m, e in rows)


def _count(src: str, where: str = "true") -> str:
    return f"(SELECT count(*) FROM {src} WHERE {where})"


sql("stage_audit", _audit2(
    [("01", t, "rows", _count(f"{t}_prep")) for t in ("cfc", "can")] + [("02", t, "rows", _count(f"{t}_n")) for t in ("cfc", "can")]
    + [("03", t, "rows", _count(f"{t}_l")) for t in ("cfc", "can")] + [("04", "merged", "rows", _count("ml"))]
    + [("05", "targets_present", "rows", _count("k1")), ("05", "logical_errors_removed", "rows", _count("k2"))]
    + [("05", "logical_errors_removed", f"missing_{c}", _count("k2", f"{c} IS NULL")) for c in ("B_EU_FUNDS", "B_RECURRENT_PROCUREMENT", "CRIT_CODE", "TOP_TYPE")]
    + [("05", "outliers_removed", "rows", _count("k4")), ("05", "capped_log", "rows", _count("k4")), ("05", "capped_standard", "rows", _count("k5"))]
    + [("05", "capped_log", f"capped_{c}", _count("k4, fz2", f"{c} > f_{c}")) for c in INPUT_LOG]
    + [("05", "capped_standard", f"capped_{c}", _count("k5, fz3", f"{c} > f_{c}")) for c in INPUT_STD]))
