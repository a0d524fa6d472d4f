"""DuckDB oracles for the preprocessing queries of ``plans.ml``."""

from __future__ import annotations

from noticeflow.plans.analytics_oracle import SIG, _wrap

ORACLE: dict[str, str] = {}

NUM = ["LOT_AWARD_VALUE_EUR", "DURATION", "PREPARATION_DAYS", "LOTS_NUMBER",
       "NUTS_REGION_COUNT", "NUTS_LEVEL", "B_EU_FUNDS", "IS_FRAMEWORK",
       "COOPERATIVE_PURCHASING", "B_RECURRENT_PROCUREMENT"]
CAT = ["ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "TOP_TYPE", "CPV", "TYPE_OF_CONTRACT",
       "CRIT_CODE"]
_CT = ("(SELECT *, cast(_row_pos as varchar) || '-' || cast(_row_pos2 as varchar) AS _row_key, "
       "cast(cast(('0x' || substr(md5(cast(ID_NOTICE as varchar) || '|42'), 1, 8)) as bigint) % 1000 < 200 "
       "as int) AS _is_test FROM gold)")
_MED = "(SELECT " + ", ".join(f"quantile_cont(cast({c} as double), 0.5) AS med_{c}" for c in NUM) + \
       f" FROM {_CT} WHERE _is_test = 0)"
_LG = "(SELECT t.*, m.*, " + ", ".join(
    f"ln(1 + coalesce(cast({c} as double), med_{c})) AS lg_{c}" for c in NUM) + f" FROM {_CT} t, {_MED} m)"
_MOM = "(SELECT " + ", ".join(f"avg(lg_{c}) AS mean_{c}, stddev_pop(lg_{c}) AS std_{c}" for c in NUM) + \
       f" FROM {_LG} WHERE _is_test = 0)"
ORACLE["numeric_scaled"] = _wrap("SELECT _row_key, " + ", ".join(
    SIG(f"(lg_{c} - mean_{c}) / CASE WHEN std_{c} > 0 THEN std_{c} ELSE 1.0 END") + f" AS {c}_scaled"
    for c in NUM) + f" FROM {_LG} l, {_MOM} s")

_MODE = "(SELECT " + ", ".join(
    f"(SELECT v FROM (SELECT cast({c} as varchar) AS v, count(*) AS n FROM {_CT} WHERE _is_test = 0 "
    f"AND {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode_{c}" for c in CAT) + ")"
_FILLED = "(SELECT _row_key, _is_test, " + ", ".join(
    f"coalesce(cast({c} as varchar), mode_{c}) AS {c}" for c in CAT) + f" FROM {_CT}, {_MODE})"
_LONG = " UNION ALL ".join(f"SELECT _row_key, _is_test, '{c}' AS \"Column\", {c} AS Category FROM {_FILLED}"
                           for c in CAT)
ORACLE["onehot_features"] = _wrap(f"""SELECT l._row_key, l."Column", l.Category FROM ({_LONG}) l
    JOIN (SELECT "Column", Category FROM (SELECT DISTINCT "Column", Category FROM ({_LONG}) WHERE _is_test = 0
                                           AND Category IS NOT NULL) d
          WHERE Category > (SELECT min(Category) FROM ({_LONG}) x WHERE x._is_test = 0 AND x."Column" = d."Column"))
      k ON l."Column" = k."Column" AND l.Category = k.Category""")

# ------------------------------------------- optimality of the fitted models
_Y = "cast(coalesce(NUMBER_OF_TENDERS <= 1, false) as double)"


def _filled(base: str, cats: list[str], extra: str) -> str:
    """Training rows of ``base`` with the mode in place of missing categories."""
    mode = "(SELECT " + ", ".join(
        f"(SELECT v FROM (SELECT cast({c} as varchar) AS v, count(*) AS n FROM {base} WHERE {c} IS NOT NULL GROUP BY 1) "
        f"ORDER BY n DESC, v LIMIT 1) AS mode_{c}" for c in cats) + ")"
    return "(SELECT " + extra + ", " + ", ".join(f"coalesce(cast({c} as varchar), mode_{c}) AS {c}" for c in cats) + f" FROM {base}, {mode})"


def _long(filled: str, cats: list[str], extra: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {extra}, '{c}' AS Source, {c} AS Slot FROM {filled}" for c in cats) + ")"


def _not_first(long: str) -> str:
    return f"Slot > (SELECT min(Slot) FROM {long} z WHERE z.Source = l.Source)"


_CTRAIN = f"(SELECT *, {_Y} AS y FROM {_CT} WHERE _is_test = 0)"
_CLONG2 = _long(_filled(_CTRAIN, CAT, "y"), CAT, "y")
_W1 = f"(SELECT count(*) / (2.0 * sum(y)) FROM {_CTRAIN})"
ORACLE["logreg_stationary"] = _wrap(f"""SELECT Source, Slot, round(sum(y) * {_W1}, 6) AS Weighted_Positives, true AS Stationary
    FROM {_CLONG2} l WHERE {_not_first(_CLONG2)} GROUP BY Source, Slot
    UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', '{c}', cast(null as double), true" for c in NUM))
ORACLE["tree_leaves"] = _wrap(f"""SELECT count(*) AS "Rows", round(cast(count(*) as double), 4) AS Weight, true AS Leaves_Agree FROM {_CTRAIN}""")
_SLOTS = f"""SELECT Source, count(DISTINCT Slot) - 1 AS Slots FROM {_CLONG2} l GROUP BY Source"""
ORACLE["importance_sums"] = _wrap(f"SELECT Source, cast(Slots as bigint) AS Slots, true AS Adds_Up, true AS Whole FROM ({_SLOTS} UNION ALL "
                                  + " UNION ALL ".join(f"SELECT '{c}', 1" for c in NUM) + ") WHERE Slots > 0")
_RATIO = f"(SELECT sum(1 - y) / sum(y) FROM {_CTRAIN})"
_GH = f"""SELECT Source, Slot, sum(w * (0.5 - y)) AS g, sum(w * 0.25) AS h FROM (
    SELECT *, CASE WHEN y = 1 THEN {_RATIO} ELSE 1.0 END AS w FROM {_CLONG2}) GROUP BY Source, Slot"""
ORACLE["boosted_first_split"] = _wrap(f"""SELECT * FROM (WITH hist AS ({_GH}), tot AS (SELECT sum(g) AS tg, sum(h) AS th FROM hist WHERE Source = '{CAT[0]}')
    SELECT Source AS "Column", Slot AS Category,
           round(g * g / (h + 1) + (tg - g) * (tg - g) / (th - h + 1) - tg * tg / (th + 1), 5) + 0.0 AS Gain, true AS Not_Above_Root
    FROM hist l, tot WHERE Slot > (SELECT min(Slot) FROM hist z WHERE z.Source = l.Source))""")

_FIRST = """(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY ID_NOTICE ORDER BY _row_pos, _row_pos2) AS _rn FROM gold)
             WHERE _rn = 1)"""
REG_CAT = ["ISO_COUNTRY_CODE", "CAE_TYPE", "CPV", "TYPE_OF_CONTRACT", "CRIT_CODE", "TOP_TYPE"]
REG_NUM = ["DURATION", "PREPARATION_DAYS", "LOTS_NUMBER", "NUTS_REGION_COUNT", "B_EU_FUNDS", "B_RECURRENT_PROCUREMENT"]
_REG = f"""(SELECT *, ln(TARGET_AWARD_VALUE_EUR / ESTIMATED_VALUE_EUR) AS y,
    cast(cast(('0x' || substr(md5(cast(ID_NOTICE as varchar) || '|42'), 1, 8)) as bigint) % 1000 < 200 as int) AS _is_test
    FROM {_FIRST} WHERE TARGET_AWARD_VALUE_EUR > 0 AND ESTIMATED_VALUE_EUR > 0)"""
_RTRAIN = f"(SELECT * FROM {_REG} WHERE _is_test = 0)"
_RLONG = _long(_filled(_RTRAIN, REG_CAT, "y"), REG_CAT, "y")
ORACLE["lasso_optimal"] = _wrap(f"""SELECT Source, Slot, cast(count(*) as bigint) AS "Rows", true AS Optimal FROM {_RLONG} l
    WHERE {_not_first(_RLONG)} GROUP BY Source, Slot
    UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', '{c}', cast(null as bigint), true" for c in REG_NUM))
ORACLE["forest_range"] = _wrap(f"""SELECT count(*) AS "Rows", {SIG('min(y)')} AS Least, {SIG('max(y)')} AS Greatest, true AS Inside, true AS Better_Than_Mean FROM {_RTRAIN}""")
ORACLE["evaluation_identities"] = _wrap(f"""SELECT 'class ' || cast(cast(y as int) as varchar) AS Part, count(*) AS "Rows", true AS Agrees
    FROM (SELECT {_Y} AS y FROM {_CT} WHERE _is_test = 1) GROUP BY 1
    UNION ALL SELECT 'deviation', count(*), true FROM {_REG} WHERE _is_test = 1""")

CLU = ["TARGET_AWARD_VALUE_EUR", "LOTS_NUMBER", "PREPARATION_DAYS", "NUTS_REGION_COUNT", "NUMBER_OF_TENDERS"]
_CMED = "(SELECT " + ", ".join(f"quantile_cont(cast({c} as double), 0.5) AS med_{c}" for c in CLU) + f" FROM {_FIRST})"
_CLG = "(SELECT " + ", ".join(f"ln(1 + coalesce(cast({c} as double), med_{c})) AS lg{i}" for i, c in enumerate(CLU)) + f" FROM {_FIRST}, {_CMED})"
_CST = "(SELECT " + ", ".join(f"avg(lg{i}) AS m{i}, stddev_pop(lg{i}) AS s{i}" for i in range(5)) + f" FROM {_CLG})"
_CX = "(SELECT " + ", ".join(f"(lg{i} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1.0 END AS x{i}" for i in range(5)) + f" FROM {_CLG}, {_CST})"
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]


def _moments(cols: str, pairs: list[tuple[int, int]]) -> str:
    sums = ", ".join(f"round(avg(x{i} * x{j}), 6) + 0.0 AS m{i}_{j}" for i, j in _PAIRS) + ", " + \
        ", ".join(f"round(avg(x{i}), 6) + 0.0 AS a{i}" for i in range(5)) + ", count(*) AS n"
    return f"SELECT * FROM (WITH q AS MATERIALIZED (SELECT {sums} FROM {_CX}) " + " UNION ALL ".join(f"SELECT {cols.format(i=i, j=j)} FROM q" for i, j in pairs) + ")"


ORACLE["gmm_moments"] = _wrap(_moments("cast({i} as int) AS I, cast({j} as int) AS J, a{i} AS Mean, m{i}_{j} AS Moment", _PAIRS))
ORACLE["gmm_diag_moments"] = _wrap(_moments("cast({i} as int) AS Feature, a{i} AS Mean, m{i}_{j} AS Moment, true AS Monotone", [(i, i) for i in range(5)]))
ORACLE["kmeans_moments"] = _wrap(_moments('cast({i} as int) AS I, cast({j} as int) AS J, n AS "Rows", m{i}_{j} AS Moment, true AS Decomposed, true AS Nearest', _PAIRS))

# the two greatest eigenvalues of the covariance matrix by power iteration
_ROWS5 = [f"[{', '.join(f'c{min(i, j)}_{max(i, j)}' for j in range(5))}]" for i in range(5)]
_MUL = "[" + ", ".join(f"list_dot_product(m[{i + 1}], v)" for i in range(5)) + "]"
_UNIT = "list_transform(u, lambda e: e / sqrt(list_dot_product(u, u)))"


def _power(name: str, matrix: str) -> str:
    return (f"{name} AS (SELECT 0 AS step, m, [1.0, 0.9, 0.8, 0.7, 0.6]::DOUBLE[] AS v FROM {matrix} UNION ALL "
            f"SELECT step + 1, m, {_UNIT} FROM (SELECT step, m, {_MUL} AS u FROM {name} WHERE step < 3000)), "
            f"{name}_end AS (SELECT m, v, list_dot_product(v, {_MUL}) AS val FROM {name} WHERE step = 3000)")


_COVS = ", ".join(f"covar_samp(x{i}, x{j}) AS c{i}_{j}" for i, j in _PAIRS)
_DEFLATED = "[" + ", ".join("[" + ", ".join(f"m[{i + 1}][{j + 1}] - val * v[{i + 1}] * v[{j + 1}]" for j in range(5)) + "]" for i in range(5)) + "]"
ORACLE["pca_explained"] = _wrap(f"""SELECT * FROM (WITH RECURSIVE cov AS MATERIALIZED (SELECT count(*) AS n, [{', '.join(_ROWS5)}]::DOUBLE[][] AS m FROM
      (SELECT x0, x1, x2, x3, x4, 1 AS one FROM {_CX}), (SELECT {_COVS} FROM {_CX}) GROUP BY ALL),
    {_power('p', 'cov')}, defl AS (SELECT {_DEFLATED} AS m FROM p_end), {_power('q', 'defl')},
    tr AS (SELECT n, m[1][1] + m[2][2] + m[3][3] + m[4][4] + m[5][5] AS t FROM cov)
    SELECT cast(1 as int) AS Component, n AS "Rows", round(val / t, 6) AS Explained_Variance, true AS Orthonormal, true AS Uncorrelated FROM p_end, tr
    UNION ALL SELECT cast(2 as int), n, round(val / t, 6), true, true FROM q_end, tr)""")

_KEPT = ["YEAR", "LOTS_NUMBER", "B_EU_FUNDS", "DURATION", "B_RECURRENT_PROCUREMENT", "ESTIMATED_VALUE_EUR", "IS_FRAMEWORK", "COOPERATIVE_PURCHASING",
         "NUTS_REGION_COUNT", "NUTS_LEVEL", "PREPARATION_DAYS", "ID_NOTICE", "ID_TYPE", "ISO_COUNTRY_CODE", "CAE_TYPE", "MAIN_ACTIVITY", "CPV", "TOP_TYPE",
         "CRIT_CODE", "TYPE_OF_CONTRACT"]
ORACLE["split_projection"] = _wrap(" UNION ALL ".join(
    f"SELECT '{side}' AS Side, '{c}' AS \"Column\", count(\"{c}\") AS \"Values\" FROM {_CT} WHERE _is_test = {k}"
    for k, side in enumerate(("train", "test")) for c in _KEPT) + "".join(
    f" UNION ALL SELECT '{side}', 'TARGET_MARKET_FAILURE', count(*) FROM {_CT} WHERE _is_test = {k}" for k, side in enumerate(("train", "test"))))

# points with 30 neighbours within 0.5 are core; noise is no core and has no core within 0.5
_CLGI = "(SELECT ID_NOTICE, " + ", ".join(f"ln(1 + coalesce(cast({c} as double), med_{c})) AS lg{i}" for i, c in enumerate(CLU)) + f" FROM {_FIRST}, {_CMED})"
_CXI = "(SELECT ID_NOTICE, " + ", ".join(f"(lg{i} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1.0 END AS x{i}" for i in range(5)) + f" FROM {_CLGI}, {_CST})"
_NEAR = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(5)) + " <= 0.25"
ORACLE["dbscan_noise"] = _wrap(f"""SELECT * FROM (WITH p AS MATERIALIZED (SELECT * FROM {_CXI}),
    core AS MATERIALIZED (SELECT a.* FROM p a JOIN (SELECT a.ID_NOTICE FROM p a, p b WHERE {_NEAR} GROUP BY a.ID_NOTICE HAVING count(*) >= 30) c USING (ID_NOTICE)),
    near AS (SELECT DISTINCT a.ID_NOTICE FROM p a, core b WHERE {_NEAR})
    SELECT p.ID_NOTICE, near.ID_NOTICE IS NULL AS Noise FROM p LEFT JOIN near USING (ID_NOTICE))""")
