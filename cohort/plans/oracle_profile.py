"""Oracle SQL for aggregates, profiles and metrics (DuckDB dialect)."""

from cohort.functions.binning import AGE_BAND7_LABELS, FAMILY_TYPE_LABELS, FARE_QUINTILE_LABELS
from cohort.operators.pipeline import FEATURE_NAMES
from cohort.plans.oracle_features import FEATURE_MATRIX_SQL
from cohort.plans.views import PASSENGER_VIEW_SQL

V = f"({PASSENGER_VIEW_SQL}) v"
TITLE = "nullif(regexp_extract({c}, ' ([A-Za-z]+)\\.', 1), '')"
LBL = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
RULE_SQL = {
    "quantity": "l_quantity / 50.0",
    "discount": "l_discount * 10.0",
    "tax": "l_tax * 12.5",
    "price": "l_extendedprice / 105000.0",
    "line": "(l_linenumber - 1) / 6.0",
}
LONG = "(" + " UNION ALL ".join(
    f"SELECT l_orderkey, {LBL} AS label, '{m}' AS model, CAST({e} AS DOUBLE) AS score, "
    f"CAST(({e}) > 0.5 AS INT) AS prediction FROM lineitem" for m, e in RULE_SQL.items()) + ") l"


def _values(labels):
    return "(VALUES " + ", ".join(f"('{x}')" for x in labels) + ") c(key)"


def _first_of(cats):
    """Tie order of a mode: the category order if there is one, else the text."""
    return "key" if cats is None else \
        "list_position([" + ", ".join(f"'{x}'" for x in cats) + "], key)"


def _mode_filled_rates(key_sql, src, cats=None):
    base = f"""WITH t AS (SELECT {key_sql} AS key, label FROM {src}),
      f AS (SELECT coalesce(key, (SELECT key FROM t WHERE key IS NOT NULL GROUP BY key
                                  ORDER BY count(*) DESC, {_first_of(cats)} LIMIT 1), 'Unknown') AS key, label FROM t),
      r AS (SELECT key, avg(label) AS rate FROM f GROUP BY key)"""
    if cats is None:
        return base + " SELECT key, round(rate, 6) AS rate FROM r"
    return base + f" SELECT c.key, round(r.rate, 6) AS rate FROM {_values(cats)} LEFT JOIN r USING (key)"


AGE7 = ("CASE WHEN age >= 0 AND age < 12 THEN '0-12' WHEN age >= 12 AND age < 20 THEN '13-20' "
        "WHEN age >= 20 AND age < 30 THEN '21-30' WHEN age >= 30 AND age < 40 THEN '31-40' "
        "WHEN age >= 40 AND age < 50 THEN '41-50' WHEN age >= 50 AND age < 60 THEN '51-60' "
        "WHEN age >= 60 AND age < 100 THEN '60+' END")
FS = "(sibsp + parch + 1)"
FT = (f"CASE WHEN {FS} > 0 AND {FS} <= 1 THEN '{FAMILY_TYPE_LABELS[0]}' "
      f"WHEN {FS} > 1 AND {FS} <= 4 THEN '{FAMILY_TYPE_LABELS[1]}' "
      f"WHEN {FS} > 4 THEN '{FAMILY_TYPE_LABELS[2]}' END")
QL = "[" + ", ".join(f"'{x}'" for x in FARE_QUINTILE_LABELS) + "]"

FARE_QUINTILE_SQL = f"""WITH f AS (SELECT coalesce(fare, (SELECT quantile_cont(fare, 0.5) FROM {V})) AS fare, label FROM {V}),
  e AS (SELECT list_sort(list_distinct(quantile_cont(fare, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM f),
  t AS (SELECT CASE WHEN len(edges) = 6 AND fare IS NOT NULL
          THEN {QL}[greatest(len(list_filter(edges, lambda x: x < f.fare)) - 1, 0) + 1] END AS key, label FROM f, e),
  fl AS (SELECT coalesce(key, (SELECT key FROM t WHERE key IS NOT NULL GROUP BY key
                              ORDER BY count(*) DESC, list_position({QL}, key) LIMIT 1), 'Unknown') AS key, label FROM t),
  r AS (SELECT key, avg(label) AS rate FROM fl GROUP BY key)
  SELECT c.key, round(r.rate, 6) AS rate FROM {_values(FARE_QUINTILE_LABELS)} LEFT JOIN r USING (key)"""

VIEW_COLS = [("id", True), ("label", True), ("pclass", True), ("name", False), ("sex", False),
             ("age", True), ("sibsp", True), ("parch", True), ("ticket", False), ("fare", True),
             ("cabin", False), ("embarked", False)]
DESCRIBE_SQL = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS s, "
    f"{'CAST(' + c + ' AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS x, {str(num).upper()} AS isnum FROM {V}"
    for c, num in VIEW_COLS) + f"""),
  cols AS (SELECT DISTINCT col, isnum FROM long),
  vc AS (SELECT col, s, count(*) AS n FROM long WHERE s IS NOT NULL GROUP BY col, s),
  cat AS (SELECT col, sum(n) AS cnt, count(*) AS uniq, first(s ORDER BY n DESC, s ASC) AS top, max(n) AS freq
          FROM vc GROUP BY col),
  num AS (SELECT col, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mn, quantile_cont(x, 0.25) AS q25,
            quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS mx
          FROM long WHERE x IS NOT NULL GROUP BY col)
  SELECT cols.col AS "column", CAST(coalesce(cat.cnt, 0) AS BIGINT) AS "count",
    CAST(CASE WHEN NOT isnum THEN uniq END AS BIGINT) AS "unique",
    CASE WHEN NOT isnum THEN top END AS top, CAST(CASE WHEN NOT isnum THEN freq END AS BIGINT) AS freq,
    round(mean, 6) AS mean, round(std, 6) AS std, round(mn, 6) AS "min", round(q25, 6) AS q25,
    round(q50, 6) AS q50, round(q75, 6) AS q75, round(mx, 6) AS "max"
  FROM cols LEFT JOIN cat USING (col) LEFT JOIN num USING (col)"""


def _corr_sql(cols, src):
    def c(x):
        return f"CAST({x} AS DOUBLE)"
    aggs, sels = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            both = f"{c(a)} IS NOT NULL AND {c(b)} IS NOT NULL"
            aggs.append(f"covar_pop({c(a)}, {c(b)}) / nullif(stddev_pop(CASE WHEN {both} THEN {c(a)} END)"
                        f" * stddev_pop(CASE WHEN {both} THEN {c(b)} END), 0) AS c_{i}_{j}")
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            sels.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(c_{min(i, j)}_{max(i, j)}, 6) AS corr FROM agg")
    return f"WITH agg AS (SELECT {', '.join(aggs)} FROM {src}) " + " UNION ALL ".join(sels)


def _kde_sql(groups, cut, common):
    g = ", ".join(groups)
    on = " AND ".join(f"b.{x} = st.{x}" for x in groups)
    norm = "tot.n" if common else "st.cnt"
    return f"""WITH b AS (SELECT l_linenumber, {LBL} AS label, l_quantity AS x FROM lineitem),
      st AS (SELECT {g}, count(*) AS cnt, stddev_samp(x) * pow(count(*), -0.2) AS bw,
               min(x) - {cut} * (stddev_samp(x) * pow(count(*), -0.2)) AS gmin,
               max(x) + {cut} * (stddev_samp(x) * pow(count(*), -0.2)) AS gmax FROM b GROUP BY {g}),
      tot AS (SELECT count(*) AS n FROM b),
      grid AS (SELECT st.*, CAST(i AS INT) AS grid_idx, gmin + i * ((gmax - gmin) / 199) AS gx FROM st, range(200) r(i))
      SELECT {', '.join('grid.' + x for x in groups)}, grid_idx, round(gx, 6) AS x,
        round(sum(exp(-0.5 * ((gx - b.x) / grid.bw) * ((gx - b.x) / grid.bw))) /
              ({norm.replace('st.', 'grid.')} * grid.bw * sqrt(2 * pi())), 10) AS density
      FROM grid JOIN b ON {on.replace('st.', 'grid.')}, tot
      GROUP BY {', '.join('grid.' + x for x in groups)}, grid_idx, gx, grid.bw, {norm.replace('st.', 'grid.')}"""


def _box_sql(x, groups):
    g = ", ".join(groups)
    inside = "x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)"
    return f"""WITH b AS (SELECT l_linenumber, {LBL} AS label, {x} AS x FROM lineitem),
      q AS (SELECT {g}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
              quantile_cont(x, 0.75) AS q3 FROM b GROUP BY {g})
      SELECT {', '.join('q.' + c for c in groups)}, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
        round(min(CASE WHEN {inside} THEN x END), 6) AS whisker_lo,
        round(max(CASE WHEN {inside} THEN x END), 6) AS whisker_hi,
        CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers, count(*) AS n
      FROM b JOIN q USING ({g}) GROUP BY {', '.join('q.' + c for c in groups)}, q1, med, q3"""


VIOLIN_SQL = f"""WITH k AS ({_kde_sql(['l_linenumber', 'label'], 2.0, False)}),
  bx AS (SELECT l_linenumber, {LBL} AS label, quantile_cont(l_quantity, 0.25) AS q1,
           quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) AS q3
         FROM lineitem GROUP BY 1, 2)
  SELECT k.*, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3
  FROM k JOIN bx USING (l_linenumber, label)"""

LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORACLE_PROFILE = {
    "rate_by_key": f"""SELECT key_name, key_value, round(avg(y) * 100, 6) AS rate, count(*) AS n FROM (
        SELECT 'l_linestatus' AS key_name, CAST(l_linestatus AS VARCHAR) AS key_value, CAST({LBL} AS DOUBLE) AS y FROM lineitem
        UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), CAST({LBL} AS DOUBLE) FROM lineitem)
        WHERE key_value IS NOT NULL GROUP BY key_name, key_value""",
    "rate_by_title": _mode_filled_rates(
        f"CASE WHEN {TITLE.format(c='name')} IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD') "
        f"THEN {TITLE.format(c='name')} ELSE 'Other' END", V),
    "rate_by_age_band": _mode_filled_rates(AGE7, V, AGE_BAND7_LABELS),
    "rate_by_fare_quintile": FARE_QUINTILE_SQL,
    "rate_by_family_type": _mode_filled_rates(FT, V, FAMILY_TYPE_LABELS),
    "rate_pivot": f"SELECT sex, " + ", ".join(
        f"round(coalesce(avg(label) FILTER (WHERE pclass = {i}) * 100, 0), 6) AS class_{i}" for i in range(1, 6))
        + f" FROM {V} GROUP BY sex",
    "category_share": f"""SELECT sex, count(*) AS n,
        round(CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM {V} WHERE sex IS NOT NULL), 6) AS share
        FROM {V} WHERE sex IS NOT NULL GROUP BY sex""",
    "describe_all": DESCRIBE_SQL,
    "corr_matrix": _corr_sql(["id", "label", "pclass", "age", "sibsp", "parch", "fare"], V),
    "corr_matrix_features": _corr_sql(FEATURE_NAMES + ["label"], f"({FEATURE_MATRIX_SQL}) fm"),
    "actual_vs_predicted_by_group": f"""SELECT key_name, key_value, round(avg(y) * 100, 6) AS actual_rate,
        round(avg(p) * 100, 6) AS predicted_rate, count(*) AS n FROM (
        SELECT 'l_linestatus' AS key_name, CAST(l_linestatus AS VARCHAR) AS key_value, CAST({LBL} AS DOUBLE) AS y,
          CAST(l_quantity / 50.0 > 0.5 AS DOUBLE) AS p FROM lineitem
        UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), CAST({LBL} AS DOUBLE),
          CAST(l_quantity / 50.0 > 0.5 AS DOUBLE) FROM lineitem) GROUP BY key_name, key_value""",
    "actual_vs_predicted_overall": f"""SELECT model, round(avg(label) * 100, 6) AS actual_rate,
        round(avg(prediction) * 100, 6) AS predicted_rate, count(*) AS n FROM {LONG} GROUP BY model""",
    "histogram": f"""WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
        b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INT) AS bin,
                CAST({LBL} AS VARCHAR) AS hue FROM lineitem, s)
        SELECT bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi, hue, count(*) AS n
        FROM b, s GROUP BY bin, hue, lo, w""",
    "kde_by_group": _kde_sql(["label"], 3.0, True),
    "box_stats": _box_sql("l_extendedprice", ["l_linenumber", "label"]),
    "violin_stats": VIOLIN_SQL,
    "scatter_points": f"SELECT id, age, fare, label AS hue FROM {V} WHERE age IS NOT NULL AND fare IS NOT NULL",
    "scatter_binned": f"""WITH s AS (SELECT min(l_quantity) x0, (max(l_quantity) - min(l_quantity)) / 50 AS wx,
          min(l_extendedprice) y0, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS wy FROM lineitem)
        SELECT CAST(least(floor((l_quantity - x0) / wx), 49) AS INT) AS bx,
          CAST(least(floor((l_extendedprice - y0) / wy), 49) AS INT) AS "by",
          CAST({LBL} AS VARCHAR) AS hue, count(*) AS n FROM lineitem, s GROUP BY ALL""",
    "mean_abs_rank": "WITH s AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LI4) + " FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs(({c} - m_{c}) / s_{c})), 6) AS importance FROM lineitem, s"
        for c in LI4),
    "classification_metrics": f"""WITH cells AS (SELECT model, label AS y, prediction AS p, count(*) AS n FROM {LONG} GROUP BY ALL),
        cls AS (SELECT DISTINCT model, y AS c FROM cells UNION SELECT DISTINCT model, p FROM cells),
        per AS (SELECT cls.model, cls.c, sum(CASE WHEN y = c AND p = c THEN n ELSE 0 END) AS tp,
                  sum(CASE WHEN y = c THEN n ELSE 0 END) AS actual, sum(CASE WHEN p = c THEN n ELSE 0 END) AS predicted
                FROM cls JOIN cells USING (model) GROUP BY cls.model, cls.c),
        pr AS (SELECT model, tp, actual, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                 CASE WHEN actual > 0 THEN tp / actual ELSE 0.0 END AS rec FROM per)
        SELECT model, round(sum(tp) / sum(actual), 6) AS accuracy, round(avg(prec), 6) AS precision_macro,
          round(avg(rec), 6) AS recall_macro,
          round(avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END), 6) AS f1_macro,
          CAST(sum(actual) AS BIGINT) AS n FROM pr GROUP BY model""",
    "confusion_matrix": f"""WITH cells AS (SELECT model, label, prediction, count(*) AS n FROM {LONG} GROUP BY ALL),
        grid AS (SELECT m.model, CAST(a.v AS INT) AS label, CAST(b.v AS INT) AS prediction
                 FROM (SELECT DISTINCT model FROM cells) m, (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))
        SELECT grid.model, grid.label, grid.prediction, CAST(coalesce(n, 0) AS BIGINT) AS n
        FROM grid LEFT JOIN cells USING (model, label, prediction)""",
    "roc_curve": f"""WITH c AS (SELECT model, score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {LONG} GROUP BY ALL),
        cum AS (SELECT model, threshold,
          sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cp,
          sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cn,
          sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all FROM c)
        SELECT model, round(threshold, 6) AS threshold, round(cn / tn_all, 6) AS fpr, round(cp / tp_all, 6) AS tpr FROM cum""",
    "roc_corners": f"""WITH c AS (SELECT model, score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {LONG} GROUP BY ALL),
        cum AS (SELECT model, threshold, pos, neg,
          sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cp,
          sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cn,
          row_number() OVER (PARTITION BY model ORDER BY threshold DESC) AS i,
          lead(pos) OVER (PARTITION BY model ORDER BY threshold DESC) AS np,
          lead(neg) OVER (PARTITION BY model ORDER BY threshold DESC) AS nn,
          sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all FROM c)
        SELECT model, round(threshold, 6) AS threshold, round(cn / tn_all, 6) AS fpr, round(cp / tp_all, 6) AS tpr
        FROM cum WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg
        UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c""",
    "auc": f"""WITH c AS (SELECT model, score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {LONG} GROUP BY ALL),
        cum AS (SELECT model, pos, neg,
          sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cp FROM c)
        SELECT model, round(sum(neg * (cp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc
        FROM cum GROUP BY model""",
    "stratified_folds": f"""WITH v AS (SELECT id, label FROM {V}),
        cls AS (SELECT label, count(*) AS n, min(id) AS first FROM v GROUP BY label),
        st AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cls),
        b AS (SELECT label, floor((s + n - 1 - 0) / 3.0) - floor((s - 1 - 0) / 3.0) AS c0,
                floor((s + n - 1 - 1) / 3.0) - floor((s - 1 - 1) / 3.0) AS c1 FROM st),
        pos AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS j FROM v)
        SELECT id, label, CAST(CASE WHEN j < c0 THEN 0 WHEN j < c0 + c1 THEN 1 ELSE 2 END AS INT) AS fold
        FROM pos JOIN b USING (label)""",
    "vote_hard": "SELECT l_orderkey, l_linenumber, " + LBL + " AS label, CAST((" + " + ".join(
        f"CAST(({e}) > 0.5 AS INT)" for e in RULE_SQL.values()) + ") * 2 > 5 AS INT) AS vote FROM lineitem",
    "vote_soft": "SELECT l_orderkey, l_linenumber, " + LBL + " AS label, round(p, 6) AS p1, "
        "CAST(p > 0.5 AS INT) AS vote FROM (SELECT l_orderkey, l_linenumber, l_returnflag, (0.0 + " + " + ".join(
        f"least(greatest(CAST({e} AS DOUBLE), 0.0), 1.0)" for e in RULE_SQL.values()) + ") / 5.0 AS p FROM lineitem)",
}
