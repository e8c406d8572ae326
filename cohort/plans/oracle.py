"""Oracle SQL per registered key (DuckDB dialect; the driver tables are
pre-registered views). Aggregated doubles are rounded to 6 places on both
sides; exact row-level arithmetic is compared unrounded."""

from cohort.plans.oracle_features import (AREA_CASE, FEATURE_MATRIX_SQL, P0_EXPR,
                                          PREFIX_EXPR)
from cohort.plans.oracle_profile import ORACLE_PROFILE
from cohort.plans.views import PASSENGER_VIEW_SQL

V = f"({PASSENGER_VIEW_SQL}) v"
TITLE = "nullif(regexp_extract({c}, ' ([A-Za-z]+)\\.', 1), '')"
FM = f"({FEATURE_MATRIX_SQL}) fm"
FS = "(sibsp + parch + 1)"
LI_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
           "l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate")
LI_ORDER = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
            "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

ORACLE: dict = {
    "feature_matrix": FEATURE_MATRIX_SQL,
    "csv_scan": f"SELECT * FROM {V}",
    "csv_infer": "SELECT name, type, missing::BIGINT AS missing, round(total, 2) AS total FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {t.format(c=c)} AS type, count(*) FILTER ({c} IS NULL) AS missing, {x.format(c=c)} AS total FROM {V}"
        for cols, t, x in (
            ("id label pclass sibsp parch", "CASE WHEN count({c}) < count(*) THEN 'double' ELSE 'bigint' END",
             "sum({c}::DOUBLE)"),
            ("age fare", "'double'", "sum({c})"),
            ("name sex ticket cabin embarked", "'string'", "CAST(NULL AS DOUBLE)"))
        for c in cols.split()) + ")",
    "generate_ids": f"SELECT {LI_COLS}, row_number() OVER (ORDER BY {LI_ORDER}) AS row_id FROM lineitem",
    "submission_sink": f"SELECT id, CAST(CASE WHEN pclass <= 2 THEN 1 ELSE 0 END AS INT) AS survived FROM {V}",
    "align_columns": "SELECT c_custkey, c_acctbal, 0 AS c_phone, c_nationkey FROM customer",
    "filter_isin_range": f"SELECT * FROM {V} WHERE sex IN ('female') AND pclass IN (1, 2) AND age BETWEEN 20 AND 40",
    "preview_top5": f"SELECT * FROM {V} ORDER BY id LIMIT 5",
    "table_shape": f"SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_cols FROM {V}",
    "pairs_complete_cases": f"""SELECT id, label, pclass, age, sibsp, parch, fare FROM {V}
        WHERE label IS NOT NULL AND pclass IS NOT NULL AND age IS NOT NULL AND sibsp IS NOT NULL
          AND parch IS NOT NULL AND fare IS NOT NULL""",
    "family_features": f"""SELECT id, {FS} AS family_size,
        CASE WHEN {FS} > 1 THEN 0 ELSE 1 END AS is_alone,
        CASE WHEN {FS} > 0 AND {FS} <= 1 THEN 0 WHEN {FS} > 1 AND {FS} <= 4 THEN 1
             WHEN {FS} > 4 THEN 2 END AS family_type FROM {V}""",
    "missing_column_defaults": f"""SELECT id, CAST(1 AS DOUBLE) AS title_code, CAST(0.5 AS DOUBLE) AS sex_code,
        CAST(0 AS DOUBLE) AS embarked_code, CAST(1 AS DOUBLE) AS ticket_frequency,
        CAST(0 AS DOUBLE) AS ticket_prefix_code, CAST(0 AS DOUBLE) AS has_cabin,
        CAST(0 AS DOUBLE) AS cabin_location_code, CAST(0 AS DOUBLE) AS cabin_number FROM {V}""",
    "transform_absent_columns": f"""SELECT id, f.age, f.fare, f.age * f.age AS age_sq, f.age * f.fare AS age_fare,
        f.fare * f.fare AS fare_sq, f.cabin_number, CAST(0 AS DOUBLE) AS has_cabin,
        f.fare * f.code AS fare_x_cabin_location_code, f.band * coalesce(sexc, 0) AS age_band_x_sex,
        f.age * fs AS age_x_family_size, f.fare / fs * pclass AS fare_per_person_x_class,
        CAST(CASE WHEN fs = 1 AND f.age > 30 THEN 1 ELSE 0 END AS DOUBLE) AS loneliness_score,
        f.fare * f.fare * coalesce(sexc, 0) AS fare_sq_x_sex_code,
        f.age * f.fare * coalesce(sexc, 0) AS age_fare_x_sex_code
        FROM (SELECT id, {FS} AS fs, pclass, CASE WHEN sex = 'female' THEN 0.0::DOUBLE WHEN sex = 'male' THEN 1.0::DOUBLE END AS sexc
              FROM {V}),
          (SELECT m.*, CAST(CASE WHEN age < 12 THEN 0 WHEN age < 20 THEN 1 WHEN age < 40 THEN 2
                       WHEN age < 60 THEN 3 ELSE 4 END AS DOUBLE) AS band,
             CAST((SELECT count(DISTINCT area) FROM (SELECT {AREA_CASE} AS area FROM {V})
                   WHERE area < 'Unknown') AS DOUBLE) AS code
           FROM (SELECT quantile_cont(age, 0.5) AS age, quantile_cont(fare, 0.5) AS fare,
             coalesce(quantile_cont(TRY_CAST(nullif(regexp_extract(coalesce(cabin, (
               SELECT cabin FROM {V} WHERE cabin IS NOT NULL GROUP BY cabin ORDER BY count(*) DESC, cabin LIMIT 1)),
               '([0-9]+)', 1), '') AS DOUBLE), 0.5), 0.0) AS cabin_number FROM {V}) m) f""",
    "missing_rows": "SELECT id, " + ", ".join(
        f"CAST({c} IS NULL AS INT) AS {c}" for c in ("label", "pclass", "name", "sex", "age", "sibsp",
        "parch", "ticket", "fare", "cabin", "embarked")) + f" FROM {V}",
    "box_outliers": """WITH q AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.25) AS q1,
          quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
        SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice
        FROM lineitem JOIN q USING (l_linenumber)
        WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)""",
    "sample_n": f"""SELECT id, label, pclass, age, sibsp, parch, fare FROM {V}
        WHERE label IS NOT NULL AND pclass IS NOT NULL AND age IS NOT NULL AND sibsp IS NOT NULL
          AND parch IS NOT NULL AND fare IS NOT NULL
        ORDER BY ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT, id LIMIT 200""",
    "hash_folds": f"""SELECT id, label,
        CAST(('0x' || substr(md5('42:' || id), 1, 8))::BIGINT % 5 AS INT) AS fold FROM {V}""",
    "poly_features": f"SELECT id, age, fare, age_sq, age_fare, fare_sq FROM {FM}",
    "interaction_features": f"""SELECT id, age_x_class, fare_x_class, sex_x_class, age_band_x_sex,
        embarked_x_class, family_x_class, fare_x_cabin_location_code, age_x_family_size,
        fare_per_person_x_class, cabin_location_code_x_age_band, title_code_x_class,
        loneliness_score, ticket_frequency_x_class, ticket_prefix_code_x_class,
        fare_sq_x_sex_code, age_fare_x_sex_code FROM {FM}""",
    "map_recode": f"""SELECT id, {TITLE.format(c='name')} AS title,
        CASE {TITLE.format(c='name')} WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2
          WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 3 END AS title_code,
        CASE sex WHEN 'female' THEN 0 WHEN 'male' THEN 1 END AS sex_code FROM {V}""",
    "title_extract": f"SELECT doc_id, {TITLE.format(c='text')} AS title FROM documents",
    "title_grouped": f"""SELECT id, CASE WHEN {TITLE.format(c='name')} IN ('BUILDING', 'AUTOMOBILE',
        'MACHINERY', 'HOUSEHOLD') THEN {TITLE.format(c='name')} ELSE 'Other' END AS title_grouped FROM {V}""",
    "ticket_prefix": f"""SELECT id, ticket, {PREFIX_EXPR} AS prefix
        FROM (SELECT id, ticket, {P0_EXPR} AS p0 FROM {V})""",
    "cabin_features": f"""WITH c AS (SELECT id, cabin,
          TRY_CAST(nullif(regexp_extract(cabin, '([0-9]+)', 1), '') AS DOUBLE) AS num FROM {V})
        SELECT id, CASE WHEN cabin IS NOT NULL THEN 1 ELSE 0 END AS has_cabin,
          coalesce(substr(cabin, 1, 1), 'U') AS cabin_letter, {AREA_CASE} AS cabin_area,
          coalesce(num, (SELECT quantile_cont(num, 0.5) FROM c), 0.0) AS cabin_number FROM c""",
    "numeric_coerce": f"SELECT id, coalesce(TRY_CAST(ticket AS DOUBLE), 0.0) AS ticket_number FROM {V}",
    "text_null_marker": f"""SELECT id, CASE WHEN upper(trim(coalesce(cabin, 'nan'))) = 'NAN' THEN NULL
        ELSE coalesce(cabin, 'nan') END AS cabin FROM {V}""",
    "bin_fixed_right": f"""SELECT id,
        CASE WHEN age <= 16 THEN 0 WHEN age <= 32 THEN 1 WHEN age <= 48 THEN 2
             WHEN age <= 64 THEN 3 WHEN age > 64 THEN 4 END AS age_group,
        CASE WHEN {FS} > 0 AND {FS} <= 1 THEN 0 WHEN {FS} > 1 AND {FS} <= 4 THEN 1
             WHEN {FS} > 4 THEN 2 END AS family_type FROM {V}""",
    "bin_fixed_left": f"""SELECT id, CASE WHEN age >= 0 AND age < 12 THEN 0 WHEN age >= 12 AND age < 20 THEN 1
        WHEN age >= 20 AND age < 40 THEN 2 WHEN age >= 40 AND age < 60 THEN 3
        WHEN age >= 60 AND age < 100 THEN 4 END AS age_band FROM {V}""",
    "bin_quantile": f"""WITH f AS (SELECT id, coalesce(fare, (SELECT quantile_cont(fare, 0.5) FROM {V})) AS fare FROM {V}),
        e AS (SELECT list_sort(list_distinct(quantile_cont(fare, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM f)
        SELECT id, CAST(CASE WHEN len(edges) >= 2 AND fare IS NOT NULL
          THEN greatest(len(list_filter(edges, lambda x: x < f.fare)) - 1, 0) END AS INT) AS fare_group
        FROM f, e""",
    "impute_mode": f"""SELECT id,
        coalesce(embarked, (SELECT embarked FROM {V} WHERE embarked IS NOT NULL GROUP BY embarked
                            ORDER BY count(*) DESC, embarked LIMIT 1)) AS embarked,
        coalesce(cabin, (SELECT cabin FROM {V} WHERE cabin IS NOT NULL GROUP BY cabin
                         ORDER BY count(*) DESC, cabin LIMIT 1)) AS cabin FROM {V}""",
    "impute_median": f"""SELECT id, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM {V})) AS age,
        coalesce(fare, (SELECT quantile_cont(fare, 0.5) FROM {V})) AS fare FROM {V}""",
    "impute_mean": f"""SELECT id, round(coalesce(age, (SELECT avg(age) FROM {V})), 6) AS age,
        round(coalesce(fare, (SELECT avg(fare) FROM {V})), 6) AS fare FROM {V}""",
    "impute_transform_fitted": f"""SELECT id, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM {V})) AS age,
        coalesce(embarked, (SELECT embarked FROM {V} WHERE embarked IS NOT NULL GROUP BY embarked
                            ORDER BY count(*) DESC, embarked LIMIT 1)) AS embarked FROM {V}""",
    "fill_by_type": f"""WITH t AS (SELECT id, CASE WHEN age >= 0 AND age < 12 THEN '0-12'
          WHEN age >= 12 AND age < 20 THEN '13-20' WHEN age >= 20 AND age < 30 THEN '21-30'
          WHEN age >= 30 AND age < 40 THEN '31-40' WHEN age >= 40 AND age < 50 THEN '41-50'
          WHEN age >= 50 AND age < 60 THEN '51-60' WHEN age >= 60 AND age < 100 THEN '60+' END AS age_band,
          fare FROM {V})
        SELECT id, coalesce(age_band, (SELECT age_band FROM t WHERE age_band IS NOT NULL GROUP BY age_band
                                       ORDER BY count(*) DESC, age_band LIMIT 1)) AS age_band,
          coalesce(fare, (SELECT quantile_cont(fare, 0.5) FROM t)) AS fare FROM t""",
    "missing_profile": f"""SELECT column_name AS "column", n_missing,
        round(n_missing * 100.0 / n, 6) AS pct_missing FROM (
          SELECT count(*) AS n,
            count(*) - count(id) AS id, count(*) - count(label) AS label,
            count(*) - count(pclass) AS pclass, count(*) - count(name) AS name,
            count(*) - count(sex) AS sex, count(*) - count(age) AS age,
            count(*) - count(sibsp) AS sibsp, count(*) - count(parch) AS parch,
            count(*) - count(ticket) AS ticket, count(*) - count(fare) AS fare,
            count(*) - count(cabin) AS cabin, count(*) - count(embarked) AS embarked FROM {V})
        UNPIVOT (n_missing FOR column_name IN (id, label, pclass, name, sex, age, sibsp, parch,
                                               ticket, fare, cabin, embarked))""",
    "label_encode": """SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS lang_code
        FROM documents""",
    "encode_unknown_fallback": f"""WITH tr AS (SELECT {TITLE.format(c='text')} AS t FROM documents
          WHERE doc_id IN (SELECT doc_id FROM labels)),
        cl AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (
          SELECT t AS value FROM tr WHERE t IS NOT NULL GROUP BY t HAVING count(*) >= 10
          UNION SELECT 'OTHER'))
        SELECT doc_id, d.title, coalesce(cl.code, (SELECT code FROM cl WHERE value = 'OTHER')) AS title_code
        FROM (SELECT doc_id, {TITLE.format(c='text')} AS title FROM documents) d
        LEFT JOIN cl ON cl.value = d.title""",
    "rare_group": f"""SELECT title, count(*) AS n, CAST(count(*) < 10 AS INT) AS is_rare,
        CASE WHEN count(*) < 10 THEN 'OTHER' ELSE title END AS grouped
        FROM (SELECT {TITLE.format(c='text')} AS title FROM documents) WHERE title IS NOT NULL GROUP BY title""",
    "standard_scale": """SELECT l_orderkey, l_linenumber,
        round((l_quantity - a_q) / s_q, 6) AS l_quantity, round((l_extendedprice - a_e) / s_e, 6) AS l_extendedprice,
        round((l_discount - a_d) / s_d, 6) AS l_discount, round((l_tax - a_t) / s_t, 6) AS l_tax
        FROM lineitem, (SELECT avg(l_quantity) a_q, stddev_pop(l_quantity) s_q, avg(l_extendedprice) a_e,
          stddev_pop(l_extendedprice) s_e, avg(l_discount) a_d, stddev_pop(l_discount) s_d,
          avg(l_tax) a_t, stddev_pop(l_tax) s_t FROM lineitem)""",
    "group_frequency": f"""SELECT id, ticket, CASE WHEN ticket IS NULL THEN NULL
        ELSE count(*) OVER (PARTITION BY ticket) END AS ticket_frequency FROM {V}""",
    "dedupe_ordered": "SELECT lang, min(doc_id) AS first_pos FROM documents WHERE lang IS NOT NULL GROUP BY lang",
}
ORACLE.update(ORACLE_PROFILE)
ORACLE["clf_knn_exact"] = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS tl,
          list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
        FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  r AS (SELECT q, tl, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rn FROM d),
  votes AS (SELECT q, tl, count(*) AS c FROM r WHERE rn <= 5 GROUP BY q, tl),
  best AS (SELECT q, first(tl ORDER BY c DESC, tl ASC) AS prediction FROM votes GROUP BY q)
  SELECT e.vec_id, e.label, CAST(best.prediction AS INT) AS prediction FROM e JOIN best ON e.vec_id = best.q"""


_KNN_CTES = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v,
    CAST(('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT % 3 AS INT) AS own FROM embeddings),
  f AS (SELECT unnest([0, 1, 2]) AS fold),
  d AS (SELECT a.id AS q, b.id AS t, a.own AS q_own, b.own AS t_own, a.label AS y, b.label AS tl,
          list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
        FROM e a JOIN e b ON true),
  r AS (SELECT fold, CASE WHEN q_own = fold THEN 'validation' ELSE 'train' END AS part, q, y, tl,
          row_number() OVER (PARTITION BY fold, q ORDER BY d2, t) AS rn
        FROM d JOIN f ON t_own <> fold),
  p AS (SELECT k, fold, part, q, y, first(tl ORDER BY c DESC, tl) AS p FROM (
          SELECT k, fold, part, q, y, tl, count(*) AS c FROM r, (VALUES (3), (5), (7)) g(k)
          WHERE rn <= k GROUP BY ALL) GROUP BY k, fold, part, q, y),
  cl AS (SELECT k, fold, part, c, sum(a) AS actual, sum(b) AS predicted, sum(tp) AS tp FROM (
          SELECT k, fold, part, y AS c, 1 AS a, 0 AS b, CAST(y = p AS INT) AS tp FROM p
          UNION ALL SELECT k, fold, part, p, 0, 1, 0 FROM p) GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
          CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS rec FROM cl),
  m AS (SELECT k, fold, part, sum(tp) / sum(actual) AS accuracy, avg(prec) AS prec, avg(rec) AS rec,
          avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END) AS f1
        FROM pr GROUP BY ALL),
  cv AS (SELECT 'knn' AS model, CAST((k - 3) / 2 AS INT) AS candidate,
          '{''n_neighbors'': ' || k || ', ''weights'': ''uniform''}' AS params, avg(f1) AS f1_macro,
          avg(accuracy) AS accuracy, avg(prec) AS precision_macro, avg(rec) AS recall_macro
        FROM m WHERE part = 'validation' GROUP BY k)"""
ORACLE["knn_grid_search"] = f"""WITH {_KNN_CTES} SELECT model, candidate, params,
  round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy,
  round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro FROM cv"""
ORACLE["knn_train_selected"] = f"""WITH {_KNN_CTES} SELECT model, candidate, params FROM cv
  ORDER BY round(f1_macro, 12) DESC, candidate LIMIT 1"""
ORACLE["knn_validation_curve"] = f"""WITH {_KNN_CTES} SELECT CAST(k AS DOUBLE) AS param_value,
  round(avg(f1) FILTER (WHERE part = 'train'), 6) AS train_mean,
  round(stddev_pop(f1) FILTER (WHERE part = 'train'), 6) AS train_std,
  round(avg(f1) FILTER (WHERE part = 'validation'), 6) AS validation_mean,
  round(stddev_pop(f1) FILTER (WHERE part = 'validation'), 6) AS validation_std FROM m GROUP BY k"""


def _unsigned_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + CAST(0 AS DOUBLE))``.
    DuckDB rounds a tiny negative to -0.0, Spark's decimal rounding gives
    +0.0; adding +0.0 turns -0.0 into +0.0 and changes nothing else."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _unsigned_zero(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        i = k + 1


ORACLE = {k: _unsigned_zero(v) for k, v in ORACLE.items()}
