"""DuckDB/ANSI SQL oracles for the fitted feature pipeline (E5 and parts).

Each statement fits on the whole view and transforms the whole view, like
``FeaturePipeline(...).fit(v).transform(v)``.
"""

from cohort.plans.views import PASSENGER_VIEW_SQL

TITLE_CASE = """CASE nullif(regexp_extract(name, ' ([A-Za-z]+)\\.', 1), '')
  WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3
  WHEN 'HOUSEHOLD' THEN 3 END"""

AREA_CASE = """coalesce(CASE coalesce(substr(cabin, 1, 1), 'U')
  WHEN 'A' THEN 'Top_Deck' WHEN 'B' THEN 'Top_Deck' WHEN 'C' THEN 'Middle_Deck'
  WHEN 'D' THEN 'Middle_Deck' WHEN 'E' THEN 'Lower_Deck' WHEN 'F' THEN 'Lower_Deck'
  WHEN 'G' THEN 'Lower_Deck' WHEN 'T' THEN 'Staff' WHEN 'U' THEN 'Unknown' END, 'Unknown')"""

PREFIX_EXPR = """CASE WHEN length(p0) < 2 AND p0 NOT IN ('C', 'S', 'P') THEN 'OTHER' ELSE p0 END"""
P0_EXPR = """CASE WHEN regexp_matches(coalesce(ticket, 'nan'), '^[0-9]+$') THEN 'NONE'
  ELSE upper(split_part(trim(translate(coalesce(ticket, 'nan'), './', '')), ' ', 1)) END"""

# Imputed view: modes (tie -> smallest) and exact medians of the whole view.
IMPUTED_CTES = f"""
v AS ({PASSENGER_VIEW_SQL}),
m AS (SELECT
  (SELECT embarked FROM v WHERE embarked IS NOT NULL GROUP BY embarked ORDER BY count(*) DESC, embarked LIMIT 1) AS mode_emb,
  (SELECT cabin FROM v WHERE cabin IS NOT NULL GROUP BY cabin ORDER BY count(*) DESC, cabin LIMIT 1) AS mode_cabin,
  (SELECT quantile_cont(age, 0.5) FROM v) AS med_age,
  (SELECT quantile_cont(fare, 0.5) FROM v) AS med_fare),
i AS (SELECT v.id, v.label, v.pclass, v.name, v.sex, v.sibsp, v.parch, v.ticket,
        coalesce(v.embarked, m.mode_emb) AS embarked, coalesce(v.cabin, m.mode_cabin) AS cabin,
        coalesce(v.age, m.med_age) AS age, coalesce(v.fare, m.med_fare) AS fare
      FROM v, m)"""

FEATURE_MATRIX_SQL = f"""
WITH {IMPUTED_CTES},
d AS (SELECT i.*, sibsp + parch + 1 AS fs, {P0_EXPR} AS p0, {AREA_CASE} AS area,
        TRY_CAST(nullif(regexp_extract(cabin, '([0-9]+)', 1), '') AS DOUBLE) AS cnum,
        CASE WHEN ticket IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY ticket) END AS tfreq,
        {TITLE_CASE} AS title
      FROM i),
d2 AS (SELECT d.*, {PREFIX_EXPR} AS prefix FROM d),
pc AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (
        SELECT prefix AS value FROM d2 GROUP BY prefix HAVING count(*) >= 10
        UNION SELECT 'OTHER')),
ac AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (
        SELECT DISTINCT area AS value FROM d2 UNION SELECT 'Unknown')),
ec AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (
        SELECT DISTINCT embarked AS value FROM d2 WHERE embarked IS NOT NULL)),
st AS (SELECT quantile_cont(cnum, 0.5) AS med_cnum,
         list_sort(list_distinct(quantile_cont(fare, [0, 0.25, 0.5, 0.75, 1]))) AS edges
       FROM d2),
e AS (SELECT d2.*,
        coalesce(pcx.code, (SELECT code FROM pc WHERE value = 'OTHER')) AS prefix_code,
        coalesce(acx.code, (SELECT code FROM ac WHERE value = 'Unknown')) AS area_code,
        ecx.code AS emb_code,
        coalesce(cnum, st.med_cnum, 0.0) AS cabin_number,
        CASE WHEN len(st.edges) >= 2 AND fare IS NOT NULL
             THEN greatest(len(list_filter(st.edges, lambda x: x < d2.fare)) - 1, 0) END AS fare_group,
        CASE WHEN fs > 1 THEN 0 ELSE 1 END AS alone,
        CASE WHEN sex = 'female' THEN 0 WHEN sex = 'male' THEN 1 END AS sexc,
        CASE WHEN age >= 0 AND age < 12 THEN 0 WHEN age >= 12 AND age < 20 THEN 1
             WHEN age >= 20 AND age < 40 THEN 2 WHEN age >= 40 AND age < 60 THEN 3
             WHEN age >= 60 AND age < 100 THEN 4 END AS age_band
      FROM d2 CROSS JOIN st
      LEFT JOIN pc pcx ON pcx.value = d2.prefix
      LEFT JOIN ac acx ON acx.value = d2.area
      LEFT JOIN ec ecx ON ecx.value = d2.embarked)
SELECT id, label,
  CAST(pclass AS DOUBLE) AS pclass, CAST(sibsp AS DOUBLE) AS sibsp, CAST(parch AS DOUBLE) AS parch,
  CAST(fs AS DOUBLE) AS family_size, CAST(alone AS DOUBLE) AS is_alone,
  CAST(CASE WHEN fs > 0 AND fs <= 1 THEN 0 WHEN fs > 1 AND fs <= 4 THEN 1 WHEN fs > 4 THEN 2 END AS DOUBLE) AS family_type,
  CAST(CASE WHEN age <= 16 THEN 0 WHEN age <= 32 THEN 1 WHEN age <= 48 THEN 2
            WHEN age <= 64 THEN 3 WHEN age > 64 THEN 4 END AS DOUBLE) AS age_group,
  age * pclass AS age_x_class,
  CAST(fare_group AS DOUBLE) AS fare_group,
  fare * pclass AS fare_x_class,
  CAST(tfreq AS DOUBLE) AS ticket_frequency, CAST(prefix_code AS DOUBLE) AS ticket_prefix_code,
  CAST(CASE WHEN cabin IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS has_cabin,
  CAST(area_code AS DOUBLE) AS cabin_location_code, cabin_number,
  CAST(sexc AS DOUBLE) AS sex_code, CAST(emb_code AS DOUBLE) AS embarked_code,
  CAST(title AS DOUBLE) AS title_code,
  age, fare, age * age AS age_sq, age * fare AS age_fare, fare * fare AS fare_sq,
  coalesce(CAST(sexc AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS sex_x_class,
  coalesce(CAST(age_band AS DOUBLE), 0) * coalesce(CAST(sexc AS DOUBLE), 0) AS age_band_x_sex,
  coalesce(CAST(emb_code AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS embarked_x_class,
  coalesce(CAST(fs AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS family_x_class,
  coalesce(fare, 0) * coalesce(CAST(area_code AS DOUBLE), 0) AS fare_x_cabin_location_code,
  coalesce(age, 0) * coalesce(CAST(fs AS DOUBLE), 0) AS age_x_family_size,
  coalesce((CASE WHEN coalesce(fare, 0) = 0 THEN 1e-6 ELSE coalesce(fare, 0) END)
           / (CASE WHEN coalesce(CAST(fs AS DOUBLE), 1) = 0 THEN 1.0 ELSE coalesce(CAST(fs AS DOUBLE), 1) END), 0)
    * coalesce(CAST(pclass AS DOUBLE), 0) AS fare_per_person_x_class,
  coalesce(CAST(area_code AS DOUBLE), 0) * coalesce(CAST(age_band AS DOUBLE), 0) AS cabin_location_code_x_age_band,
  coalesce(CAST(title AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS title_code_x_class,
  CAST(CASE WHEN alone = 1 AND coalesce(age, 0) > 30 THEN 1 ELSE 0 END AS DOUBLE) AS loneliness_score,
  coalesce(CAST(tfreq AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS ticket_frequency_x_class,
  coalesce(CAST(prefix_code AS DOUBLE), 0) * coalesce(CAST(pclass AS DOUBLE), 0) AS ticket_prefix_code_x_class,
  coalesce(fare * fare, 0) * coalesce(CAST(sexc AS DOUBLE), 0) AS fare_sq_x_sex_code,
  coalesce(age * fare, 0) * coalesce(CAST(sexc AS DOUBLE), 0) AS age_fare_x_sex_code
FROM e
"""
