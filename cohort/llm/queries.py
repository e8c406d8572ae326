"""Registered queries of the text operators and their DuckDB SQL.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.llm import (bpe, exact_dedup, hard_negatives, html_extract, language_crf, line_dedup,
                        merkle, ordinal_quality, packing, pii, quality_rules, simhash, toxicity)
from cohort.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop(
        "char_distance", "word_distance")


_P = quality_rules.Params()
_CLASS_PATTERNS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]",
                   "space": r"[\x20\x09-\x0D]", "symbol": "[#*$%&|<>]",
                   "other": r"[^\x20\x09-\x0Da-zA-Z0-9#*$%&|<>\x80-\x{10FFFF}]",
                   "wide": r"[\x80-\x{10FFFF}]"}
_CLASS_ROWS = ", ".join(
    f"{{'k': '{k}', 'n': length(t) - length(regexp_replace(t, '{rx}', '', 'g'))}}"
    for k, rx in _CLASS_PATTERNS.items())


def _jsd(p: str, q: str) -> str:
    """Terms of the divergence of one histogram entry (base 2, not halved)."""
    return (f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0.0::DOUBLE END + "
            f"CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0.0::DOUBLE END")


ORACLE_SQL["op2_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             [{_CLASS_ROWS}] AS cs FROM d),
w AS (SELECT rid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
c AS (SELECT rid, lang, unnest(cs, recursive := true) FROM s),
tot AS (SELECT lang, count(*) AS total FROM w WHERE lang IS NOT NULL GROUP BY lang),
ref AS (SELECT lang, total FROM tot
        WHERE total >= {_P.lang_share}::DOUBLE * (SELECT sum(total) FROM tot)),
rw AS (SELECT lang, w, count(*) AS n, any_value(total) AS total FROM w JOIN ref USING (lang)
       GROUP BY lang, w HAVING count(*) >= {_P.word_share}::DOUBLE * any_value(total)),
rc AS (SELECT lang, k, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY lang)::DOUBLE AS total
       FROM c JOIN ref USING (lang) GROUP BY lang, k),
pair AS (SELECT s.rid, r.lang AS ref FROM s JOIN ref r
         ON s.lang = r.lang OR s.lang IS NULL OR s.lang NOT IN (SELECT lang FROM ref)),
n AS (SELECT rid, len(ws) AS n_words, length(t) AS n_chars FROM s),
cd AS (SELECT pair.rid, min(sqrt(least(1.0, greatest(0.0, v)))) AS char_d FROM (
         SELECT p.rid, p.ref, sum({_jsd("(c.n::DOUBLE / greatest(n.n_chars, 1))", "(rc.n / rc.total)")}) / 2 AS v
         FROM pair p JOIN c ON c.rid = p.rid JOIN n ON n.rid = p.rid
         JOIN rc ON rc.lang = p.ref AND rc.k = c.k GROUP BY p.rid, p.ref) pair GROUP BY pair.rid),
wh AS (SELECT p.rid, p.ref, rw.w, count(*) AS n, any_value(rw.n) AS m, any_value(rw.total) AS total
       FROM pair p JOIN w ON w.rid = p.rid JOIN rw ON rw.lang = p.ref AND rw.w = w.w
       GROUP BY p.rid, p.ref, rw.w),
rt AS (SELECT lang, any_value(total)::DOUBLE AS total, sum(n)::DOUBLE AS common FROM rw GROUP BY lang),
ww AS (SELECT p.rid, p.ref,
         coalesce(sum({_jsd("(wh.n::DOUBLE / n.n_words)", "(wh.m::DOUBLE / wh.total)")}), 0) AS seen,
         coalesce(sum(wh.m::DOUBLE / wh.total), 0) AS q_seen, coalesce(sum(wh.n), 0) AS k_seen
       FROM pair p JOIN n ON n.rid = p.rid LEFT JOIN wh ON wh.rid = p.rid AND wh.ref = p.ref
       GROUP BY p.rid, p.ref),
wo AS (SELECT ww.rid, ww.ref, seen, coalesce(rt.common / rt.total, 0) - q_seen AS q_unseen,
         (n.n_words - k_seen)::DOUBLE / greatest(n.n_words, 1) AS po,
         1 - coalesce(rt.common / rt.total, 0) AS qo
       FROM ww JOIN n ON n.rid = ww.rid LEFT JOIN rt ON rt.lang = ww.ref),
wd AS (SELECT rid, min(sqrt(least(1.0, greatest(0.0,
         (seen + q_unseen + {_jsd("po", "qo")}) / 2)))) AS word_d FROM wo GROUP BY rid),
win AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w
        WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM win WHERE w3 IS NOT NULL
          QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM
        (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup FROM
       (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM s)
       WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
base AS (SELECT s.rid, s.doc_id, n.n_words, n.n_chars,
           (SELECT sum(n) FROM c WHERE c.rid = s.rid AND k <> 'space') AS word_chars,
           (SELECT sum(n) FROM c WHERE c.rid = s.rid AND k = 'symbol') AS n_symbols,
           coalesce(ln.n_dup, 0) AS n_dup_lines, coalesce(rep.n_repeat, 0) AS n_repeat_words
         FROM s JOIN n ON n.rid = s.rid LEFT JOIN ln ON ln.rid = s.rid
         LEFT JOIN rep ON rep.rid = s.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed
       AND NOT (coalesce(char_d, 0) > {_P.max_char_distance}::DOUBLE AND n_chars >= {_P.min_chars})
       AND NOT (coalesce(word_d, 0) > {_P.max_word_distance}::DOUBLE
                    + {_P.word_noise}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE) AND n_words >= {_P.min_words})
         AS kept
FROM b LEFT JOIN cd ON cd.rid = b.rid LEFT JOIN wd ON wd.rid = b.rid
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.classify(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


_LINE = line_dedup.Params()
_TRIM = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

ORACLE_SQL["op12_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT rid, doc_id, t, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
k AS (SELECT *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {_LINE.min_chars} GROUP BY key
      HAVING count(DISTINCT (doc_id, t)) >= {_LINE.min_docs}),
m AS (SELECT k.*, f.key IS NULL AS stays FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, merkle.every_fifth(F.col("doc_id")))


def _merkle_sql(arity: int = 16, levels: int = 8) -> str:
    """The trees level by level, enough for arity ** levels rows a source."""
    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    bits = ", ".join(["-1"] * 8)
    crc = (f"""xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, {bits}])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384)
                          ELSE a // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)""")
    sql = [f"""leaves AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS k,
        sha256({head} || {field('text')}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0
             THEN sha256({head} || {field(low)}) END AS bad FROM documents)""",
           """a0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k
               ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY k) AS m,
               leaf AS d, rid FROM leaves)""",
           """ta0 AS (SELECT l.rid, l.doc_id, l.k, l.leaf, a0.pos, coalesce(l.bad, l.leaf) AS cur,
               '' AS proof FROM leaves l JOIN a0 ON a0.rid = l.rid)"""]

    def climb(t: str) -> None:
        for i in range(levels):
            run = f"PARTITION BY k, pos // {arity} ORDER BY pos ROWS BETWEEN"
            sql.append(f"""{t}g{i} AS (SELECT k, pos, m,
                coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
                coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
                FROM {t}{i})""")
            sql.append(f"""t{t}{i + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (pos, cur, proof),
                x.pos // {arity} AS pos, x.proof || bef || aft AS proof,
                CASE WHEN m = 1 THEN cur ELSE sha256(bef || cur || aft) END AS cur
                FROM t{t}{i} x JOIN {t}g{i} g ON g.k = x.k AND g.pos = x.pos)""")
            sql.append(f"""{t}{i + 1} AS MATERIALIZED (SELECT k, pos // {arity} AS pos,
                (any_value(m) + {arity - 1}) // {arity} AS m, CASE WHEN any_value(m) = 1
                THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
                FROM {t}{i} GROUP BY k, pos // {arity})""")
    climb("a")
    sql.append(f"""b0 AS MATERIALIZED (SELECT '' AS k, k AS source, d, count(*) OVER () AS m,
        row_number() OVER (ORDER BY k) - 1 AS pos FROM a{levels})""")
    sql.append(f"""tb0 AS (SELECT x.rid, x.doc_id, '' AS k, x.leaf, b0.d AS subroot, b0.pos, x.cur, x.proof
        FROM ta{levels} x JOIN b0 ON b0.source = x.k)""")
    climb("b")
    return "WITH " + ",\n".join(sql) + f"""
SELECT x.doc_id, x.leaf, x.subroot, r.d AS root, sha256(x.proof) AS proof_sha256,
       x.cur AS folded_root, x.cur = r.d AS verified FROM tb{levels} x CROSS JOIN b{levels} r
"""


ORACLE_SQL["op11_merkle_manifest"] = _merkle_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, vec_id % 100 == 0)


_HARD = hard_negatives.Params()

ORACLE_SQL["op13_hard_negatives"] = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT vec_id, label, list_transform(v, lambda x: floor({_HARD.scale} * x)) AS q FROM e
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        list_dot_product(a.q, r.q)::BIGINT AS score
      FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {_HARD.positives}),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score,
        s.score AS negative_score, row_number() OVER (
          PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND {_HARD.low} * positive_score <= 100 * s.score AND 100 * s.score <= {_HARD.high} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {_HARD.negatives}
"""
