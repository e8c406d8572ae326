import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohort.llm import ordinal_quality as Q

DOCS = "doc_id long, text string, score double, grade string"
LABELS = "doc_id long, quality int, toxic int"


def test_gradient_matches_differences_and_cuts_are_ordered():
    r = np.random.default_rng(0)
    s, y, raw = r.standard_normal(30), r.integers(0, 4, 30), r.standard_normal(3)
    _, g_s, g_raw = Q.loss_and_grad(s, y, raw)
    for i in range(5):
        d = s.copy()
        d[i] += 1e-6
        assert abs((Q.loss_and_grad(d, y, raw)[0] - Q.loss_and_grad(s, y, raw)[0]) / 1e-6 - g_s[i]) < 1e-4
    for j in range(3):
        d = raw.copy()
        d[j] += 1e-6
        assert abs((Q.loss_and_grad(s, y, d)[0] - Q.loss_and_grad(s, y, raw)[0]) / 1e-6 - g_raw[j]) < 1e-4
    assert (np.diff(Q.cut_points(raw)) > 0).all()


def test_probabilities_fall_with_the_grade_and_sum_to_one():
    m = Q.Model([0, 1, 2], np.zeros(4), np.array([-1.0, 2.0]))
    t = m.at_least(np.linspace(-5, 5, 11))
    assert (np.diff(t, axis=1) <= 0).all() and (t[:, 0] == 1).all()
    each = t - np.column_stack([t[:, 1:], np.zeros(11)])
    assert np.allclose(each.sum(axis=1), 1)


def test_scorer_equals_the_training_form():
    p = Q.Params(cache_words=4)
    w = np.random.default_rng(1).standard_normal(1 << p.hash_bits).astype(np.float32)
    sc = Q.Scorer(Q.Model([0, 1], w, np.zeros(1)), p)
    texts = [b"", b"a b a\na b a\n", "Ärger über 99 %% ###".encode(), b"x " * 500, b"y" * 9000]
    for t in texts:
        f, v = Q.sparse(t, p)
        assert np.isclose(sc([t])[0], (w[f] * v).sum(), atol=1e-4)
    assert np.allclose(sc(texts), [sc([t])[0] for t in texts])


def corpus(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "re", "ing", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.choice([30, 150]))]
        q, t = 1, 0
        kind = rng.random()
        if kind < .3:
            q = 0
            ws = rng.choice([[w.upper() + "!!" for w in ws], [w + "###" for w in ws],
                             [x for w in ws for x in (w, "|")], [ws[0]] * len(ws)])
        elif kind < .5:
            t = 1
            for _ in range(len(ws) // 6):
                ws.insert(rng.randrange(len(ws)), rng.choice(["foulword", "blight"]))
        rows.append((i, " ".join(ws), q, t))
    return rows


def test_held_out_selection_and_columns(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, *_ in rows], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS)
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == 1500
    keep, grade = [], []
    for i, _, q, t in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1
        assert r.kept == (r.tail_prob >= 0.5)
        if r.held_out:
            keep.append(r.kept == (q == 1))
            grade.append(r.predicted_grade == (0 if not q else 1 if t else 2))
    assert sum(keep) / len(keep) > 0.98 and sum(grade) / len(grade) > 0.9


def test_held_out_labels_are_never_learned(spark):
    rows = corpus(300)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, *_ in rows], DOCS)
    a = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS)
    b = spark.createDataFrame([(i, 1 - q if h else q, t) for (i, _, q, t), h in zip(rows, held)], LABELS)
    assert sorted((r.doc_id, r.score) for r in Q.classify(docs, a).collect()) == \
        sorted((r.doc_id, r.score) for r in Q.classify(docs, b).collect())


def test_grades_nulls_repeats_long_empty(spark):
    lab = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, 1), (5, 1, None)], LABELS)
    got = {r.doc_id: r.g for r in lab.select("doc_id", Q.grade_of(F.col("quality"), F.col("toxic"))
                                             .alias("g")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: 2}
    rows = corpus(200)
    odd = [(900, None), (901, ""), (902, "q" * 300_000), (903, "a b " * 50_000), (904, "one two"),
           (904, "one two")]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t, *_ in rows] +
                                 [(i, t, None, None) for i, t in odd], DOCS)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1)], LABELS)
    out = [r for r in Q.classify(docs, labels).collect() if r.doc_id >= 900]
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 904}) == 1
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
    none = Q.classify(docs, labels.where("false")).collect()
    assert {(r.score, r.expected_grade, r.predicted_grade) for r in none} == {(0.0, 0.0, 0)}
    assert Q.classify(docs.where("false"), labels).collect() == []
