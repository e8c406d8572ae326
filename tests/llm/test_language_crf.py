import random
import zlib
from itertools import product

import numpy as np
import pytest

from cohort.llm import language_crf as L

P = L.Params(sequences=800, epochs=6)
SCHEMA = "doc_id long, text string, lang string, score string"
SYLLABLES = {"aa": ["the", "ing", "wh", "on", "re"], "bb": ["ein", "ung", "sch", "ö", "re"],
             "cc": ["eau", "tion", "é", "on", "qu"]}


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
            for _ in range(n)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join(words(rng, lang, rng.choice([6, 60, 200]))) + ".", lang, None))
    return rows


def brute(scores, trans):
    n, k = scores.shape
    marg, pairs, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in product(range(k), repeat=n):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) +
                   sum(trans[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, y in enumerate(path):
            marg[i, y] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return marg / z, pairs / z, np.log(z)


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    lens = np.array([3, 0, 6, 1, 4])
    scores, trans = 2 * r.standard_normal((lens.sum(), 3)), r.standard_normal((3, 3))
    got = L.marginals(scores, lens, trans)
    at = 0
    for n in lens:
        if n:
            assert np.allclose(got[at:at + n], brute(scores[at:at + n], trans)[0])
        at += n
    b = 2 * r.standard_normal((2, 5, 3))
    marg, pairs, log_z = L.pair_marginals(b, trans)
    want = [brute(x, trans) for x in b]
    assert np.allclose(marg, [w[0] for w in want])
    assert np.allclose(pairs, sum(w[1] for w in want)) and np.isclose(log_z, sum(w[2] for w in want))


def test_emissions_are_sums_over_word_features():
    r = np.random.default_rng(1)
    m = L.Model(["a", "b"], r.standard_normal((1 << 16, 2)), np.zeros((2, 2)))
    ws = ["x", "straße", "the", "e" * 500]
    many = L.emissions(m, ws, P)
    for w, got in zip(ws, many):
        feats, _ = L.word_features([w], P)
        assert np.allclose(got, m.table[feats].sum(axis=0))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return L.fit({k: [words(rng, k, 40) for _ in range(150)] for k in SYLLABLES}, P)


def test_code_switched_text_is_labelled_word_by_word(model):
    rng = random.Random(7)
    lab = L.Labeller(model, P)
    right = total = 0
    for _ in range(50):
        parts = [(k, words(rng, k, rng.randrange(8, 20))) for k in rng.sample(list(SYLLABLES), 3)]
        marg, _ = lab([" ".join(w for _, ws in parts for w in ws)])
        want = [k for k, ws in parts for _ in ws]
        got = [model.langs[i] for i in marg.argmax(axis=1)]
        right += sum(a == b for a, b in zip(got, want))
        total += len(want)
    assert right / total > 0.95
    text = " ".join(words(rng, "aa", 15) + words(rng, "bb", 15))
    assert [x[2] for x in lab.spans(text)] == ["aa", "bb"]


def test_cache_restart_gives_the_same(model):
    texts = [r[1] for r in corpus(60, 9)]
    a = L.Labeller(model, P).predict(texts)
    small = L.Labeller(model, L.Params(cache_words=50))
    b = [small.predict([t]) for t in texts]
    assert a[0] == [x[0][0] for x in b] and np.allclose(a[1], [x[1][0] for x in b])


def test_held_out_accuracy_and_columns(spark):
    rows = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r for r in L.identify(df, P).collect()}
    assert len(got) == 600
    held = []
    for i, _, lang, _ in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out:
            held.append(r.lang_pred == lang)
    assert sum(held) / len(held) > 0.97


def test_held_out_languages_are_never_learned(spark):
    rows = corpus(200, 4)
    lie = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s)
           for i, t, lang, s in rows]
    a = [r.lang_pred for r in L.identify(spark.createDataFrame(rows, SCHEMA), P).collect()]
    b = [r.lang_pred for r in L.identify(spark.createDataFrame(lie, SCHEMA), P).collect()]
    assert a == b and "zz" not in b


def test_null_letterless_long_repeated_empty(spark, model):
    odd = [(1, None), (2, ""), (3, "12 34 !? _"), (4, "the " * 60_000), (5, "re" * 100_000),
           (6, "ing whon"), (6, "ing whon"), (7, "中文")]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in odd], SCHEMA)
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(df, P, model).collect()]
    assert {g for g in got if g[0] <= 3} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert len(got) == len(odd) and len({g for g in got if g[0] == 6}) == 1
    assert all(g[1] in SYLLABLES for g in got if g[0] > 3)
    assert L.train(df, P) is None
    assert {r.lang_pred for r in L.identify(df, P).collect()} == {"und"}
    assert L.identify(df.where("false"), P).collect() == []


def test_every_language_is_learned(spark):
    # 70 languages, each with words of its own; the last ones are the rarest
    rng = random.Random(4)
    rows = []
    for k in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        for _ in range(12 if k < 64 else 8):
            rows.append((len(rows), " ".join(rng.choice(own) for _ in range(25)), "x", f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")
    p = L.Params(hash_bits=13, per_lang=20, epochs=3)
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, p).collect()}
    assert set(got.values()) == {r[3] for r in rows}
    assert sum(got[r[0]] == r[3] for r in rows) > 0.95 * len(rows)
