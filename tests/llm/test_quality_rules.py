import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohort.llm import quality_rules as Q
from cohort.llm.common import column_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, n_words string, kept int"


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def jsd(p, q):
    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt((kl(p, m) + kl(q, m)) / 2)


CLEAN = ["the cat and the dog went to the house of the man " * 2 +
         " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)} the and" for j in range(20)) for i in range(30)]
EDGE = [None, "", " \t\n", "a\x0bb\x0cc\rd e", "x\n\n x\nx\nx ", "\x1cα β γ α β γ é # <|>",
        "same line\n" * 40, "one two three " * 30, "#$% " * 80, "A" * 300_000, "z " * 120_000,
        "UPPER CASE WORDS ONLY!! " * 1 + " ".join(f"W{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60))]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def test_base_counts_match_brute_force(spark):
    texts = EDGE + CLEAN
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                      r.base_failed) for r in Q.judge(frame(spark, texts)).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_distances_match_brute_force_and_junk_goes(spark):
    texts = CLEAN + EDGE[-4:]
    df = frame(spark, texts)
    p = Q.Params(word_share=0.02)
    refs = Q.fit_references(df, p)
    all_words = Counter(w for t in texts for w in t.encode().split())
    total = sum(all_words.values())
    common = {w: n for w, n in all_words.items() if n >= 0.02 * total}
    assert refs["en"].words == common and refs["en"].total_words == total
    rows = {r.doc_id: r for r in Q.judge(df, p, refs).collect()}
    keys = sorted(common)
    q = [common[w] / total for w in keys]
    q.append(1 - sum(q))
    for i, t in enumerate(texts):
        c = Counter(t.encode().split())
        d = [c[w] / sum(c.values()) for w in keys]
        assert math.isclose(rows[i].word_distance, jsd([*d, 1 - sum(d)], q), abs_tol=1e-9)


def test_guards_missing_language_and_empty(spark):
    p = Q.Params(word_share=0.02)
    refs = Q.fit_references(frame(spark, CLEAN), p)
    junk = " ".join(f"Q{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60))
    rows = {r.doc_id: r.kept for r in Q.judge(frame(spark, [CLEAN[0], junk], None), p, refs).collect()}
    assert rows == {0: True, 1: False}
    strict = Q.Params(0.02, min_chars=10_000, min_words=10_000)
    assert all(r.kept for r in Q.judge(frame(spark, [junk]), strict, refs).collect())
    empty = frame(spark, CLEAN).where("false")
    assert Q.judge(empty).collect() == [] and Q.keep(empty).collect() == []
    no_refs = {r.doc_id: r.kept for r in Q.judge(frame(spark, [junk], None)).collect()}
    assert no_refs == {0: True}


def test_keep_returns_whole_rows_and_repeats(spark):
    df = frame(spark, [CLEAN[0], CLEAN[0], None, "short"])
    kept = Q.keep(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == sorted(
        (i, CLEAN[0], "en", "x", 1) for i in (0, 1))


def test_repeated_words_many_distinct_ids():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 400)
    assert Q.repeated_words(ids, 50) == Q.repeated_words(ids, 1 << 21)


def test_columns_in_other_case_and_absent_columns(spark):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "en", "x"), (2, "short", "en", "y")],
                               "doc_id long, Text string, Lang string, last string")
    assert [r.doc_id for r in Q.keep(df).collect()] == [1]
    with pytest.raises(KeyError):
        column_bytes(pa.RecordBatch.from_pydict({"other": ["a"]}))


def test_the_word_limit_falls_with_length(spark):
    """The same mix of words is allowed more distance in a short text."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    def text(n, share):
        return " ".join(rng.choice(common) if rng.random() > share else f"r{rng.randrange(10 ** 6)}"
                        for _ in range(n))
    rows = [(i, text(400, .1), "en") for i in range(60)] + [(100, text(3000, .55), "en")] \
        + [(101, text(60, .1), "en")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(
        rows, "doc_id long, text string, lang string")).collect()}
    p = Q.Params()
    for r in got.values():
        limit = p.max_word_distance + p.word_noise / r.n_words ** .5
        assert r.kept == (r.char_distance <= p.max_char_distance and r.word_distance <= limit)
    assert got[101].kept and got[101].word_distance > got[0].word_distance
