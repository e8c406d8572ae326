import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from cohort.llm import packing, pii
from test_packing import best_fit_decreasing
from test_pii import brute as brute_spans
from test_quality_rules import brute_base
from test_simhash import brute_components, brute_fp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def build(n=60):
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "in"]
    rows = []
    for i in range(n):
        body = [rng.choice(common) if rng.random() < .4 else
                "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
                for _ in range(rng.choice([60, 120, 500]))]
        rows.append(" ".join(body))
    rows += rows[:5] * 3                                     # exact copies
    rows += [r.replace(" the ", " The ", 1) for r in rows[5:12]]   # same fingerprint
    rows += [f"{r} mail u1@mail2.example.com and 10.0.0.1" for r in rows[20:24]]
    rows += [None, "", "too short", "JUNK!! " * 200,
             " ".join(f"W{chr(65 + i % 26)}{chr(65 + i // 26)}%%%" for i in range(90))]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(build(), "doc_id long, text string, lang string, source string, "
                          "n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    frames = {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
        frames[name] = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    passed = {r.doc_id for r in frames["quality_rules"]}
    assert passed <= {i for i, r in rows.items() if not brute_base(r.text)[-1]}
    assert set(range(60)) <= passed                          # clean documents stay
    assert not passed & set(sorted(rows)[-5:])                 # junk goes
    last = {}
    for i in sorted(passed):
        last[rows[i].text] = i
    unique = {r.doc_id for r in frames["exact_dedup"]}
    assert unique == set(last.values())
    fps = {i: brute_fp(rows[i].text) for i in unique}
    near = {r.doc_id for r in frames["simhash_near_dedup"]}
    assert near == set(brute_components(fps).values())
    for r in frames["pii"]:
        text = rows[r.doc_id].text
        for kind, a, b in brute_spans(text):
            assert text[a:b] not in r.text
        if not brute_spans(text):
            assert r.text == text
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in frames["pii"]} == near
    check_packed(frames["best_fit_packing"], {r.doc_id: r.text for r in frames["pii"]})


def check_packed(packed, texts):
    enc = packing.Encoder("byte_bpe_50k")
    lengths, places = defaultdict(int), defaultdict(list)
    for r in packed:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(enc.exact(t)) + 1 for i, t in texts.items()}
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) == best_fit_decreasing([r.length for r in packed], 2048)


def test_run_is_the_stages_and_is_registered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32)
                 for r in E.queries()["pipeline"](spark, sf_dir).collect())
    assert got == want and got


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, "
                          "n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_all_null_texts_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").select(
        "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
    assert pii.redact(df).count() == 1
