import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohort.llm import simhash as S
from cohort.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, fp string, id int"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["ÄRGER", "É", "Mixed", "x y"]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "a b c d", "a b c d e"]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            twin = list(base)
            twin[rng.randrange(len(twin))] = rng.choice(vocab)
            texts.append("\n".join(twin).upper())
    texts += ["same text " * 30] * 20 + ["long " * 50_000, "q" * 400_000]
    return texts


def test_cluster_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    for p in (S.Params(), S.Params(tile=3)):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.cluster(df, p).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = S.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_spark_hash_is_the_same_hash(spark):
    r = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert r & (2 ** 64 - 1) == xxhash.xxh64(b"a b c d", seed=42).intdigest()


def test_chains_link_through_and_tile_pairs_lose_none():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(m) for m in (1, 0b1111, 1 << 40, 0b11111)])
    a, b = np.unique(base), np.unique(near)
    edges = S.tile_links(a, b, False, 4)
    joined = {tuple(sorted(map(int, e))) for e in edges}
    want = {(int(x), int(y)) for x in a for y in b if (int(x) ^ int(y)).bit_count() <= 4}
    want = {tuple(sorted(e)) for e in want}

    def comps(es):
        g = {}
        for x, y in es:
            g.setdefault(x, {x}), g.setdefault(y, {y})
            m = g[x] | g[y]
            for z in m:
                g[z] = m
        return {frozenset(v) for v in g.values()}
    assert comps(joined) == comps(want)


def test_components_of_paths_stars_and_none(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(1005, 1005)]
    df = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(df.where("false"), "a", "b").collect() == []


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.cluster(empty).collect() == [] and S.keep(empty).collect() == []
    rows = [(7, "a b c", "x", 1), (7, "a b c", "x", 1), (7, "other words here now", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in S.cluster(df).collect()) == [(7, 7)] * 3
    assert sorted(map(tuple, S.keep(df).collect())) == sorted({rows[0], rows[2]})


def test_keep_with_columns_of_its_own_names_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, 2), (2, "a b c d e", 3, 4), (3, "q r s t u v", 5, 6)],
                               "doc_id long, text string, __k_id int, __k_mark int")
    kept = S.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    null = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in S.cluster(null).collect()} == {None}
