import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohort.llm import line_dedup as L

SCHEMA = "doc_id long, text string, mark int, h string, keep_bitmap string"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_docs=10, min_chars=1, keep_first=False):
    """(id, lines before, lines that go, kept text) per row; rows alike in id
    and text are one document."""
    seen, first = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), set()).add((i, t or ""))
    frequent = {k for k, v in seen.items() if len(v) >= min_docs}
    if keep_first:  # among the documents of the smallest id the order is the engine's
        for i, t, *_ in rows:
            for n, line in enumerate((t or "").split("\n")):
                at = (i is not None, i or 0, n)
                first[key(line)] = min(first.get(key(line), at), at)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for n, x in enumerate(lines) if key(x) not in frequent
                or keep_first and first[key(x)] == (i is not None, i or 0, n)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def digests(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    pool = [f" Line {i} Ä\t" for i in range(30)] + ["", "   ", "x", "X ", "footer"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(1, 9)) + (["Footer "] if i % 3 else [])),
             i, "h", None) for i in range(n)]
    return rows + [rows[5], rows[5], (7, rows[8][1], 0, "", ""), (None, "Footer\nown", 0, "", ""),
                   (None, None, 1, "", ""), (n, None, 1, "", ""), (n + 1, "", 1, "", ""),
                   (n + 2, "\n\n", 1, "", ""), (n + 3, "footer\n" * 5000 + "end", 1, "", "")]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (40, 2), (1, 1)])
def test_matches_brute_force(spark, min_docs, min_chars):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    p = L.Params(min_docs=min_docs, min_chars=min_chars)
    assert got(L.digest(df, params=p)) == digests(brute(rows, min_docs, min_chars))


def test_keep_first_and_clean(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 7]
    p = L.Params(min_docs=3, keep_first=True)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(L.digest(df, params=p)) == digests(brute(rows, 3, 1, True))
    out = L.clean(df, params=p)
    assert out.columns == df.columns
    want = sorted((i, None if t is None else k, m, h) for (i, t, m, h, _), (_, _, _, k)
                  in zip(rows, brute(rows, 3, 1, True)))
    assert sorted((r.doc_id, r.text, r.mark, r.h) for r in out.collect()) == want


def test_hot_key_over_many_partitions(spark):
    rows = [(i, f"shared\nown {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep_first in (False, True):
            p = L.Params(min_docs=400, keep_first=keep_first)
            assert got(L.digest(df, params=p)) == digests(brute(rows, 400, 1, keep_first))
        p = L.Params(min_docs=401)
        assert got(L.digest(df, params=p)) == digests(brute(rows, 401))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(30))
def test_stream_is_the_same_for_any_batches(seed):
    """The pass over sorted rows, cut into batches and partitions at random."""
    rnd = random.Random(seed)
    rows = sorted({(bytes([rnd.randint(0, 3)]) * 16, rnd.randint(0, 9), 0, rnd.randint(0, 2))
                   for _ in range(rnd.randint(1, 60))})
    names = ["h", "doc", "mark", "pos"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    out = pa.schema([("kind", pa.int8()), *zip(names, types), ("docs", pa.int64())])
    need, first = rnd.randint(1, 6), rnd.random() < 0.5
    p = L.Params(min_docs=need, keep_first=first)
    cuts = sorted(rnd.sample(range(len(rows)), min(3, len(rows) - 1)))
    cuts = [c for c in cuts if c and rows[c][:2] != rows[c - 1][:2]]
    emitted = []
    for a, e in zip([0, *cuts], [*cuts, len(rows)]):
        s = L._Stream(p, out)
        while a < e:
            m = min(e, a + rnd.randint(1, 20))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows[a:m]), types)]
            for b in s.feed(pa.RecordBatch.from_arrays(cols, names)):
                emitted += b.to_pylist()
            a = m
        for b in s.close(at_end=True):
            emitted += b.to_pylist()
    total, lead, drop = {}, {}, set()
    for r in emitted:
        at = (r["doc"], r["mark"], r["pos"])
        if r["kind"] == L.EDGE:
            total[r["h"]] = total.get(r["h"], 0) + r["docs"]
        elif r["kind"] == L.CANDIDATE and r["docs"]:
            lead[r["h"]] = min(lead.get(r["h"], at), at)
    for r in emitted:
        at = (r["doc"], r["mark"], r["pos"])
        if r["kind"] == L.DROP:
            drop.add(at)
        elif r["kind"] == L.CANDIDATE and total[r["h"]] >= need and at != lead.get(r["h"]):
            drop.add(at)
    want, by = set(), {}
    for h, d, m, n in rows:
        by.setdefault(h, []).append((d, m, n))
    for v in by.values():
        if len({d for d, *_ in v}) >= need:
            want |= set(v[1:] if first else v)
    both = {}
    for h, *at in rows:
        both.setdefault(tuple(at), []).append(h)
    # a position shared by several keys cannot be told apart here
    assert {x for x in drop if len(both[x]) == 1} == {x for x in want if len(both[x]) == 1}


def test_bitmaps_round_trip():
    rnd = random.Random(0)
    for n in (1, 7, 8, 9, 1000):
        for _ in range(20):
            gone = sorted(rnd.sample(range(n), rnd.randint(1, n)))
            keep = np.ones(n, bool)
            keep[gone] = False
            assert (L.unpack_bits(L.pack_bits(gone), n) == keep).all()
    assert L.unpack_bits(None, 3).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.digest(empty).collect() == []
    assert L.clean(empty).collect() == []
    assert L.keep_bitmaps(empty).collect() == []


def test_schema_of_lines(spark):
    df = spark.createDataFrame([("a", "x\ny")], "doc_id string, text string")
    assert to_arrow_schema(L._lines(df, "doc_id", "text", L.Params()).schema).field("doc").type == pa.string()
    assert L.digest(df.withColumn("z", F.lit(1))).first().n_lines == 2
