import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohort.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, pos int, seg int"


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def leaf(row, lower=False):
    i, text, lang, source, n = row[:5]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out = b""
    for v in (i, source, lang, n, text):
        b = None if v is None else str(v).encode()
        out += b"-" if b is None else f"{len(b)}:".encode() + b
    return sha(out)


def climb(nodes, arity):
    """(root, per node the list of (before, after) siblings level by level)."""
    paths = [[] for _ in nodes]
    group = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for s in range(0, len(nodes), arity):
            run = nodes[s:s + arity]
            for j in range(len(run)):
                for x in group[s + j]:
                    paths[x].append((run[:j], run[j + 1:]))
            up.append(sha("".join(run)))
            members.append([x for g in group[s:s + arity] for x in g])
        nodes, group = up, members
    return nodes[0], paths


def brute(rows, arity=16):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, subs = {}, []
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in by[s]], arity)
        trees[s] = paths
        subs.append(root)
    root, tops = climb(subs, arity)
    out = []
    for n, s in enumerate(names):
        for r, path in zip(by[s], trees[s]):
            full = path + tops[n]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur = leaf(r, hit)
            for a, b in full:
                cur = sha("".join(a) + cur + "".join(b))
            proof = sha("".join("".join(a) + "".join(b) for a, b in full))
            out.append((r[0], leaf(r), subs[n], root, proof, cur, cur == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n, sources, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = "big" if rnd.random() < 0.4 else rnd.choice(sources)
        t = rnd.choice(["Some Text", "all lower", "", None, "Ä É upper", "X" * 5000]) 
        rows.append((i, t, rnd.choice(["en", None]), s, rnd.choice([1, None]), "k", 1, 2))
    return rows


def audit(df, arity=16):
    return M.audit(df, M.every_fifth(F.col("doc_id")), arity=arity)


@pytest.mark.parametrize("n,sources,arity", [
    (300, ["a", None, "é", "Z", ""], 16), (150, [f"s{i}" for i in range(40)], 2),
    (90, [f"s{i}" for i in range(20)], 3)])
def test_matches_brute_force(spark, n, sources, arity):
    rows = corpus(n, sources)
    rows += [rows[0], rows[0], (None, "a", None, None, None, "", 0, 0), (5, "Other", None, "big", 3, "", 0, 0),
             (n + 7, "Lone", "en", "lone", 4, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(audit(df, arity)) == brute(rows, arity)


@pytest.mark.parametrize("n,sources", [(1, 1), (2, 1), (16, 1), (17, 1), (257, 1), (2, 2), (17, 17)])
def test_small_trees(spark, n, sources):
    rows = [(i, f"Text {i}", "en", f"s{i % sources}", i, "", 0, 0) for i in range(n)]
    assert got(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_paths_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    rows = corpus(200, ["a", "b", "c"])
    assert got(audit(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows, 2)


def test_proofs_fold_to_the_root_and_only_for_their_leaf(spark):
    rows = corpus(120, ["a", "b", "c"])
    out = M.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    want = {r[0]: r[1:4] for r in brute(rows)}
    for r in out:
        assert (r.leaf.hex(), r.subroot.hex(), r.root.hex()) == want[r.doc_id]
        assert M.fold(bytes(r.leaf), bytes(r.proof)) == bytes(r.root)
        assert M.fold(b"\0" * 32, bytes(r.proof)) != bytes(r.root)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit(empty).collect() == []
    assert M.proofs(empty).collect() == []
