import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, id string, q int"


def brute(rows, n_pos=5, n_neg=10, every=100, low=30, high=90):
    best = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in sorted(q):
        if a % every:
            continue
        s = sorted(((-sum(x * y for x, y in zip(q[a][1], v)), i, label) for i, (label, v) in q.items()
                    if i != a))
        for ps, pid, _ in [x for x in s if x[2] == q[a][0]][:n_pos]:
            hard = [x for x in s if x[2] != q[a][0] and low * -ps <= 100 * -x[0] <= high * -ps][:n_neg]
            out += [(a, pid, r + 1, i, -ps, -sc) for r, (sc, i, _) in enumerate(hard)]
    return sorted(out)


def mine(df, every=100, **kw):
    p = H.Params(**kw)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, params=p).collect())


def corpus(n, dims, seed=0, labels=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        c = int(rnd.integers(labels))
        v = centre[c] + rnd.normal(size=dims)
        v = v / np.linalg.norm(v) * rnd.choice([1, 1, 3])
        rows.append((i, int(rnd.integers(labels)) if rnd.random() < 0.3 else c, [float(x) for x in v], "k", 1))
    return rows


ODD = [(None, 1, [1.0, 0.0], "", 0), (1001, None, [1.0, 0.0], "", 0), (1002, 1, None, "", 0),
       (1003, 1, [None, 1.0], "", 0), (1004, 1, [float("nan")], "", 0), (1005, 1, [float("inf")], "", 0),
       (1006, 1, [], "", 0), (1007, 2, [0.0] * 8, "", 0), (1008, 2, [0.5], "", 0),
       (1010, 0, [-1.0, 2.0, -0.5], "", 0), (1100, 1, [], "", 0)]


@pytest.mark.parametrize("kw", [{}, {"positives": 2, "negatives": 3, "directions": 3, "task_rows": 20},
                                {"anchor_block": 4, "sample_rows": 20, "directions": 1}])
def test_matches_brute_force(spark, kw):
    rows = corpus(400, 8) + ODD
    rows += [(r[0] + 2000, r[1], rows[7][2], "", 0) for r in rows[:60]]     # one frequent vector, ties
    rows += [rows[100], (200, 0, rows[3][2], "", 0)]                        # repeated ids
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows, kw.get("positives", 5), kw.get("negatives", 10), 20)
    assert want and mine(df, 20, **kw) == want


def test_chunks_are_skipped_and_nothing_is_lost(monkeypatch):
    """Separated groups: the bounds leave out most pairs, the rest is exact."""
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(12, 6)) * 4
    cell = np.sort(rnd.integers(0, 12, 3000))
    x = np.floor(256 * (centre[cell] + 0.2 * rnd.normal(size=(3000, 6))))
    norm = np.linalg.norm(x, axis=1)
    ang = H.angles(x, norm, H.fit_directions(x[::10], 8))
    ids, label = np.arange(3000), cell % 3
    a = np.arange(0, 3000, 100)
    b = H.Block(ids[a], label[a], x[a], norm[a], ang[a], {})
    best, scored = H.Best(np.full(len(a), np.iinfo(np.int64).min), 5), 0
    for s in range(0, 3000, 100):
        c = slice(s, s + 100)
        scored += H.meet_positives(b, best, ids[c], label[c], x[c], norm[c], ang[c])
    same = (label[a][:, None] == label[None, :]) & (ids[a][:, None] != ids[None, :])
    assert scored < 0.5 * same.sum()
    full = (x[a] @ x.T).astype(np.int64)
    for i in range(len(a)):
        want = sorted((-full[i, j], j) for j in np.flatnonzero(same[i]))[:5]
        mine_ = best.slot == i
        assert sorted(zip(-best.score[mine_], best.id[mine_])) == want


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold(seed):
    rnd = np.random.default_rng(seed)
    x = np.floor(256 * rnd.normal(size=(200, 5)) * rnd.choice([0, 1e-3, 1, 1e6], size=(200, 1)))
    x[10:20] = x[0]
    x[20:30] = -x[0]
    norm = np.linalg.norm(x, axis=1)
    ang = H.angles(x, norm, H.fit_directions(x, 4))
    low, up = H.bounds(ang, norm, ang, norm)
    s = x @ x.T
    assert (low <= s).all() and (s <= up).all()
    c_low, c_up = H.chunk_bounds(ang, norm, ang[50:90], norm[50:90])
    assert (c_low[:, None] <= s[:, 50:90]).all() and (s[:, 50:90] <= c_up[:, None]).all()


def test_large_components_are_scored_exactly():
    a = np.array([[2.0 ** 30 + 1, -3.0]])
    n = np.linalg.norm(a, axis=1)
    assert H.scores(a, a, n, n)[0, 0] == (2 ** 30 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        big = np.array([[2.0 ** 40]])
        H.scores(big, big, np.array([2.0 ** 40]), np.array([2.0 ** 40]))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty) == []
    assert mine(spark.createDataFrame([(1, 1, [1.0], "", 0)], SCHEMA)) == []        # no anchor
    assert mine(spark.createDataFrame([(100, 1, [1.0], "", 0)], SCHEMA)) == []      # nothing else
    assert mine(spark.createDataFrame([(100, 1, [0.0], "", 0), (1, 1, [1.0], "", 0),
                                       (2, 2, [1.0], "", 0)], SCHEMA)) == [(100, 1, 1, 2, 0, 0)]
    assert random.Random(0).random()
