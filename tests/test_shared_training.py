"""Shared-pass learners against NumPy statements of the same rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohort.operators import hist_trees as H
from cohort.operators import logistic as LG
from cohort.operators import shared_pass as SP
from cohort.operators.models import checked


def _frame(spark, n=400, seed=0, dims=5, parts=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:, 1] = rng.integers(0, 4, n)
    x[:, -1] = np.round(x[:, -1], 1)
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5 > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "label": y, "fold": np.arange(n) % 3, "g": np.arange(n) % 2,
                        "f": list(x)})
    df = spark.createDataFrame(pdf).repartition(parts, "id").select(
        "id", "label", "fold", "g", array_to_vector(F.col("f")).alias("features"))
    return df, x, y


LR = {"C": 1.0, "tol": 1e-10, "max_iter": 100}


def _newton(x, y, c):
    w = np.zeros(x.shape[1] + 1)
    xb = np.column_stack([x, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(np.eye(len(w)) + c * xb.T @ (xb * (p * (1 - p))[:, None]), w + c * xb.T @ (p - y))
    return w


def test_logistic_equals_numpy_for_all_fits_at_once(spark):
    df, x, y = _frame(spark)
    fits = [SP.Fit({**LR, "C": c}, out) for c in (0.1, 1.0, 10.0)
            for out in ((), (("fold", 0),), (("fold", 1), ("g", 0)))]
    models = LG.fit_many(df, fits)
    for f, m in zip(fits, models):
        rows = np.ones(len(y), bool)
        for c, v in f.out:
            rows &= (np.arange(len(y)) % (3 if c == "fold" else 2)) != v
        assert np.abs(m.weights - _newton(x[rows], y[rows], f.params["C"])).max() < 1e-8
        assert m.passes <= 12
    out = models[1].transform(df).orderBy("id").select("prob_lr", "raw_lr", "pred_lr").collect()
    p = models[1].proba(x)
    assert np.allclose([r.prob_lr[1] for r in out], p, atol=1e-12)
    assert [r.pred_lr for r in out] == (p > 0.5).astype(float).tolist()


def test_logistic_on_separable_and_one_class_rows(spark):
    df, x, _ = _frame(spark, 60)
    hard = df.withColumn("label", (F.element_at(F.expr("array(id)"), 1) < 30).cast("int"))
    m = LG.fit_many(hard, [SP.Fit({**LR, "C": 1e4})])[0]
    assert np.isfinite(m.weights).all()
    m = LG.fit_many(df.withColumn("label", F.lit(1)), [SP.Fit(LR)])[0]
    assert (m.proba(x) > 0.5).all()
    with pytest.raises(ValueError):
        LG.fit_many(df.where("false"), [SP.Fit(LR)])


def _brute_tree(b, w, y, p, n_bins, g=None, h=None):
    """Recursive: a tree as nested tuples (feature, bin, left, right) or value."""
    kind = "gb" if g is not None else "dt"

    def build(rows, level):
        if kind == "gb":
            ta, tb = g[rows].sum(), h[rows].sum()
            value = -ta / (tb + H.LAMBDA)
        else:
            ta, tb = w[rows].sum(), (w * y)[rows].sum()
            value = tb / ta
        if level == p["max_depth"] or kind == "dt" and (
                not 0 < tb < ta or ta < max(p["min_samples_split"], 2 * p["min_samples_leaf"])):
            return value
        best = None
        for f in range(b.shape[1]):
            for t in range(n_bins - 1):
                left = rows[b[rows, f] <= t]
                right = rows[b[rows, f] > t]
                if kind == "gb":
                    la, lb, ra, rb = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                    if lb < H.CHILD_WEIGHT or rb < H.CHILD_WEIGHT:
                        continue
                    gain = 0.5 * (la ** 2 / (lb + 1) + ra ** 2 / (rb + 1) - ta ** 2 / (tb + 1))
                    if gain <= H.LEAST_GAIN:
                        continue
                else:
                    la, ra = w[left].sum(), w[right].sum()
                    if la < p["min_samples_leaf"] or ra < p["min_samples_leaf"] or not la or not ra:
                        continue
                    lb, rb = (w * y)[left].sum(), (w * y)[right].sum()
                    gain = 2 * tb * (ta - tb) / ta - 2 * lb * (la - lb) / la - 2 * rb * (ra - rb) / ra
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, t, left, right)
        if best is None:
            return value
        return best[1], best[2], build(best[3], level + 1), build(best[4], level + 1)
    return build(np.arange(len(b)), 0)


def _as_tuple(t, node=0, depth=99, rate=1.0):
    if t.left[node] < 0 or depth == 0:
        return t.value[node] / rate
    left = t.left[node]
    return (int(t.feature[node]), int(t.bin[node]), _as_tuple(t, left, depth - 1, rate),
            _as_tuple(t, left + 1, depth - 1, rate))


def _same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-9
    return a[:2] == b[:2] and _same(a[2], b[2]) and _same(a[3], b[3])


DT = {"max_depth": 4, "min_samples_leaf": 1, "min_samples_split": 2}


def test_trees_equal_brute_force_for_all_fits_at_once(spark, monkeypatch):
    monkeypatch.setattr(H, "UNIT_CELLS", 300)      # several units a tree
    monkeypatch.setattr(SP, "BLOCK_ROWS", 50)
    df, x, y = _frame(spark, 260)
    cuts = H.fit_cuts(SP.pack(df, []), 12)
    b = H.binned(x, cuts)
    fits = [SP.Fit({**DT, **d}, out) for out in ((), (("fold", 1),)) for d in (
        {}, {"max_depth": 2}, {"min_samples_leaf": 7}, {"min_samples_split": 40, "max_depth": 6})]
    models = H.fit_many("dt", df, fits, max_bins=12)
    for f, m in zip(fits, models):
        rows = np.arange(260) % 3 != 1 if f.out else np.ones(260, bool)
        want = _brute_tree(b[rows], np.ones(rows.sum()), y[rows], f.params, 12)
        assert _same(_as_tuple(m.trees[0], depth=m.depth), want), f


def test_blocks_are_added_in_two_steps(spark, monkeypatch):
    df, _, _ = _frame(spark, 260, parts=9)
    on_driver = H.fit_many("dt", df, [SP.Fit(DT)])[0]
    monkeypatch.setattr(SP, "DRIVER_BYTES", 0)
    one = H.fit_many("dt", df, [SP.Fit(DT)])[0]
    monkeypatch.setattr(SP, "FAN_IN", 2)
    two = H.fit_many("dt", df, [SP.Fit(DT)])[0]
    assert _as_tuple(one.trees[0]) == _as_tuple(two.trees[0]) == _as_tuple(on_driver.trees[0])


def test_cuts_are_middles_or_quantiles(spark, monkeypatch):
    df, x, _ = _frame(spark, 2000)
    exact = H.fit_cuts(SP.pack(df, []), 32)
    assert exact[1].tolist() == [0.5, 1.5, 2.5]
    monkeypatch.setattr(H, "SUMMARY", 150)
    monkeypatch.setattr(SP, "BLOCK_ROWS", 100)
    rough = H.fit_cuts(SP.pack(df, []), 32)
    for j in (0, 2, 3):
        for cuts, slack in ((exact[j], 1e-9), (rough[j], 0.03)):
            ranks = np.searchsorted(np.sort(x[:, j]), cuts, side="right") / 2000
            assert len(cuts) == 31 and np.abs(ranks - np.arange(1, 32) / 32).max() <= slack + 1 / 2000


GB = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.1}


def test_boosted_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "STATE_ROUNDS", 2)
    df, x, y = _frame(spark, 240)
    cuts = H.fit_cuts(SP.pack(df, []), 10)
    b = H.binned(x, cuts)
    fits = [SP.Fit(GB), SP.Fit({**GB, "n_estimators": 2}), SP.Fit({**GB, "max_depth": 1}, (("g", 1),))]
    models = H.fit_many("gb", df, fits, max_bins=10)
    for f, m in zip(fits, models):
        rows = np.flatnonzero(np.arange(240) % 2 != 1) if f.out else np.arange(240)
        margin = np.zeros(len(rows))
        assert len(m.trees) == f.params["n_estimators"]
        for t in m.trees:
            p = 1 / (1 + np.exp(-margin))
            want = _brute_tree(b[rows], None, None, f.params, 10, p - y[rows], p * (1 - p))
            assert _same(_as_tuple(t, rate=0.1), want)
            margin += t.value[t.leaf(x[rows])]
        assert np.allclose(m.margin(x[rows]), margin)
    out = models[0].transform(df).orderBy("id").select("prob_gb", "raw_gb").collect()
    assert np.allclose([r.raw_gb[1] for r in out], models[0].margin(x))
    assert np.allclose([r.prob_gb[1] for r in out], models[0].proba(x))


RF = {"n_estimators": 6, "max_depth": 4, "min_samples_leaf": 1, "min_samples_split": 2}


def test_forest_trees_follow_the_drawn_rows_and_features(spark):
    df, x, y = _frame(spark, 300)
    m = H.fit_many("rf", df, [SP.Fit(RF)], max_bins=16)[0]
    b = H.binned(x, H.fit_cuts(SP.pack(df, []), 16))
    key = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()]).view(np.uint64)
    for i, t in enumerate(m.trees):
        seed = H.seed_of(42, i)
        w = H.bootstrap(key, seed)
        assert 0.5 < w.mean() < 1.5 and t.a[0] == w.sum() and t.b[0] == (w * y).sum()
        node = t.route(b.ravel(), np.arange(300) * 5, 99)
        assert all(t.a[n] == w[node == n].sum() for n in np.unique(node[w > 0]))
        inner = np.flatnonzero(t.left >= 0)
        feats = H.node_features(t.path[inner], seed, 5, 2)
        assert all(t.feature[n] in f for n, f in zip(inner, feats)) and len(inner) > 3
    p = m.proba(x)
    assert ((p > 0.5) == y).mean() > 0.85


def test_cut_fits_are_separate_fits_and_layout_does_not_matter(spark):
    df, x, _ = _frame(spark, 200)
    deep, flat = H.fit_many("rf", df, [SP.Fit(RF), SP.Fit({**RF, "max_depth": 2})])
    alone = H.fit_many("rf", df.repartition(2), [SP.Fit({**RF, "max_depth": 2})])[0]
    assert (flat.proba(x) == alone.proba(x)).all() and (deep.proba(x) != flat.proba(x)).any()
    assert np.allclose(flat.featureImportances.toArray(), alone.featureImportances.toArray())
    many, few = H.fit_many("gb", df, [SP.Fit(GB), SP.Fit({**GB, "n_estimators": 2})])
    alone = H.fit_many("gb", df, [SP.Fit({**GB, "n_estimators": 2})])[0]
    assert (few.proba(x) == alone.proba(x)).all() and len(many.trees) == 4


def test_models_save_and_load(spark, tmp_path):
    df, x, _ = _frame(spark, 120)
    for kind, p in (("dt", DT), ("rf", RF), ("gb", GB)):
        m = H.fit_many(kind, df, [SP.Fit(p)])[0]
        m.save(str(tmp_path / kind))
        assert (H.TreeModel.load(spark, str(tmp_path / kind)).proba(x) == m.proba(x)).all()
    m = LG.fit_many(df, [SP.Fit(LR)])[0]
    m.save(str(tmp_path / "lr"))
    assert (LG.LogisticModel.load(spark, str(tmp_path / "lr")).weights == m.weights).all()


def test_labels_other_than_two_are_refused(spark):
    df, _, _ = _frame(spark, 30)
    with pytest.raises(Exception, match="0 or 1"):
        LG.fit_many(df.withColumn("label", F.lit(2)), [SP.Fit(LR)])


def test_coded_rows_give_the_histogram():
    rng = np.random.default_rng(2)
    n, feats, bins, nodes = 200, 5, 16, 90
    x, slot = rng.integers(0, bins, (n, feats)).astype(np.uint8), rng.integers(0, nodes, n)
    a = rng.integers(1, 9, n).astype(float)
    b = a * rng.integers(0, 2, n)
    want = np.zeros((2, nodes, feats, bins))
    for i in range(n):
        for j in range(feats):
            want[:, slot[i], j, x[i, j]] += a[i], b[i]
    sums = H._Splits([(nodes, feats, bins)], "rf", [{}])
    blob = H.coded_rows((x[:, j] for j in range(feats)), a, b, slot)
    assert (sums.add(0, None, blob) == want.ravel()).all()
    assert len(blob) < len(H.coded(want.ravel())) / 4
    for whole in (True, False):
        got = H.histograms((x[:, j] for j in range(feats)), feats, (a, b), slot, bins, nodes, whole)
        assert (got == want.ravel()).all()


def test_many_cuts_are_scored_in_one_descent(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)).round(1)
    y = ((x[:, 0] * x[:, 1] + rng.normal(size=500) * 0.3) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "label": y, "f": list(x)})).select(
        "id", "label", array_to_vector("f").alias("features"))
    for kind, name, values in (("rf", "max_depth", [2, 4, 7]), ("gb", "n_estimators", [1, 3, 6])):
        base = {"n_estimators": 3} if kind == "rf" else {"max_depth": 3}
        fits = [SP.Fit(checked(kind, {**base, name: v})) for v in values]
        models = H.fit_many(kind, df, fits)
        calls, body = [], H.Tree.leaves
        monkeypatch.setattr(H.Tree, "leaves", lambda t, v, d: (calls.append(1), body(t, v, d))[1])
        got = H.TreeModel.probas(x, models)
        assert len(calls) == len(models[0].all_trees)
        monkeypatch.undo()
        for m, p in zip(models, got):
            assert (m.proba(x) == p).all()
            flat = np.ascontiguousarray(H.binned(x, H.fit_cuts(SP.pack(df, []))).T)
            for t in m.trees if kind == "gb" else []:
                assert (t.leaf(x) == t.route_columns(flat)).all()
    # a pass sends a bounded number of nodes, with the same trees
    deep = [SP.Fit(checked("rf", {"n_estimators": 3, "max_depth": 7}))]
    want = H.fit_many("rf", df, deep)[0].proba(x)
    monkeypatch.setattr(H, "PASS_NODES", 1)
    monkeypatch.setattr(H, "FEW_SPLITS", 2)
    assert (H.fit_many("rf", df, deep)[0].proba(x) == want).all()


def test_passes_of_a_boosted_model_send_little_to_the_driver():
    # 100 rounds of depth 3 take 300 passes
    assert 300 * SP.DRIVER_BYTES < 1000 << 20


def test_trees_grown_in_one_task_are_those_of_the_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 9)).round(1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=900) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "label": y, "fold": np.arange(900) % 3,
                                             "f": list(x)})).repartition(5, "id").select(
        "id", "label", "fold", array_to_vector(F.col("f")).alias("features"))
    packed = SP.pack(df, ["fold"])
    calls = []
    monkeypatch.setattr(SP, "run_pass", lambda *a, old=SP.run_pass: calls.append(1) or old(*a))
    names = ("feature", "bin", "left", "gain", "a", "b", "level", "path", "threshold", "value")
    for kind, params in (("dt", {"max_depth": 9}), ("rf", {"n_estimators": 7, "max_depth": 8}),
                         ("gb", {"n_estimators": 28}), ("gb", {"n_estimators": 3, "subsample": 0.6})):
        fits = [SP.Fit(checked(kind, params), o)
                for o in ((), (("fold", 1),), (("fold", 0),))]
        got, passes = [], []
        for local, nodes, cells in ((H.LOCAL_BYTES, H.LOCAL_NODES, H.UNIT_CELLS), (H.LOCAL_BYTES, 1, 1 << 10),
                                    (0, 1, H.UNIT_CELLS)):
            monkeypatch.setattr(H, "LOCAL_BYTES", local)
            monkeypatch.setattr(H, "LOCAL_NODES", nodes)
            monkeypatch.setattr(H, "UNIT_CELLS", cells)
            H.bin_matrix(packed)
            calls.clear()
            got.append(H.fit_many(kind, packed, fits))
            passes.append(len(calls))
            monkeypatch.setattr(H, "LOCAL_BYTES", 16 << 20)
            monkeypatch.setattr(H, "UNIT_CELLS", 1 << 18)
        assert passes[0] == passes[1] == 0 < passes[2]
        for other in got[1:]:
            for m, n in zip(got[0], other):
                assert len(m.trees) == len(n.trees) == params.get("n_estimators", 1)
                for s, t in zip(m.trees, n.trees):
                    assert all(np.array_equal(getattr(s, c), getattr(t, c)) for c in names), kind
