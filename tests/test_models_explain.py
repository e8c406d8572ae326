import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohort.operators import explain as X
from cohort.operators import selection as SEL
from cohort.operators.folds import hash_folds
from cohort.operators.models import DEFAULT_PARAMS, EXTRA, fit_model, register, settle
from cohort.operators.tree_shap import leaves, tree_shapley


def _separable(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    Xm = rng.normal(size=(n, 4))
    y = (Xm[:, 0] + 0.5 * Xm[:, 1] > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "label": y, "f": list(Xm)})
    df = spark.createDataFrame(pdf).select("id", "label", array_to_vector(F.col("f")).alias("features"))
    return hash_folds(df, "id", 3).cache()


def test_models_beat_majority_and_are_seeded(spark):
    df = _separable(spark)
    base = max(df.where("label = 1").count(), df.where("label = 0").count()) / df.count()
    for key in ("lr", "dt", "rf", "gb", "knn"):
        params = {"n_estimators": 10} if key in ("rf", "gb") else None
        m = fit_model(key, df, params)
        acc = m.transform(df).select(F.avg((F.col(f"pred_{key}") == F.col("label")).cast("double"))).first()[0]
        assert acc > base, key
    a = fit_model("rf", df, {"n_estimators": 5}).featureImportances
    b = fit_model("rf", df, {"n_estimators": 5}).featureImportances
    assert a == b


def test_grid_search_and_selection_rule(spark):
    df = _separable(spark)
    table, best, model = SEL.grid_search("dt", {"max_depth": [1, 3], "min_samples_leaf": [1]}, df, 3)
    rows = table.orderBy("candidate").collect()
    assert len(rows) == 2 and best == {"max_depth": 3 if rows[1]["f1_macro"] > rows[0]["f1_macro"] else 1,
                                       "min_samples_leaf": 1}
    res = spark.createDataFrame(
        [("A", 0, 0.7), ("B", 1, 0.8), ("C", 2, 0.8), ("Stacking", 3, 0.9)],
        "model string, position int, cv_f1_macro double")
    assert SEL.select_best(res).first()["model"] == "B"
    assert SEL.select_best(res, include_ensembles=True).first()["model"] == "Stacking"
    zero = spark.createDataFrame([("A", 0, 0.0), ("Voting Hard", 1, 0.5), ("Voting Soft", 2, 0.4)],
                                 "model string, position int, cv_f1_macro double")
    assert SEL.select_best(zero).first()["model"] == "Voting Soft"


def _brute_shapley(f, x, background, dim):
    """Average over the background of exact two-point Shapley values."""
    from itertools import combinations
    from math import factorial
    phi = np.zeros(dim)
    for b in background:
        cache = {}

        def value(on):
            if on not in cache:
                cache[on] = f(np.array([x[j] if j in on else b[j] for j in range(dim)]))
            return cache[on]
        for j in range(dim):
            rest = [k for k in range(dim) if k != j]
            for n in range(dim):
                w = factorial(n) * factorial(dim - n - 1) / factorial(dim)
                for sub in combinations(rest, n):
                    s = frozenset(sub)
                    phi[j] += w * (value(s | {j}) - value(s))
    return phi / len(background)


def test_tree_shapley_matches_enumeration_and_adds_up(spark):
    df = _separable(spark, 120)
    names, bg = ["a", "b", "c", "d"], X.sample_rows(_separable(spark, 120), 6, 42, "id")
    b = [r.features.toArray() for r in bg.collect()]
    rows = df.where("id < 8")
    for key, params in (("dt", {"max_depth": 4}), ("rf", {"n_estimators": 5, "max_depth": 4}),
                        ("gb", {"n_estimators": 4})):
        m = fit_model(key, df, params)
        parts = leaves(m)

        def f(x):
            return sum(p.value for p in parts
                       if all(lo < x[j] <= hi for j, lo, hi in zip(p.features, p.low, p.high)))
        out = m.transform(df).select("features", f"prob_{key}", f"raw_{key}").limit(20).collect()
        for r in out:           # the leaves are the model
            want = r[f"raw_{key}"][1] if key == "gb" else r[f"prob_{key}"][1]
            assert abs(f(r.features.toArray()) * (1 if key != "gb" else 1) - want) < 1e-9
        frame = tree_shapley(m, rows, bg, names, ["id"])
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        got = {r.id: np.array([r[n] for n in names]) for r in frame.collect()}
        for r in rows.collect():
            x = r.features.toArray()
            assert np.allclose(got[r.id], _brute_shapley(f, x, b, 4), atol=1e-9)
            assert abs(got[r.id].sum() - (f(x) - np.mean([f(v) for v in b]))) < 1e-9


def test_deep_trees_are_explained_within_bounded_memory(spark):
    """Leaves of more features than a table holds: the same by enumeration."""
    from cohort.operators import tree_shap
    rng = np.random.default_rng(5)
    Xm = rng.normal(size=(200, 10))
    y = (Xm.prod(axis=1) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "label": y, "f": list(Xm)})).select(
        "id", "label", array_to_vector(F.col("f")).alias("features"))
    m = fit_model("dt", df, {"max_depth": 15})
    parts = leaves(m)
    assert max(len(p.features) for p in parts) > 5
    names = [f"f{j}" for j in range(10)]
    bg, rows = df.where("id < 3"), df.where("id between 10 and 12")
    b = [r.features.toArray() for r in bg.collect()]
    out = {}
    for bits in (8, 3):
        old, tree_shap.TABLE_BITS = tree_shap.TABLE_BITS, bits
        out[bits] = tree_shapley(m, rows, bg, names, ["id"]).toPandas().sort_values("id")[names].to_numpy()
        tree_shap.TABLE_BITS = old
    # the tables are used in the task, so compare the plain function too
    leaf = max(parts, key=lambda p: len(p.features))
    k = len(leaf.features)
    every = np.arange(1 << k)
    codes = tree_shap.patterns(leaf, np.array(b))
    u, n = np.unique(codes, return_counts=True)
    some = np.array([0, 3, (1 << k) - 1])
    assert np.allclose(tree_shap.shares(leaf, every, u, n)[some], tree_shap.shares(leaf, some, u, n))
    for r, got in zip(rows.orderBy("id").collect(), out[3]):
        want = _brute_shapley(lambda v: m.proba(v[None, :])[0], r.features.toArray(), b, 10)
        assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(out[8], out[3])


def test_shapley_linear(spark):
    df = _separable(spark, 120)
    lin = X.shapley_linear(fit_model("lr", df), df.where("id < 10"), X.sample_rows(df, 4, 42, "id"),
                           ["a", "b", "c", "d"], ["id"]).toPandas()
    assert lin.shape == (10, 5)


def test_fits_do_not_depend_on_the_partitioning(spark):
    df = _separable(spark, 200)
    a, b = (fit_model("rf", settle(df.repartition(n)), {"n_estimators": 8}) for n in (2, 8))
    assert a.featureImportances == b.featureImportances
    assert [r.prob_rf for r in a.transform(df).orderBy("id").collect()] == \
        [r.prob_rf for r in b.transform(df).orderBy("id").collect()]


def test_ensembles_cv_and_search_over_all_models(spark):
    df = _separable(spark, 150)
    params = {"rf": {"n_estimators": 5}, "gb": {"n_estimators": 3}}
    keys = ["lr", "dt", "knn", "rf", "gb"]
    rows = SEL.ensemble_cv(SEL.ENSEMBLES, keys, params, df, 3).collect()
    assert {r.model for r in rows} == {"Stacking", "Voting Soft", "Voting Hard"}
    assert all(r.accuracy > 0.7 for r in rows)
    table, key, best, model = SEL.search_all(
        {"dt": {"max_depth": [1, 3]}, "knn": {"n_neighbors": [3]}}, df, 3)
    got = table.collect()
    assert len(got) == 3 and sum(r.chosen for r in got) == 1
    top = max(r.f1_macro for r in got)
    assert [r.f1_macro for r in got if r.chosen] == [top] and key in ("dt", "knn")


def test_unknown_parameters_and_registered_kinds(spark):
    df = _separable(spark, 100)
    with pytest.raises(ValueError, match="max_features"):
        fit_model("dt", df, {"max_features": 2})
    register("shallow", {"depth": 2}, lambda p, c: DecisionTreeClassifier(maxDepth=p["depth"], **c))
    try:
        table, best, model = SEL.grid_search("shallow", {"depth": [1, 2]}, df, 3)
        assert table.count() == 2 and "pred_shallow" in model.transform(df).columns
        with pytest.raises(ValueError):
            register("shallow", {}, None)
    finally:
        DEFAULT_PARAMS.pop("shallow"), EXTRA.pop("shallow")


def test_learning_curve_counts(spark):
    df = _separable(spark, 90)
    rows = SEL.learning_curve("dt", {}, df, 3).orderBy("train_size").collect()
    assert [r.train_size for r in rows] == sorted(r.train_size for r in rows) and len(rows) == 5
    assert all(0 <= r.validation_mean <= 1 for r in rows)


def test_drilldown_rule():
    assert X.drilldown(["Age Fare", "Sex*Class", "Fare^2", "Pclass", "Age"]) == \
        ["AgeGroup", "Sex", "FareGroup", "Pclass"]


def test_kernel_attributions_are_exact_with_all_coalitions(spark):
    from cohort.operators import kernel_shap as K
    df = _separable(spark, 120)
    names, bg, rows = ["a", "b", "c", "d"], X.sample_rows(df, 6, 42, "id"), df.where("id < 6")
    b = [r.features.toArray() for r in bg.collect()]
    lr = fit_model("lr", df)
    linear = X.shapley_linear(lr, rows, bg, names, ["id"]).toPandas().sort_values("id")[names].to_numpy()
    got = K.kernel_shapley(lr, rows, bg, names, ["id"], margin=True).toPandas().sort_values("id")
    assert np.allclose(got[names].to_numpy(), linear, atol=1e-8)
    for key in ("gb", "knn"):
        m = fit_model(key, df, {"n_estimators": 3} if key == "gb" else None)
        got = {r.id: np.array([r[n] for n in names])
               for r in K.kernel_shapley(m, rows, bg, names, ["id"], key=key).collect()}
        if key == "gb":
            f = lambda v: m.proba(v[None, :])[0]
        else:
            t = df.select("id", "label", "features").toPandas()
            x, y = np.array([v.toArray() for v in t.features]), t.label.to_numpy()

            def f(v):
                d = ((x - v) ** 2).sum(axis=1)
                return y[np.lexsort((t.id, d))[:5]].mean()
        for r in rows.collect():
            v = r.features.toArray()
            assert np.allclose(got[r.id], _brute_shapley(f, v, b, 4), atol=1e-9), key
            assert abs(got[r.id].sum() - (f(v) - np.mean([f(w) for w in b]))) < 1e-9


def test_sampled_coalitions_sum_up_and_come_near():
    from cohort.operators import kernel_shap as K
    z, w = K.coalitions(12, 200)
    assert len(z) <= 202 and len({tuple(r) for r in z}) == len(z) and np.isclose(w.sum(), 1)
    every, all_w = K.coalitions(8, 10 ** 6)
    assert len(every) == 2 ** 8 - 2 and np.isclose(all_w.sum(), 1)
    rng = np.random.default_rng(0)
    x, bg, a = rng.normal(size=12), rng.normal(size=(9, 12)), rng.normal(size=12)
    f = lambda v: np.tanh(v @ a) + v[:, 0] * v[:, 1]
    p, g = K.solver(z, w)
    full, base = f(x[None, :]), f(bg).mean()
    phi = K.solve(p, g, K.mixed_values(x, z, bg, f)[None, :], full, base)[0]
    assert np.isclose(phi.sum(), full[0] - base)
    ze, we = K.coalitions(12, 10 ** 6)
    pe, ge = K.solver(ze, we)
    exact = K.solve(pe, ge, K.mixed_values(x, ze, bg, f)[None, :], full, base)[0]
    assert np.abs(phi - exact).max() < 0.15 * np.abs(exact).max()
