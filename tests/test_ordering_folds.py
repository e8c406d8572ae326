import numpy as np
import pandas as pd

from cohort.operators.folds import stratified_folds
from cohort.operators.metrics import roc_points
from cohort.operators.ordering import positions


def test_positions_with_hot_group(spark):
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n))  # group 0 holds ~40 %
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": g})
    out = positions(spark.createDataFrame(pdf), ["g"], ["id"], "pos", n_parts=7).toPandas()
    exp = pdf.assign(pos=pdf.groupby("g")["id"].rank(method="first").astype(int) - 1)
    m = out.merge(exp, on=["id", "g"], suffixes=("", "_e"))
    assert len(m) == n and (m["pos"] == m["pos_e"]).all()


def _sk_stratified(y, k):
    """NumPy statement of the unshuffled stratified k-fold rule."""
    _, first, inv = np.unique(y, return_index=True, return_inverse=True)
    order = np.argsort(first)
    enc = np.empty_like(order)
    enc[order] = np.arange(len(order))
    y_enc = enc[inv]
    y_sorted = np.sort(y_enc)
    alloc = np.array([np.bincount(y_sorted[i::k], minlength=len(order)) for i in range(k)])
    folds = np.empty(len(y), dtype=int)
    for c in range(len(order)):
        folds[y_enc == c] = np.arange(k).repeat(alloc[:, c])
    return folds


def test_stratified_folds_match_rule(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(20, 400))
        y = rng.integers(0, 3 if seed % 2 else 2, n)
        pdf = pd.DataFrame({"id": np.arange(n), "label": y})
        got = stratified_folds(spark.createDataFrame(pdf), "label", "id", 3).toPandas().sort_values("id")
        assert (got["fold"].to_numpy() == _sk_stratified(y, 3)).all()


def test_roc_and_auc_brute_force(spark):
    from cohort.operators.metrics import auc
    rng = np.random.default_rng(5)
    s = np.round(rng.random(500), 2)  # many ties
    y = (rng.random(500) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    got = auc(df, "y", "s").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12
    pts = roc_points(df, "y", "s").toPandas()
    for _, r in pts.sample(20, random_state=1).iterrows():
        assert abs(r["tpr"] - (pos >= r["threshold"]).mean()) < 1e-12
        assert abs(r["fpr"] - (neg >= r["threshold"]).mean()) < 1e-12


def test_running_sums_and_next_values_over_many_partitions(spark):
    import numpy as np
    import pandas as pd

    from cohort.operators.ordering import running_sums
    rng = np.random.default_rng(4)
    n = 500
    g = [None if v == 3 else f"g{min(v, 1)}" for v in rng.integers(0, 4, n)]
    pdf = pd.DataFrame({"g": g, "i": rng.permutation(n), "a": rng.integers(-5, 9, n), "b": rng.normal(size=n)})
    df = spark.createDataFrame(pdf, "g string, i long, a long, b double").repartition(4)
    for by in (["g"], []):
        out = running_sums(df, by, ["i"], ["a", "b"], n_parts=9, ahead=["a"]).toPandas()
        assert len(out) == n
        parts = [x for _, x in out.groupby("g", dropna=False)] if by else [out]
        for x in parts:
            x = x.sort_values("i")
            if by and x.g.isna().all():
                continue        # the lookup of offsets is by value: a null group has none
            assert (x.cum_a == x.a.cumsum()).all() and np.allclose(x.cum_b, x.b.cumsum())
            assert (x.next_a.iloc[:-1].to_numpy() == x.a.iloc[1:].to_numpy()).all()
            assert np.isnan(x.next_a.iloc[-1])


def test_roc_corners_are_the_turning_points(spark):
    import numpy as np

    from cohort.operators import metrics as MT
    rng = np.random.default_rng(2)
    score = np.round(rng.normal(size=400), 2)
    y = (score + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(int(a), float(b), "m") for a, b in zip(y, score)], "y int, s double, g string")
    for by in ([], ["g"]):
        full = MT.roc_points(df, "y", "s", by).toPandas().sort_values("threshold", ascending=False)
        got = MT.roc_points(df, "y", "s", by, corners=True).toPandas().sort_values(
            "threshold", ascending=False, na_position="first")
        fps, tps = full.cum_neg.to_numpy(), full.cum_pos.to_numpy()
        keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
        assert got.cum_neg.tolist() == [0, *fps[keep]] and got.cum_pos.tolist() == [0, *tps[keep]]
        area = np.trapezoid(got.tpr, got.fpr)
        assert abs(area - MT.auc(df, "y", "s", by).first()["auc"]) < 1e-12 and len(got) < len(full)
