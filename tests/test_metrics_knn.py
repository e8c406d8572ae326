import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohort.operators import metrics as MT
from cohort.operators.knn import KNNClassifier, KNNModel


def test_macro_metrics_zero_division(spark):
    y = [0, 0, 1, 1, 2, 2]
    p = [0, 1, 1, 1, 0, 0]   # class 2 never predicted -> precision 0 for it
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    r = MT.classification_metrics(df, "y", "p").first()
    prec = [1 / 3, 2 / 3, 0.0]
    rec = [0.5, 1.0, 0.0]
    f1 = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(prec, rec)]
    assert abs(r["accuracy"] - 0.5) < 1e-12
    assert abs(r["precision_macro"] - np.mean(prec)) < 1e-12
    assert abs(r["recall_macro"] - np.mean(rec)) < 1e-12
    assert abs(r["f1_macro"] - np.mean(f1)) < 1e-12
    cm = MT.confusion(df, "y", "p", classes=[0, 1, 2]).toPandas()
    assert len(cm) == 9 and cm["n"].sum() == 6


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.9, 0.2, 0.4), (0, 0, 1, 0.5, 0.5, 0.5)],
                               "a int, b int, c int, pa double, pb double, pc double")
    r = df.select(MT.hard_vote(["a", "b", "c"]).alias("h"),
                  MT.soft_vote(["pa", "pb", "pc"])[1].alias("s")).collect()
    assert [(x["h"], x["s"]) for x in r] == [(1, 0), (0, 0)]


def _brute_knn(X, y, k, exclude_self):
    out = []
    for i in range(len(X)):
        d = ((X - X[i]) ** 2).sum(axis=1)
        idx = [j for j in np.lexsort((np.arange(len(X)), d)) if not (exclude_self and j == i)][:k]
        vals, counts = np.unique(y[idx], return_counts=True)
        out.append(vals[np.argmax(counts)])
    return np.array(out)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    X = rng.integers(0, 4, size=(150, 3)).astype(float)  # many exact ties
    y = rng.integers(0, 3, 150)
    pdf = pd.DataFrame({"id": np.arange(150), "label": y, "f": list(X)})
    df = spark.createDataFrame(pdf).select("id", "label", array_to_vector(F.col("f")).alias("features"))
    for excl in (True, False):
        m = KNNClassifier(k=5, exclude_self=excl).fit(df)
        got = m.transform(df).orderBy("id").select("pred_knn").toPandas()["pred_knn"].to_numpy()
        assert (got == _brute_knn(X, y, 5, excl)).all()


def test_knn_multi_block_same_answer(spark, monkeypatch):
    import cohort.operators.knn as K
    rng = np.random.default_rng(8)
    X = rng.normal(size=(120, 4))
    y = rng.integers(0, 2, 120)
    pdf = pd.DataFrame({"id": np.arange(120), "label": y, "f": list(X)})
    df = spark.createDataFrame(pdf).select("id", "label", array_to_vector(F.col("f")).alias("features"))
    one = KNNClassifier(k=3).fit(df).transform(df).orderBy("id").select("pred_knn").collect()
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)  # forces several blocks and query groups
    many = KNNClassifier(k=3).fit(df)
    assert len(many.base.bounds.block) > 1
    assert many.transform(df).orderBy("id").select("pred_knn").collect() == one


def test_knn_string_ids_repeats_extra_columns_and_save(spark, tmp_path):
    rng = np.random.default_rng(9)
    X = rng.integers(0, 3, size=(60, 2)).astype(float)
    pdf = pd.DataFrame({"id": [f"r{i % 50:02d}" for i in range(60)], "label": rng.integers(0, 2, 60),
                        "f": list(X), "note": [None, "x"] * 30})
    df = spark.createDataFrame(pdf).select(
        "id", "label", "note", array_to_vector(F.col("f")).alias("features"),
        array_to_vector(F.col("f")).alias("other"))
    m = KNNClassifier(k=3, weights="distance").fit(df)
    out = m.transform(df)
    assert out.columns == [*df.columns, "pred_knn", "prob_knn"] and out.count() == 60
    assert sorted((r.id, r.note or "", tuple(r.other)) for r in out.collect()) == \
        sorted((r.id, r.note or "", tuple(r.other)) for r in df.collect())
    m.save(str(tmp_path / "knn"))
    again = KNNModel.load(spark, str(tmp_path / "knn")).transform(df)
    key = lambda r: (r.id, r.label, tuple(r.features), r.pred_knn, tuple(r.prob_knn))
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))
    assert m.transform(df.where("false")).collect() == []


def _clusters(spark, n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dims)) * 6
    own = rng.integers(0, 10, n)
    X = centre[own] + rng.normal(size=(n, dims)) * 0.5
    X[:n // 3] = X[0]                       # a third of the rows are one vector
    y = (own + rng.integers(0, 2, n)) % 3
    pdf = pd.DataFrame({"id": np.arange(n), "label": y, "f": list(X)})
    return X, y, spark.createDataFrame(pdf).select("id", "label", array_to_vector(F.col("f")).alias("features"))


def test_knn_skips_blocks_and_splits_frequent_vectors(spark, monkeypatch):
    import cohort.operators.knn as K
    X, y, df = _clusters(spark, 900, 4)
    monkeypatch.setattr(K, "BLOCK_ROWS", 30)
    m = KNNClassifier(k=5, exclude_self=True).fit(df)
    b = m.base.bounds
    assert b.rows.sum() == 900 and b.rows.max() <= 4 * 30 and len(b.block) >= 20
    # a query of the clusters meets few of the blocks
    q = X[300:]
    d = np.sort(K.squared(q, X), axis=1)[:, 5]
    met = (b.lower(q) <= d[:, None] + 1e-9).sum(axis=1)
    assert met.mean() < 0.3 * len(b.block)
    out = m.transform(df).orderBy("id").select("pred_knn").toPandas()["pred_knn"].to_numpy()
    assert (out == _brute_knn(X, y, 5, True)).all()


def test_knn_bounds_are_safe():
    import cohort.operators.knn as K
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1.0, 1e6):
        x = rng.normal(size=(300, 6)) * scale + 10 * scale
        p = K.Partition.fit(x[:100], 12)
        b = p.block(x)
        d = np.sqrt(K.squared(x, p.pivots))
        rows = [x[b == i] for i in np.unique(b)]
        ring = [d[b == i] for i in np.unique(b)]
        bounds = K.Bounds(np.unique(b), np.array([len(r) for r in rows]), *(
            np.array([f(r, axis=0) for r in src]) for src in (rows, ring) for f in (np.min, np.max)),
            p.pivots)
        low = bounds.lower(x)
        for i, r in enumerate(rows):
            true = ((x[:, None, :] - r[None, :, :]) ** 2).sum(axis=2).min(axis=1)
            assert (low[:, i] <= true + 1e-300).all()


def test_knn_tree_reaches_fewer_rows_than_pivots():
    """Mixed discrete and continuous features: median cuts leave out more than the
    cells of pivots, and the neighbours of a query lie in blocks that its bounds reach."""
    from cohort.operators import knn as K
    r = np.random.default_rng(5)
    x = np.column_stack([*(r.integers(0, n, 6000) for n in (2, 3, 4, 5, 8)), *r.random((4, 6000)) * 6.0]).astype(float)
    p = K.Partition.best(x, 60)
    cells = K.Partition.fit(x[:K.SAMPLE_ROWS], 60)
    assert len(p.tree) and p.reached(x) < 0.6 * cells.reached(x)
    b = p.block(x)
    leaves = p.tree[p.tree[:, 0] < 0, 2]
    assert sorted(leaves) == list(range(len(leaves))) and set(b) <= set(leaves.astype(int))
    n = np.unique(b)
    d = np.sqrt(K.squared(x, p.pivots))
    bounds = K.Bounds(n, np.bincount(b)[n], *(np.array([f(v[b == j], axis=0) for j in n]) for v in (x, d)
                                              for f in (np.min, np.max)), p.pivots, p.tree)
    q = x[:50] + 1e-3
    exact = ((q[:, None, :] - x[None]) ** 2).sum(axis=2)
    kth = np.sort(exact, axis=1)[:, 4]
    low = bounds.lower(q)
    for i in range(len(q)):
        asked = set(n[low[i] <= kth[i]])
        assert set(b[exact[i] <= kth[i]]) <= asked
    assert set(bounds.home(q)) <= set(n)
    # alike rows are one leaf; a leaf without rows takes the number of the next
    assert len(K.median_tree(np.ones((9, 2)), 4)) == 1
    moved = K._renumbered(p.tree, [(0, 0, 2), *((j, j + 1, 1) for j in range(2, len(leaves)))])
    assert moved[moved[:, 0] < 0, 2].tolist()[:3] == [0, 3, 3]



def test_knn_views_share_the_neighbours(spark):
    X, y, df = _clusters(spark, 200, 3)
    m = KNNClassifier(k=7).fit(df)
    models = [m.cut(k, w) for k in (1, 3, 7) for w in ("uniform", "distance")]
    out, got = m.views(df, models)
    frame = out.select("id", *[p.alias(f"p{i}") for i, (p, _) in enumerate(got)]).orderBy("id").toPandas()
    for i, v in enumerate(models):
        alone = v.transform(df).orderBy("id").select("pred_knn").toPandas()["pred_knn"]
        assert (frame[f"p{i}"] == alone).all()


def test_knn_training_rows_move_once_a_group(spark, monkeypatch):
    """No groups of neighbours: every query asks for most blocks, but their rows
    move once for each group of queries, and the answer is that of all pairs."""
    import cohort.operators.knn as K
    rng = np.random.default_rng(4)
    X = rng.integers(-2, 3, size=(600, 12)) * 1.5       # many equal distances
    y = rng.integers(0, 3, 600)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "label": y, "f": list(X)})).select(
        "id", "label", array_to_vector(F.col("f")).alias("features"))
    for name, value in (("BLOCK_ROWS", 20), ("GROUPS", 4), ("PIECE_BYTES", 500), ("HELD", 50)):
        monkeypatch.setattr(K, name, value)
    m = KNNClassifier(k=5, exclude_self=True).fit(df)
    moved = []
    body = K._Group.meet
    sizes = m.base.grouped(df.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("b")))[1]
    assert sizes == 4
    monkeypatch.setattr(K._Group, "meet", lambda self, b, t: (moved.append(b), body(self, b, t))[1])
    out = m.transform(df).orderBy("id").select("pred_knn").toPandas()["pred_knn"].to_numpy()
    assert (out == _brute_knn(X, y, 5, True)).all()
    pieces = m.base.pieces()
    assert pieces.agg(F.sum(F.size("tid"))).first()[0] == 600 and pieces.count() < 600
