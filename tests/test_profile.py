import math

import numpy as np
import pandas as pd

from cohort.operators import profile as PR


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "s": rng.choice(["a", "b", "c"], 200)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    d = {r["column"]: r for r in PR.describe_all(df).collect()}
    exp = pdf["x"].describe()
    assert d["x"]["count"] == exp["count"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                         ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert abs(d["x"][ours] - exp[theirs]) < 1e-9
    vc = pdf["s"].value_counts()
    assert d["s"]["unique"] == 3 and d["s"]["freq"] == vc.max()
    assert d["s"]["top"] == sorted(vc[vc == vc.max()].index)[0]


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in PR.corr_pairwise(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert abs(got[("a", "b")] - np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]) < 1e-12
    vec = {(r["col_a"], r["col_b"]): r["corr"] for r in PR.corr_vector(df, ["a", "b", "c"]).collect()}
    assert vec[("c", "c")] is None and abs(vec[("a", "b")] - got[("a", "b")]) < 1e-9


def test_histogram_and_kde(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "h": rng.integers(0, 2, 500)}))
    h = PR.histogram(df, "x", "h", 30).toPandas()
    assert h["n"].sum() == 500 and h["bin"].max() == 29
    k = PR.kde(df, "x", ["h"], grid=50, cut=3).toPandas()
    # brute-force density of group 0, scaled by its share
    g0 = x[df.toPandas()["h"].to_numpy() == 0]
    bw = g0.std(ddof=1) * len(g0) ** -0.2
    row = k[(k["h"] == 0)].sort_values("grid_idx").iloc[10]
    exp = np.exp(-0.5 * ((row["x"] - g0) / bw) ** 2).sum() / (500 * bw * math.sqrt(2 * math.pi))
    assert abs(row["density"] - exp) < 1e-9


def test_box_stats(spark):
    x = np.array(list(range(1, 21)) + [100.0])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": 1}))
    b = PR.box_stats(df, "x", ["g"]).first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert (b["q1"], b["q3"]) == (q1, q3)
    assert b["n_outliers"] == 1 and b["whisker_hi"] == 20.0 and b["whisker_lo"] == 1.0
