import numpy as np
import pandas as pd
import pytest

from cohort.operators.quantiles import exact_quantiles, quantile_values

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]


def _data(n, seed):
    rng = np.random.default_rng(seed)
    # a value repeated on a third of the rows, plus ties and a continuous part
    v = np.concatenate([rng.normal(size=n), np.full(n // 2, 0.25), rng.integers(0, 5, n // 4) * 1.0])
    return pd.DataFrame({"g": rng.integers(0, 3, len(v)), "v": v})


@pytest.mark.parametrize("small", [1_000_000, 300, 40])
def test_global_matches_numpy(spark, small):
    pdf = _data(3000, 1)
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, "v", PROBS, small=small).toPandas().sort_values("q_idx")
    assert np.allclose(got["value"].to_numpy(), np.quantile(pdf["v"], PROBS), rtol=0, atol=1e-12)


@pytest.mark.parametrize("small", [1_000_000, 100])
def test_grouped_matches_pandas(spark, small):
    pdf = _data(2000, 2)
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, "v", PROBS, ["g"], small=small).toPandas().sort_values(["g", "q_idx"])
    exp = pdf.groupby("g")["v"].quantile(PROBS).to_numpy()
    assert np.allclose(got["value"].to_numpy(), exp, rtol=0, atol=1e-12)


def test_nulls_and_nan_ignored_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantile_values(df, "v", [0.5]) == [2.0]
    empty = spark.createDataFrame([], "v double")
    assert quantile_values(empty, "v", [0.5]) == [None]


@pytest.mark.parametrize("accuracy,small", [(10_000, 40), (2, 150)])
def test_several_rounds_and_a_useless_sketch(spark, accuracy, small, monkeypatch):
    """A coarse grid needs several rounds; a sketch of accuracy 2 gives bounds
    that do not narrow a bracket, which is then halved by value."""
    import cohort.operators.quantiles as Q
    monkeypatch.setattr(Q, "GRID", 8)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=500), np.full(300, 7.0), rng.random(400)])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(v)) % 3, "a", None), "v": v})
    df = spark.createDataFrame(pdf).coalesce(2)
    got = exact_quantiles(df, "v", [0.3, 0.5], ["g"], small=small, accuracy=accuracy).collect()
    for name in ("a", None):
        want = np.quantile(v[(pdf["g"] == name) if name else pdf["g"].isna()], [0.3, 0.5])
        mine = [r["value"] for r in sorted((r for r in got if r["g"] == name), key=lambda r: r["q_idx"])]
        assert np.allclose(mine, want, rtol=0, atol=1e-9)


def test_refinement_has_no_nested_loop(spark):
    df = spark.createDataFrame(_data(3000, 1))
    plan = exact_quantiles(df, "v", [0.5], small=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
