import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort.operators.pipeline import FEATURE_NAMES, FeaturePipeline, FeaturePipelineModel


def _passengers(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    titles = ["Mr", "Mrs", "Miss", "Master", "Dr", "Dona"]
    rows = []
    for i in range(n):
        rows.append((
            i + 1, int(rng.integers(0, 2)), int(rng.integers(1, 4)),
            f"Name{i}, {titles[i % len(titles)]}. X",
            "male" if i % 3 else "female",
            None if i % 7 == 0 else float(rng.integers(1, 80)),
            int(rng.integers(0, 3)), int(rng.integers(0, 3)),
            str(1000 + i % 30) if i % 2 else f"PC {100 + i % 5}",
            None if i == 5 else float(np.round(rng.exponential(30), 4)),
            None if i % 4 == 0 else f"{'ABCDEFGT'[i % 8]}{i}",
            None if i == 3 else "SCQ"[i % 3]))
    schema = ("PassengerId int, Survived int, Pclass int, Name string, Sex string, Age double, "
              "SibSp int, Parch int, Ticket string, Fare double, Cabin string, Embarked string")
    return spark.createDataFrame(rows, schema)


def test_output_shape_and_order(spark):
    df = _passengers(spark)
    out = FeaturePipeline().fit(df).transform(df)
    assert out.columns == ["PassengerId", "Survived"] + FEATURE_NAMES
    assert len(FEATURE_NAMES) == 37
    assert out.count() == 80


def test_partitioning_does_not_change_result(spark):
    df = _passengers(spark)
    m = FeaturePipeline().fit(df)
    a = m.transform(df.repartition(1)).orderBy("PassengerId").collect()
    b = m.transform(df.repartition(7)).orderBy("PassengerId").collect()
    m2 = FeaturePipeline().fit(df.repartition(5).orderBy(F.rand(1)))
    c = m2.transform(df).orderBy("PassengerId").collect()
    assert a == b == c


def test_unseen_values_fall_back(spark):
    df = _passengers(spark)
    m = FeaturePipeline().fit(df)
    new = spark.createDataFrame(
        [(1000, 2, "Zed, Rev. Q", "male", 40.0, 0, 0, "ZZZ 1", 10.0, "Q5", "X")],
        "PassengerId int, Pclass int, Name string, Sex string, Age double, SibSp int, Parch int, "
        "Ticket string, Fare double, Cabin string, Embarked string")
    r = m.transform(new).first()
    codes = m.state
    assert r["ticket_prefix_code"] == codes["codes_ticket_prefix"].index("OTHER")
    assert r["cabin_location_code"] == codes["codes_cabin_area"].index("Unknown")
    assert r["embarked_code"] == codes["codes_port"].index(codes["port_mode"])
    assert r["title_code"] == 5.0
    # one-row batch: the batch's quartile bin collapses to a single edge -> null
    assert r["fare_group"] is None and r["ticket_frequency"] == 1.0


def test_save_load_roundtrip(spark, tmp_path):
    df = _passengers(spark)
    m = FeaturePipeline().fit(df)
    m.save(str(tmp_path / "fp"))
    m2 = FeaturePipelineModel.load(spark, str(tmp_path / "fp"))
    assert m.transform(df).orderBy("PassengerId").collect() == \
        m2.transform(df).orderBy("PassengerId").collect()


def test_fitted_bins_mode_freezes_state(spark):
    df = _passengers(spark)
    m = FeaturePipeline(bins="fitted").fit(df)
    one = df.where("PassengerId = 2")
    r = m.transform(one).first()
    batch = m.transform(df).where("PassengerId = 2").first()
    assert r["fare_group"] == batch["fare_group"]
    assert r["ticket_frequency"] == batch["ticket_frequency"]


def test_absent_columns_get_defaults(spark):
    df = _passengers(spark).drop("Name", "Sex", "Embarked", "Ticket", "Cabin")
    r = FeaturePipeline().fit(df).transform(df).first()
    assert (r["title_code"], r["sex_code"], r["embarked_code"], r["ticket_frequency"],
            r["ticket_prefix_code"], r["has_cabin"]) == (1.0, 0.5, 0.0, 1.0, 0.0, 0.0)


def test_required_column_check(spark):
    from cohort.sources.files import require_columns
    with pytest.raises(ValueError):
        require_columns(_passengers(spark).drop("Survived"), "Survived")


@pytest.mark.parametrize("bins", ["batch", "fitted"])
def test_wanted_features_are_the_same_and_need_no_more(spark, bins):
    from cohort.operators.pipeline import STEPS, steps_of
    df = _passengers(spark, 90, 4)
    batch = _passengers(spark, 40, 5)
    full = FeaturePipeline(bins=bins).fit(df).transform(batch).toPandas().sort_values("PassengerId")
    for wanted in (("age", "fare", "age_sq", "age_fare", "fare_sq"), ("embarked_x_class",),
                   ("has_cabin", "title_code"), ("cabin_number", "is_alone"), DECK_FEATURES,
                   ("fare_group", "ticket_frequency")):
        m = FeaturePipeline(bins=bins, wanted=wanted).fit(df)
        out = m.transform(batch)
        assert [c for c in out.columns if c in FEATURE_NAMES] == [f for f in FEATURE_NAMES if f in wanted]
        got = out.toPandas().sort_values("PassengerId")
        for f in wanted:
            assert np.allclose(got[f].to_numpy(float), full[f].to_numpy(float), equal_nan=True), f
    poly = FeaturePipeline(bins=bins, wanted=("age", "fare")).fit(df)
    plan = poly.transform(batch)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert steps_of(["age"]) == {"medians"} and set(STEPS) == steps_of(FEATURE_NAMES)
    assert not any(k.startswith("codes_") for k in poly.state) and not poly.tables
    with pytest.raises(ValueError):
        FeaturePipeline(wanted=("nothing",)).fit(df)


DECK_FEATURES = ("fare_x_cabin_location_code", "ticket_prefix_code_x_class")
