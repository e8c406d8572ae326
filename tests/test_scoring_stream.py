import os
import tempfile

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohort.functions import text as T
from cohort.operators.aggregate import passenger_keys, profile_rates
from cohort.operators.models import fit_model, prepare
from cohort.operators.pipeline import FEATURE_NAMES, PASSENGER_ROLES, FeaturePipeline
from cohort.operators.score import Scorer
from cohort.session import cut_lineage, passing_checkpoints
from cohort.streaming.score_stream import read_scored, score_stream
from test_pipeline import _passengers


def _scorer(spark, bins):
    df = _passengers(spark, 120, 1)
    fp = FeaturePipeline(bins=bins).fit(df)
    fm = fp.transform(df)
    prep = prepare(fm, FEATURE_NAMES, keep=["PassengerId", "Survived"])
    m = fit_model("lr", prep.apply(fm).withColumnRenamed("Survived", "label"))
    return df, Scorer(fp, prep, "lr", m)


def test_stream_equals_batch(spark):
    df, sc = _scorer(spark, "fitted")
    base = tempfile.mkdtemp(prefix="cohort-stream-", dir="/tmp")
    df.repartition(3).write.parquet(f"{base}/in")
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    score_stream(spark, sc, f"{base}/in", schema, f"{base}/out", base, id_col="PassengerId")
    got = read_scored(spark, f"{base}/out").orderBy("PassengerId").collect()
    exp = sc.score(df, "PassengerId").orderBy("PassengerId").collect()
    assert got == exp


def test_single_record_with_text_nan(spark):
    df, sc = _scorer(spark, "fitted")
    rec = spark.createDataFrame(
        [(7777, 3, "Doe, Mr. John", "male", 30.0, 0, 0, "A/5 1", 7.25, "NaN", "S")],
        "PassengerId int, Pclass int, Name string, Sex string, Age double, SibSp int, Parch int, "
        "Ticket string, Fare double, Cabin string, Embarked string")
    rec = rec.withColumn("Cabin", T.text_null_marker("Cabin"))
    r = sc.score(rec, "PassengerId").first()
    assert r["prediction"] in (0, 1) and 0.5 <= r["confidence"] <= 1.0


def test_profile_rates_skips_absent(spark):
    df = _passengers(spark)
    keys = passenger_keys(PASSENGER_ROLES)
    full = {r["key_name"] for r in profile_rates(df, "Survived", keys).collect()}
    assert full == {"Sex", "Pclass", "Embarked", "AgeGroup", "FareGroup", "FamilyType", "Title_Grouped"}
    part = {r["key_name"] for r in profile_rates(df.drop("Name", "Fare"), "Survived", keys).collect()}
    assert part == full - {"FareGroup", "Title_Grouped"}


def test_record_without_id(spark):
    _, sc = _scorer(spark, "fitted")
    form = spark.createDataFrame(
        [(1, "Doe, Mrs. Jane", "female", 30.0, 1, 0, "113803", 53.1, "C123", "S")],
        "Pclass int, Name string, Sex string, Age double, SibSp int, Parch int, "
        "Ticket string, Fare double, Cabin string, Embarked string")
    out = sc.score(form, "PassengerId")
    assert out.columns == ["prediction", "p1", "confidence"] and out.count() == 1


def test_every_model_kind_saves_and_loads(spark, tmp_path):
    from cohort.operators import selection as SEL
    df = _passengers(spark, 120, 1)
    fp = FeaturePipeline(bins="fitted").fit(df)
    fm = fp.transform(df).withColumnRenamed("Survived", "label").withColumnRenamed("PassengerId", "id")
    prep = prepare(fm, FEATURE_NAMES, keep=["id", "label"])
    data = prep.apply(fm).cache()
    params = {"rf": {"n_estimators": 4}, "gb": {"n_estimators": 3}}
    kinds = {k: fit_model(k, data, params.get(k)) for k in ("lr", "dt", "knn", "rf", "gb")}
    kinds["vote"] = SEL.VotingModel({k: kinds[k] for k in ("lr", "dt", "knn")}, "soft")
    kinds["stack"] = SEL.fit_stacking(["lr", "dt"], {}, data, 3)
    batch = df.withColumnRenamed("PassengerId", "id")
    fp.state["roles"]["id"] = "id"
    for key, model in kinds.items():
        sc = Scorer(fp, prep, key, model)
        sc.save(str(tmp_path / key))
        again = Scorer.load(spark, str(tmp_path / key))
        a, b = (s.score(batch).orderBy("id").collect() for s in (sc, again))
        assert a == b and len(a) == 120, key


def test_batch_run_end_to_end(spark, tmp_path):
    from cohort.operators.run import batch_run
    from cohort.sources.files import read_csv
    df = _passengers(spark, 150, 2)
    r = batch_run(FeaturePipeline(), df, df.drop("Survived"), str(tmp_path), folds=3, background=10,
                  grids={"lr": {"C": [1.0]}, "dt": {"max_depth": [2, 3]}})
    assert r.key in ("lr", "dt") and r.comparison.count() == 3
    sub = read_csv(spark, str(tmp_path / "submission"), "PassengerId int, Survived int")
    assert sub.count() == 150 and r.attributions.count() == 150
    again = Scorer.load(spark, str(tmp_path / "model")).score(df.drop("Survived"), "PassengerId")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, r.predictions.collect()))
    assert set(r.profile_keys) <= {"AgeGroup", "FareGroup", "Sex", "Pclass", "Embarked"}


def test_models_that_write_their_rows_score_streams(spark):
    from cohort.operators import selection as SEL
    df = _passengers(spark, 90, 3)
    fp = FeaturePipeline(bins="fitted").fit(df)
    fm = fp.transform(df).withColumnRenamed("Survived", "label").withColumnRenamed("PassengerId", "id")
    prep = prepare(fm, FEATURE_NAMES, keep=["id", "label"])
    data = prep.apply(fm).cache()
    members = {k: fit_model(k, data) for k in ("lr", "knn")}
    kinds = {"knn": members["knn"], "vote": SEL.VotingModel(members, "soft"),
             "stack": SEL.fit_stacking(["dt", "knn"], {}, data, 3)}
    batch = df.withColumnRenamed("PassengerId", "id")
    fp.state["roles"]["id"] = "id"
    schema = ", ".join(f"{n} {t}" for n, t in batch.dtypes)
    assert Scorer(fp, prep, "lr", members["lr"]).per_row
    for key, model in kinds.items():
        sc = Scorer(fp, prep, key, model)
        assert not sc.per_row
        base = tempfile.mkdtemp(prefix="cohort-stream-", dir="/tmp")
        batch.repartition(2).write.parquet(f"{base}/in")
        score_stream(spark, sc, f"{base}/in", schema, f"{base}/out", base)
        assert read_scored(spark, f"{base}/out").orderBy("id").collect() == \
            sc.score(batch).orderBy("id").collect(), key


def test_batch_run_explains_a_knn_winner(spark, tmp_path):
    from cohort.operators.run import batch_run
    df = _passengers(spark, 80, 2)
    r = batch_run(FeaturePipeline(), df, df.drop("Survived"), str(tmp_path), folds=2, background=4,
                  grids={"knn": {"n_neighbors": [3]}}, kernel_rows=5)
    assert r.key == "knn" and r.attributions.count() == 5 and r.ranking.count() == len(FEATURE_NAMES)
    p1 = {x["PassengerId"]: x["p1"] for x in r.predictions.collect()}
    sums = {x["PassengerId"]: sum(x[n] for n in FEATURE_NAMES) for x in r.attributions.collect()}
    assert len({round(p1[i] - s, 9) for i, s in sums.items()}) == 1    # f(x) less the base, one for all


def test_batch_run_explains_against_every_training_row(spark, tmp_path):
    from cohort.operators import explain as X
    from cohort.operators import kernel_shap as K
    from cohort.operators.run import batch_run
    df = _passengers(spark, 150, 2)
    test = df.drop("Survived").where("PassengerId <= 130")
    grids = {"dt": {"max_depth": [3]}, "knn": {"n_neighbors": [3]}}
    for key in grids:
        small = key == "knn"
        train = df.where("PassengerId <= 40") if small else df
        r = batch_run(FeaturePipeline(), train, test.where("PassengerId <= 6") if small else test,
                      str(tmp_path / key), folds=2, grids={key: grids[key]})
        assert r.key == key and r.attributions.count() == (6 if small else 130)
        # attributions sum to f(x) less the mean of f over all training rows
        base = r.scorer.score(train.drop("Survived"), "PassengerId").toPandas()["p1"].mean()
        p1 = {x["PassengerId"]: x["p1"] for x in r.predictions.collect()}
        for x in r.attributions.collect():
            assert abs(p1[x["PassengerId"]] - base - sum(x[n] for n in FEATURE_NAMES)) < 1e-6, key
    rows, bg = X.sample_rows(_features(spark), 4, 1, "id"), X.sample_rows(_features(spark), 5, 2, "id")
    m = fit_model("knn", _features(spark))
    got = []
    for n in (K.JOB_ROWS, 60):      # in one job, and in several
        old, K.JOB_ROWS = K.JOB_ROWS, n
        got.append(K.kernel_shapley(m, rows, bg, ["a", "b", "c"], ["id"], key="knn").toPandas()
                   .sort_values("id").to_numpy())
        K.JOB_ROWS = old
    assert np.allclose(*got)
    # a job leaves no checkpoint behind
    with passing_checkpoints(spark):
        own = cut_lineage(spark.range(3).toDF("a"))
        at = own._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
        assert os.path.exists(at) and own.count() == 3
    assert not os.path.exists(at)


def _features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    return spark.createDataFrame([(i, int(v.sum() > 0), Vectors.dense(v)) for i, v in enumerate(x)],
                                 ["id", "label", "features"])
