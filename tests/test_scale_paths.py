"""The paths that only run on large inputs, forced with small thresholds and
compared with the small-input paths."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import cohort.operators.encode as EN
import cohort.operators.joins as J
from cohort.operators.pipeline import FeaturePipeline
from test_pipeline import _passengers


def test_hot_cold_split_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(3000) < 0.34, 0, rng.integers(1, 400, 3000))  # one key ~1/3 of rows
    pdf = pd.DataFrame({"id": np.arange(3000), "k": keys})
    pdf.loc[::97, "k"] = None
    df = spark.createDataFrame(pdf)
    small = J.attach_counts(df, "k", "n").orderBy("id").collect()
    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)   # count table "too big"
    monkeypatch.setattr(J, "HOT_KEYS_MAX", 50)     # hot threshold = 3000 // 50 = 60 rows
    big = J.attach_counts(df, "k", "n").orderBy("id").collect()
    assert small == big
    exp = pdf.groupby("k")["k"].transform("count")
    got = [r["n"] for r in big]
    assert all((g is None and pd.isna(e)) or g == e for g, e in zip(got, exp))


def test_class_table_path_equals_inline(spark, monkeypatch):
    df = _passengers(spark, 120, 2)
    inline = FeaturePipeline(rare_min=2).fit(df).transform(df).orderBy("PassengerId").collect()
    monkeypatch.setattr(EN, "INLINE_MAX", 1)
    import cohort.operators.pipeline as P
    monkeypatch.setattr(P, "INLINE_MAX", 1)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 1)    # and shuffle the lookups
    m = FeaturePipeline(rare_min=2).fit(df)
    assert any(not isinstance(m._codes(k), list) for k in ("ticket_prefix", "cabin_area", "port"))
    table = m.transform(df).orderBy("PassengerId").collect()
    assert inline == table


def test_lookup_join_shuffle_path(spark, monkeypatch):
    a = spark.range(100).withColumn("k", F.col("id") % 7)
    t = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    b1 = J.lookup_join(a, t, "k").orderBy("id").collect()
    monkeypatch.setattr(J, "BROADCAST_ROWS", 1)
    b2 = J.lookup_join(a, t, "k").orderBy("id").collect()
    assert b1 == b2


def test_folds_and_curve_number_ids_not_rows(spark, monkeypatch):
    """Fold positions and curve sizes come from ids alone; ids that are equal on both sides
    of a fold's or a size's end fall back to numbering the rows."""
    from cohort.operators import folds as FO
    from cohort.operators import selection as SEL
    seen = []
    for module, name in ((FO, "positions"), (SEL, "running_sums")):
        def spy(df, *a, _f=getattr(module, name), **b):
            seen.append(set(df.columns))
            return _f(df, *a, **b)
        monkeypatch.setattr(module, name, spy)
    rows = [(i, int(i % 3 == 0), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x double")
    got = FO.stratified_folds(df, "label", "id", 3)
    assert got.columns == ["label", "id", "x", "fold"] and seen == [{"label", "id"}]
    for c in (0, 1):
        own = sorted((r["id"], r["fold"]) for r in got.collect() if r["label"] == c)
        assert [f for _, f in own] == sorted(f for _, f in own)
    assert sorted(r["n"] for r in got.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [20, 20, 20]
    twice = FO.stratified_folds(spark.createDataFrame([(7, 1, 0.0)] * 9, "id long, label int, x double"),
                                "label", "id", 3)
    assert sorted(r["count"] for r in twice.groupBy("fold").count().collect()) == [3, 3, 3]
    assert seen[-1] == {"label", "id", "x"}
    # learning curve: the first n rows by id outside a fold
    fitted = []

    def fit(key, sub, params, label):
        fitted.append(sorted(r["id"] for r in sub.select("id").collect()))
    monkeypatch.setattr(SEL, "fit_model", fit)
    monkeypatch.setattr(SEL, "scored", lambda m, k, d, keep: d.select(*keep, F.lit(1).alias("prediction")))
    monkeypatch.setattr(SEL, "PARALLELISM", 1)
    data = df.withColumn("fold", F.when(F.col("id") > 0, (F.col("id") % 2).cast("int")))
    for frame in (data, data.withColumn("id", F.floor(F.col("id") / 4))):
        seen.clear(), fitted.clear()
        SEL.learning_curve("lr", {}, frame, 2, (0.5, 1.0)).collect()
        pdf = frame.toPandas()
        for at, (f, n) in enumerate((f, n) for f in (0, 1) for n in (15, 30)):
            own = sorted(pdf[pdf.fold.notna() & (pdf.fold != f)].id)
            assert fitted[at] == own[:n]
        assert seen[0] == {"id", "fold", "__in0", "__in1"}


def test_scaler_in_one_pass_equals_numpy(spark):
    """No aggregate over all columns: moments by task, merged; an equal column scales to 0,
    nulls are left out, a column of nulls stays."""
    from cohort.operators import scale
    r = np.random.default_rng(3)
    x = r.normal(1e6, 1e-2, 3000)
    rows = [(float(v), 0.1, None if i % 3 else float(i), None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    m = scale.fit_scaler(df, ["a", "b", "c", "d"])
    c = np.arange(0, 3000, 3.0)
    assert abs(m.means["a"] - x.mean()) < 1e-8 and abs(m.stds["a"] - x.std()) < 1e-10
    assert m.means["b"] == 0.1 and m.stds["b"] == 0.0
    assert abs(m.means["c"] - c.mean()) < 1e-9 and abs(m.stds["c"] - c.std()) < 1e-9
    assert m.means["d"] is None and m.stds["d"] is None
    assert scale._merged(scale.NONE, (2, 1.0, 0.5)) == (2, 1.0, 0.5)
