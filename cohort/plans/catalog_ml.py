"""Registered model queries (C, V, S6, R1). Their results depend on fitted
models, so they get the driver's rows-only check (no oracle SQL), except
``clf_knn_exact`` whose exact neighbours SQL can state.

Training data: the fitted feature matrix of the whole passenger-shaped view
with the exact stratified folds; the matrix is checkpointed once (shared
checkpoint folder) because every fit re-reads it.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.operators import aggregate as A
from cohort.operators import explain as X
from cohort.operators import selection as SEL
from cohort.operators.folds import hash_folds
from cohort.operators.kernel_shap import kernel_shapley
from cohort.operators.knn import KNNClassifier
from cohort.operators.models import (APP_GRIDS, DEFAULT_PARAMS, KEYS, MODEL_NAMES, fit_model,
                                     prepare, scored)
from cohort.operators.pipeline import FEATURE_NAMES
from cohort.operators.run import batch_run, matrix
from cohort.operators.score import Scorer
from cohort.operators.tree_shap import tree_shapley
from cohort.plans.catalog import passenger_view, query, view_pipeline
from cohort.session import scratch_dir
from cohort.sources.files import read_csv, read_table
from cohort.streaming.score_stream import read_scored, score_stream



def ml_data(spark: SparkSession, sf: str, k: int = 3):
    """(matrix with id, label, fold, features; fitted feature pipeline;
    prepared scaler): exact stratified folds on the feature rows themselves, in
    a layout that depends on the data only, written once because every fit
    re-reads it."""
    fp, prep, data = matrix(view_pipeline(), passenger_view(spark, sf), "label", "id", k)
    return data, fp, prep


def _predictions(spark, sf, key):
    data, _, _ = ml_data(spark, sf)
    m = fit_model(key, data)
    return scored(m, key, data, ["id", "label"])


@query("clf_logistic")
def clf_logistic(spark, sf):
    """L2 logistic regression, C=1."""
    return _predictions(spark, sf, "lr")


@query("clf_tree")
def clf_tree(spark, sf):
    """Gini tree, depth 5."""
    return _predictions(spark, sf, "dt")


@query("clf_forest")
def clf_forest(spark, sf):
    """C4: 100 trees, depth 7, sqrt features, seed 42."""
    return _predictions(spark, sf, "rf")


@query("clf_boosted")
def clf_boosted(spark, sf):
    """Boosted depth-3 trees, rate 0.1, logistic loss."""
    return _predictions(spark, sf, "gb")


def embeddings_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label",
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("clf_knn_exact")
def clf_knn_exact(spark, sf):
    """Exact 5-NN (Euclidean, uniform votes, tie -> smaller label),
    leave-one-out over every embedding."""
    e = embeddings_matrix(spark, sf)
    m = KNNClassifier(k=5, weights="uniform", id_col="id", exclude_self=True).fit(e)
    out = m.transform(e)
    return out.select(F.col("id").alias("vec_id"), "label",
                      F.col("pred_knn").cast("int").alias("prediction"))


@query("grid_search")
def grid_search(spark, sf):
    """V2: logistic C in {0.1, 1, 10}, 3 stratified folds, four metrics,
    refit on macro-F1."""
    data, _, _ = ml_data(spark, sf)
    table, _, _ = SEL.grid_search("lr", {"C": [0.1, 1.0, 10.0]}, data, 3)
    return table


def _knn_data(spark, sf):
    """Embeddings with three hashed folds: neighbours, folds and metrics are
    all exact, so SQL can state the whole selection."""
    return hash_folds(embeddings_matrix(spark, sf), "id", 3)


KNN_GRID = {"n_neighbors": [3, 5, 7], "weights": ["uniform"]}


def _rounded(df, *keep):
    return df.select(*[c if c in keep else F.round(F.col(c), 6).alias(c) for c in df.columns])


@query("knn_grid_search")
def knn_grid_search(spark, sf):
    """V2: k in {3, 5, 7}, 3 folds, four metrics, exact k-NN on embeddings."""
    t, _, _ = SEL.grid_search("knn", KNN_GRID, _knn_data(spark, sf), 3, refit=False)
    return _rounded(t, "model", "candidate", "params")


@query("knn_train_selected")
def knn_train_selected(spark, sf):
    """The chosen candidate over k-NN grids (first best macro-F1)."""
    t, _, _, _ = SEL.search_all({"knn": KNN_GRID}, _knn_data(spark, sf), 3)
    return t.where("chosen").select("model", "candidate", "params")


@query("knn_validation_curve")
def knn_validation_curve(spark, sf):
    """V9: training and validation macro-F1 by number of neighbours."""
    t = SEL.validation_curve("knn", "n_neighbors", [3, 5, 7], _knn_data(spark, sf), 3)
    return _rounded(t, "param_value")


def _results(spark, sf, names, folds=3):
    """CV scores of the default candidate of each model, all fitted together."""
    data, _, _ = ml_data(spark, sf, folds)
    rows = SEL.candidates({KEYS[n]: _one(KEYS[n]) for n in names}, data, folds)
    by = {r[0]: r[3:] for r in rows}
    return spark.createDataFrame(
        [(n, i, *by[KEYS[n]]) for i, n in enumerate(names)],
        "model string, position int, cv_f1_macro double, cv_accuracy double, "
        "cv_precision double, cv_recall double")


def _one(key):
    return {k: [v] for k, v in DEFAULT_PARAMS[key].items()}


@query("model_comparison")
def model_comparison(spark, sf):
    """The five models' CV scores, positive F1 only, best first."""
    return SEL.comparison(_results(spark, sf, MODEL_NAMES))


@query("select_best")
def select_best(spark, sf):
    """Argmax macro-F1 among the five base models (first wins a tie)."""
    return SEL.select_best(_results(spark, sf, MODEL_NAMES))


@query("train_selected")
def train_selected(spark, sf):
    """C11: the dashboard grids of all five models, the best one marked."""
    data, _, _ = ml_data(spark, sf)
    table, _, _, _ = SEL.search_all(APP_GRIDS, data, 3)
    return table


@query("ensemble_cv")
def ensemble_cv(spark, sf):
    """V3: stacking, soft and hard voting over the five models, 5 folds."""
    data, _, _ = ml_data(spark, sf, 5)
    return SEL.ensemble_cv(SEL.ENSEMBLES, [KEYS[n] for n in MODEL_NAMES], {}, data, 5)


@query("stacking")
def stacking(spark, sf):
    """5-fold out-of-fold probabilities of the five models -> logistic
    meta-learner."""
    data, _, _ = ml_data(spark, sf)
    m = SEL.fit_stacking([KEYS[n] for n in MODEL_NAMES], {}, data, 5)
    return m.transform(data).select("id", "label", F.col("pred_stack").cast("int").alias("prediction"),
                                    F.col("p1_stack").alias("p1"))


@query("learning_curve")
def learning_curve(spark, sf):
    """V8: five training sizes x 3 folds, logistic regression."""
    data, _, _ = ml_data(spark, sf)
    return SEL.learning_curve("lr", {}, data, 3)


# The parameter ranges of the validation curves.
CURVES = {"dt": ("max_depth", [2, 3, 5, 7, 10, 12]), "rf": ("max_depth", [3, 5, 7, 10, 12, 15]),
          "gb": ("n_estimators", [50, 100, 150, 200, 250])}


@query("validation_curve")
def validation_curve(spark, sf):
    """V9: tree and forest depth and boosting rounds, 5 folds."""
    data, _, _ = ml_data(spark, sf, 5)
    out = None
    for key, (param, values) in CURVES.items():
        t = SEL.validation_curve(key, param, values, data, 5).withColumn("model", F.lit(key))
        out = t if out is None else out.unionByName(t)
    return out


@query("feature_importance")
def feature_importance(spark, sf):
    """Forest importances, top 20."""
    data, _, _ = ml_data(spark, sf)
    m = fit_model("rf", data)
    rows = X.feature_importance(m, FEATURE_NAMES, top=20)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("shapley_linear")
def shapley_linear(spark, sf):
    """Exact margin attributions of the logistic model, every row."""
    data, _, _ = ml_data(spark, sf)
    m = fit_model("lr", data)
    return X.shapley_linear(m, data, data, FEATURE_NAMES, ["id"])


def _tree_attributions(spark, sf, key):
    data, _, _ = ml_data(spark, sf)
    bg = X.sample_rows(data, 100, 42, "id")
    return tree_shapley(fit_model(key, data), data, bg, FEATURE_NAMES, ["id"])


@query("shapley_tree")
def shapley_tree(spark, sf):
    """Exact attributions of the tree's probability for every row over
    100 background rows (sampled by seeded id hash)."""
    return _tree_attributions(spark, sf, "dt")


@query("shapley_forest")
def shapley_forest(spark, sf):
    """The same for the forest's probability."""
    return _tree_attributions(spark, sf, "rf")


@query("shapley_boosted")
def shapley_boosted(spark, sf):
    """The same for the boosted model's margin."""
    return _tree_attributions(spark, sf, "gb")


@query("shapley_sampled")
def shapley_sampled(spark, sf):
    """Sampled attributions of the logistic model's probability (the way
    for any model), 100 background rows, 100 explained rows (sampled by seeded
    id hash, as the dashboard explains at most 100), 2 * features + 2048
    coalitions."""
    data, _, _ = ml_data(spark, sf)
    bg = X.sample_rows(data, 100, 42, "id")
    rows = X.sample_rows(data, 100, 7, "id")
    return kernel_shapley(fit_model("lr", data), rows, bg, FEATURE_NAMES, ["id"])


@query("batch_run")
def batch_run_query(spark, sf):
    """The whole batch run in one call; returns the chosen model's submission."""
    v = passenger_view(spark, sf)
    out = scratch_dir(spark, f"run-{uuid.uuid4().hex}")
    r = batch_run(view_pipeline(), v, v.drop("label"), out)
    return read_csv(spark, f"{out}/submission", "id long, label int").withColumn(
        "model", F.lit(r.key))


@query("drilldown_features")
def drilldown_features(spark, sf):
    """Top-5 features by mean |attribution| -> profile keys;
    when any is found the configured profile rates are computed again (all
    keys, as the reference does), flagged by whether attribution chose them."""
    from cohort.plans.views import VIEW_ROLES
    data, _, _ = ml_data(spark, sf)
    m = fit_model("lr", data)
    att = X.shapley_linear(m, data, data, FEATURE_NAMES, ["id"])
    top = [r["feature"] for r in A.mean_abs_rank(att, FEATURE_NAMES, top=5).collect()]
    keys = X.drilldown([_REF_NAME[f] for f in top])
    if not keys:
        return spark.createDataFrame([], "key_name string, category string, rate double, "
                                         "selected boolean")
    rates = A.profile_rates(passenger_view(spark, sf), "label", A.passenger_keys(VIEW_ROLES))
    return rates.withColumn("selected", F.col("key_name").isin(*keys))


from cohort.operators.pipeline import FEATURES as _FEATURES  # noqa: E402

_REF_NAME = dict(_FEATURES)


@query("score_batch")
def score_batch(spark, sf):
    """Prediction, positive probability and confidence for every
    row of the view with the fitted pipeline + logistic model."""
    data, fp, prep = ml_data(spark, sf)
    m = fit_model("lr", data)
    return Scorer(fp, prep, "lr", m).score(passenger_view(spark, sf))


@query("persist_reload_score")
def persist_reload_score(spark, sf):
    """Save pipeline + scaler + model, load them back, score."""
    data, fp, prep = ml_data(spark, sf)
    m = fit_model("lr", data)
    path = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    Scorer(fp, prep, "lr", m).save(path)
    return Scorer.load(spark, path).score(passenger_view(spark, sf))


@query("stream_score")
def stream_score(spark, sf):
    """The view written as Parquet files, read as a stream and scored
    with a pipeline fitted in 'fitted' bin mode."""
    v = passenger_view(spark, sf)
    fp = view_pipeline(bins="fitted").fit(v)
    fm = fp.transform(v)
    prep = prepare(fm, FEATURE_NAMES, keep=["id", "label"])
    m = fit_model("lr", prep.apply(fm))
    base = scratch_dir(spark, f"stream-{uuid.uuid4().hex}")
    src = f"{base}/in"
    v.repartition(4).write.parquet(src)
    schema = ", ".join(f"{n} {t}" for n, t in v.dtypes)
    score_stream(spark, Scorer(fp, prep, "lr", m), src, schema, f"{base}/out", base)
    return read_scored(spark, f"{base}/out")


@query("sample_n")
def sample_n(spark, sf):
    """200 complete rows sampled by a seeded id hash."""
    cols = ["label", "pclass", "age", "sibsp", "parch", "fare"]
    v = passenger_view(spark, sf).select("id", *cols).na.drop("any", subset=cols)
    return X.sample_rows(v, 200, 42, "id")
