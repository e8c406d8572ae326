"""Classifiers (C1-C5) by key, with the reference's hyper-parameters, and the
shared matrix preparation (P4 align, N7 fill 0, E4 population-std scaling,
vector assembly).

``fit_all`` trains many fits of a kind (candidates x folds) at once: logistic
regression and the tree kinds in shared passes over one packed matrix, k-NN and
registered kinds one by one. Every model writes its own ``pred_<name>`` / ``prob_<name>`` columns so
several models can be applied to the same frame one after another (voting,
stacking) without joining prediction sets back together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators import hist_trees, logistic
from cohort.operators.scale import ScalerModel, fit_scaler
from cohort.operators.shared_pass import Fit, Packed

SEED = 42
#: Rows of a training matrix per partition: its layout follows from the data
#: alone, so a seeded fit is the same on any number of cores.
ROWS_PER_PARTITION = 250_000
LEAST_PARTITIONS = 8
# Model names and order, hyper-parameters, dashboard grids.
MODEL_NAMES = ("Logistic Regression", "Decision Tree", "KNN", "Random Forest", "XGBoost")
KEYS = {"Logistic Regression": "lr", "Decision Tree": "dt", "KNN": "knn",
        "Random Forest": "rf", "XGBoost": "gb"}

DEFAULT_PARAMS = {
    "lr": {"C": 1.0, "max_iter": 1000, "tol": 1e-10},
    "dt": {"max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "rf": {"n_estimators": 100, "max_depth": 7, "min_samples_split": 2, "min_samples_leaf": 1},
    "gb": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0},
}
APP_GRIDS = {
    "lr": {"C": [0.1, 1.0, 10.0]},
    "dt": {"max_depth": [3, 5, 7], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "rf": {"n_estimators": [100], "max_depth": [5, 7]},
    "gb": {"n_estimators": [100], "max_depth": [3, 5]},
}


def settle(data: DataFrame, id_col: str = "id") -> DataFrame:
    """The matrix in a layout that depends on its rows only: hashed by id into
    a number of partitions given by the row count, sorted by id in each. Seeded
    fits draw per partition, so this keeps them alike on any cluster."""
    n = max(LEAST_PARTITIONS, -(-data.count() // ROWS_PER_PARTITION))
    return data.repartition(n, id_col).sortWithinPartitions(id_col)


#: Further model kinds: key -> (default parameters, factory(params, columns)).
EXTRA: dict = {}


def register(key: str, defaults: dict, factory) -> None:
    """make an estimator known under a key of its own. ``factory(params,
    columns)`` returns a Spark ML style estimator that writes the columns named
    in ``columns`` (featuresCol, labelCol, predictionCol, probabilityCol,
    rawPredictionCol); it then takes part in grids, ensembles and curves."""
    if key in DEFAULT_PARAMS:
        raise ValueError(f"model key {key!r} is taken")
    DEFAULT_PARAMS[key] = dict(defaults)
    EXTRA[key] = factory


@dataclass
class Prepared:
    """Fitted preparation: column list, scaler; ``apply`` aligns, fills 0,
    scales and assembles ``features``."""
    columns: list
    scaler: ScalerModel
    keep: list = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        aligned = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
                   else F.lit(0.0).alias(c) for c in self.columns]
        keep = [c for c in self.keep if c in df.columns]
        base = df.select(*keep, *aligned)
        scaled = base.select(*keep, *[self.scaler.column(c).alias(c) for c in self.columns])
        return VectorAssembler(inputCols=self.columns, outputCol="features").transform(scaled) \
            .select(*keep, "features")


def prepare(train: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> Prepared:
    cols = list(columns)
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return Prepared(cols, fit_scaler(filled, cols), list(keep))


SHARED = ("lr", "dt", "rf", "gb")


def checked(key: str, params: dict | None = None) -> dict:
    """All parameters of a key; an unknown one is an error."""
    p = dict(DEFAULT_PARAMS[key])
    unknown = set(params or {}) - set(p)
    if unknown:
        raise ValueError(f"{key} has no parameter {sorted(unknown)}; it has {sorted(p)}")
    return p | (params or {})


def estimator(key: str, params: dict | None = None, label: str = "label"):
    """Estimator of a kind that is fitted one by one (k-NN, registered kinds)."""
    p = checked(key, params)
    if key == "knn":
        from cohort.operators.knn import KNNClassifier
        return KNNClassifier(k=p["n_neighbors"], weights=p["weights"], key=key, label=label)
    return EXTRA[key](p, {"featuresCol": "features", "labelCol": label,
                          "predictionCol": f"pred_{key}", "probabilityCol": f"prob_{key}",
                          "rawPredictionCol": f"raw_{key}"})


def fit_all(key: str, data: DataFrame | Packed, fits: Sequence[Fit], label: str = "label",
            id_col: str = "id") -> list:
    """A fitted model per fit; kinds in ``SHARED`` also take a packed matrix."""
    fits = [Fit(checked(key, f.params), f.out) for f in fits]
    if key == "lr":
        return logistic.fit_many(data, fits, key, label, id_col)
    if key in SHARED:
        return hist_trees.fit_many(key, data, fits, key, SEED, label, id_col)
    from cohort.operators.selection import run_parallel

    def one(f: Fit):
        rows = data
        for c, v in f.out:
            rows = rows.where(F.coalesce(F.col(c) != F.lit(v), F.lit(True)))
        return estimator(key, f.params, label).fit(rows)
    if key == "knn":  # the partition of the rows serves every candidate
        outs = list(dict.fromkeys(f.out for f in fits))
        bases = dict(zip(outs, run_parallel(lambda o: one(Fit(DEFAULT_PARAMS[key], o)), outs)))
        return [bases[f.out].cut(f.params["n_neighbors"], f.params["weights"]) for f in fits]
    return run_parallel(one, fits)


def positive_prob(key: str):
    """Probability of class 1 as a double column."""
    return vector_to_array(F.col(f"prob_{key}")).getItem(1)


def fit_model(key: str, train: DataFrame, params: dict | None = None, label: str = "label"):
    return fit_all(key, train, [Fit(params or {})], label)[0]


def scored(model, key: str, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., prediction, p1) of one fitted model."""
    out = model.transform(df)
    return out.select(*keep, F.col(f"pred_{key}").cast("int").alias("prediction"),
                      positive_prob(key).alias("p1"))
