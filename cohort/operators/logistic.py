"""L2 logistic regression by Newton's method, many fits a pass.

The objective is 1/2 |w|^2 + C * (sum of log losses) with the intercept as one
more, equally penalised coefficient. A pass computes loss, gradient and the
weighted Gram matrix of every fit in one job; the step is solved on the driver
(a system of the number of features + 1). A step that does not lower the
objective is halved. About eight passes reach the optimum to rounding, for one
fit as for hundreds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.operators import shared_pass as SP


class LogisticModel:
    """Coefficients and intercept of a fitted model; scoring is a native
    expression."""

    def __init__(self, weights: np.ndarray, key: str = "lr", passes: int = 0):
        self.weights, self.key, self.passes = np.asarray(weights, float), key, passes

    @property
    def coefficients(self):
        return Vectors.dense(self.weights[:-1])

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        w = F.array(*[F.lit(float(v)) for v in self.weights[:-1]])
        dot = F.aggregate(F.zip_with(vector_to_array(features), w, lambda a, b: a * b), F.lit(0.0),
                          lambda a, b: a + b)
        z, p = f"__z_{self.key}", f"__p_{self.key}"
        out = df.withColumn(z, dot + F.lit(self.intercept)) \
            .withColumn(p, 1.0 / (1.0 + F.exp(-F.col(z))))
        return out.withColumns({
            f"raw_{self.key}": array_to_vector(F.array(-F.col(z), F.col(z))),
            f"prob_{self.key}": array_to_vector(F.array(1.0 - F.col(p), F.col(p))),
            f"pred_{self.key}": (F.col(z) > 0).cast("double")}).drop(z, p)

    def save(self, path: str) -> None:
        meta = json.dumps({"weights": [float(v).hex() for v in self.weights], "key": self.key})
        SparkSession.getActiveSession().createDataFrame([(meta,)], "meta string").coalesce(1) \
            .write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LogisticModel":
        m = json.loads(spark.read.json(path).first()["meta"])
        return cls(np.array([float.fromhex(v) for v in m["weights"]]), m["key"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


#: Rows whose sums are worked out at once.
ROWS_AT_ONCE = 8192


def partial_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """loss, gradient, Gram matrix (row by row) of some rows (all if None) at
    ``w``, a few at a time."""
    n, total = len(x) if rows is None else len(rows), np.zeros(1 + len(w) * (len(w) + 1))
    for s in range(0, n, ROWS_AT_ONCE):
        at = slice(s, s + ROWS_AT_ONCE) if rows is None else rows[s:s + ROWS_AT_ONCE]
        total += _sums(x[at], y[at], w)
    return total


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w[:-1] + w[-1]
    p = sigmoid(z)
    loss = np.sum(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))
    xb = np.column_stack([x, np.ones(len(x))])
    gram = xb.T @ (xb * (p * (1 - p))[:, None])
    return np.concatenate([[loss], xb.T @ (p - y), gram.ravel()])


class _Newton:
    """State of one fit on the driver."""

    def __init__(self, dims: int, c: float, tol: float, max_iter: int):
        self.c, self.tol, self.left = c, tol, max_iter
        self.good = self.trial = np.zeros(dims + 1)
        self.value, self.step, self.size, self.done = np.inf, None, 1.0, False
        self.passes = 0

    def advance(self, sums: np.ndarray) -> None:
        d = len(self.trial)
        self.passes += 1
        value = 0.5 * self.trial @ self.trial + self.c * sums[0]
        if self.step is not None and value > self.value + 1e-12 * abs(self.value):
            self.size /= 2
            if self.size < 1e-6:
                self.done = True
            self.trial = self.good + self.size * self.step
            return
        self.good, self.value, self.size = self.trial, value, 1.0
        grad = self.good + self.c * sums[1:d + 1]
        hess = np.eye(d) + self.c * sums[d + 1:].reshape(d, d)
        self.step = -np.linalg.solve(hess, grad)
        self.left -= 1
        self.done = self.left <= 0 or np.abs(self.step).max() <= self.tol * (1 + np.abs(self.good).max())
        self.trial = self.good + self.step
        if self.done and self.left > 0:
            self.good = self.trial  # a step this small is exact to rounding


def fit_many(data: DataFrame | SP.Packed, fits: Sequence[SP.Fit], key: str = "lr",
             label: str = "label", id_col: str = "id") -> list[LogisticModel]:
    """One model per fit (parameters C, tol, max_iter)."""
    fits = list(fits)
    packed = SP.pack(data, SP.split_columns(fits), label, id_col)
    size = 8 * (1 + (packed.dims + 1) * (packed.dims + 2))
    states = [_Newton(packed.dims, f.params["C"], f.params["tol"], f.params["max_iter"]) for f in fits]
    while open_ := [i for i, s in enumerate(states) if not s.done]:
        trials = {i: states[i].trial for i in open_}

        def work(block):
            for i, w in trials.items():
                yield i, partial_sums(block.x, block.y, w, block.rows(fits[i])).tobytes()
        got = SP.run_pass(packed, work, SP.Units(), len(open_), size * len(open_))
        for i, blob in got.items():
            states[i].advance(np.frombuffer(blob, np.float64))
    return [LogisticModel(s.good, key, s.passes) for s in states]
