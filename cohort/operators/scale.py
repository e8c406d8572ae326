"""Standardisation with the population standard deviation (the
reference's scaler), fitted in one pass; a constant column scales
to 0. ML's ``StandardScaler`` uses the sample std, so it is not used."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ScalerModel:
    means: dict
    stds: dict

    def column(self, c: str) -> Column:
        m, s = self.means.get(c), self.stds.get(c)
        x = F.col(c).cast("double")
        if m is None:
            return x
        if not s:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(m)) / F.lit(s)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        cols = [c for c in self.means if c in df.columns]
        return df.select(*keep, *[self.column(c).alias(c) for c in cols])


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """Mean and population std of every column in one pass: a task sends its
    columns' counts, means and squared deviations, which are merged in the tasks'
    order. (One aggregate of many columns is too wide for generated code.)"""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [NONE] * len(cols)
        for b in batches:
            for i in range(len(cols)):
                x = b.column(i).drop_null().to_numpy()
                if len(x):
                    sums[i] = _merged(sums[i], _moments(x))
        n, mean, dev = zip(*sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.list_(pa.int64())),
             pa.array([mean], pa.list_(pa.float64())), pa.array([dev], pa.list_(pa.float64()))],
            ["part", "n", "mean", "dev"])
    total = [NONE] * len(cols)
    if cols:
        src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
        parts = src.mapInArrow(run, "part int, n array<long>, mean array<double>, dev array<double>")
        for r in sorted(parts.collect(), key=lambda r: r["part"]):  # one per task
            total = [_merged(t, s) for t, s in zip(total, zip(r["n"], r["mean"], r["dev"]))]
    return ScalerModel({c: mean if n else None for c, (n, mean, _) in zip(cols, total)},
                       {c: float(np.sqrt(dev / n)) if n else None for c, (n, _, dev) in zip(cols, total)})


#: (rows, mean, sum of squared deviations) of no rows.
NONE = (0, 0.0, 0.0)


def _moments(x: np.ndarray) -> tuple[int, float, float]:
    """Taken from the first value on, so that equal values deviate by exactly 0."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = x - x[0]
        mean = d.mean()
        d -= mean
        return len(x), float(x[0] + mean), float(d @ d)


def _merged(a: tuple, b: tuple) -> tuple[int, float, float]:
    if not a[0] or not b[0]:
        return b if b[0] else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n
