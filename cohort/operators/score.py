"""Scoring (C9, C10, S6): the fitted feature pipeline + matrix preparation
+ a fitted model (single, voting or stacking), applied to a batch, a single
record or a stream, saved and loaded as one folder."""

from __future__ import annotations

import importlib
import json
import os

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.operators.hist_trees import TreeModel
from cohort.operators.knn import KNNModel
from cohort.operators.logistic import LogisticModel
from cohort.operators.models import EXTRA, Prepared
from cohort.operators.pipeline import FeaturePipelineModel
from cohort.operators.scale import ScalerModel
from cohort.operators.selection import StackingModel, VotingModel

_LOADERS = {"lr": LogisticModel, "dt": TreeModel, "rf": TreeModel, "gb": TreeModel, "knn": KNNModel}


def _write_meta(path: str, meta: dict) -> None:
    SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").json(path)


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(path).first()["meta"])


def save_model(key: str, model, path: str) -> None:
    """Any model kind: ``vote`` and ``stack`` save their members beside them."""
    if key in ("vote", "stack"):
        meta = {"members": list(model.members)}
        if key == "vote":
            meta["voting"] = model.voting
        else:
            meta["meta_cols"] = model.meta_cols
            model.meta.save(os.path.join(path, "meta"))
        for k, m in model.members.items():
            save_model(k, m, os.path.join(path, "members", k))
        _write_meta(os.path.join(path, "ensemble"), meta)
    elif key in _LOADERS:
        model.save(path)
    else:  # a registered kind: the class it is loaded by is kept beside it
        cls = type(model)
        _write_meta(os.path.join(path, "kind"), {"module": cls.__module__, "name": cls.__qualname__})
        model.write().overwrite().save(os.path.join(path, "model"))


def load_model(spark: SparkSession, key: str, path: str):
    if key in ("vote", "stack"):
        meta = _read_meta(spark, os.path.join(path, "ensemble"))
        members = {k: load_model(spark, k, os.path.join(path, "members", k))
                   for k in meta["members"]}
        if key == "vote":
            return VotingModel(members, meta["voting"])
        return StackingModel(members, LogisticModel.load(spark, os.path.join(path, "meta")),
                             meta["meta_cols"])
    if key in _LOADERS:
        return _LOADERS[key].load(spark, path)
    if key not in EXTRA:
        raise ValueError(f"model key {key!r} is not registered")
    kind = _read_meta(spark, os.path.join(path, "kind"))
    cls = getattr(importlib.import_module(kind["module"]), kind["name"])
    return cls.load(os.path.join(path, "model"))


def per_row(model) -> bool:
    if hasattr(model, "members"):
        return all(per_row(m) for m in model.members.values())
    return not isinstance(model, KNNModel)


class Scorer:
    def __init__(self, features: FeaturePipelineModel, prepared: Prepared, key: str, model):
        self.features, self.prepared, self.key, self.model = features, prepared, key, model

    @property
    def per_row(self) -> bool:
        """True if scoring is an expression per row (no join, nothing written)."""
        return per_row(self.model)

    def score(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """Int prediction, positive probability and confidence (the larger
        class probability), with the id where the rows have one. A hard vote
        has no probability: both are null."""
        fm = self.features.transform(df)
        out = self.model.transform(self.prepared.apply(fm))
        if self.key in ("vote", "stack"):
            p1 = F.col(f"p1_{self.key}")
            confidence = F.greatest(p1, 1 - p1)
        else:
            probs = vector_to_array(F.col(f"prob_{self.key}"))
            p1, confidence = probs[1], F.array_max(probs)
        keep = [id_col] if id_col in out.columns else []
        return out.select(*keep, F.col(f"pred_{self.key}").cast("int").alias("prediction"),
                          p1.alias("p1"), confidence.alias("confidence"))

    def save(self, path: str) -> None:
        self.features.save(os.path.join(path, "features"))
        save_model(self.key, self.model, os.path.join(path, "model"))
        _write_meta(os.path.join(path, "prepared"), {
            "key": self.key, "columns": self.prepared.columns, "keep": self.prepared.keep,
            "means": self.prepared.scaler.means, "stds": self.prepared.scaler.stds})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        meta = _read_meta(spark, os.path.join(path, "prepared"))
        prep = Prepared(meta["columns"], ScalerModel(meta["means"], meta["stds"]), meta["keep"])
        feats = FeaturePipelineModel.load(spark, os.path.join(path, "features"))
        return cls(feats, prep, meta["key"],
                   load_model(spark, meta["key"], os.path.join(path, "model")))
