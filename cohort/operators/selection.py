"""Model selection.

Cross-validation uses a fold column (exact stratified or hashed). All candidates
and folds of a kind are fitted together (``models.fit_all``), and the rows are
scored by all of them in one pass: a *slot* names, for every row, the model
that scores it (the one that has not seen the row's fold), and a row's
predictions for all slots leave the task as one array. All four metrics come
from one confusion-table aggregate (the reference refits once per metric).
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators import hist_trees
from cohort.operators import metrics as MT
from cohort.operators import shared_pass as SP
from cohort.operators.folds import _fold_bounds, stratified_folds
from cohort.operators.models import (DEFAULT_PARAMS, KEYS, SHARED, checked, fit_all, fit_model,
                                     positive_prob, scored, settle)
from cohort.operators.ordering import running_sums
from cohort.session import cut_lineage

METRICS = ("f1_macro", "accuracy", "precision_macro", "recall_macro")
# Independent fits are submitted from this many driver threads (like
# CrossValidator's ``parallelism``); each fit is itself a distributed job.
PARALLELISM = 8


def run_parallel(fn, items, parallelism: int | None = None) -> list:
    """Apply ``fn`` to every item from a small driver thread pool; results
    keep the item order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    n = max(1, min(parallelism or PARALLELISM, len(items)))
    if n == 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=n) as pool:
        return list(pool.map(fn, items))
ENSEMBLES = ("Stacking", "Voting Soft", "Voting Hard")


def grid(params: dict) -> list[dict]:
    keys = list(params)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[params[k] for k in keys])]


def fit_keys(jobs: dict[str, list[SP.Fit]], data: DataFrame, label: str = "label",
             id_col: str = "id") -> dict[str, list]:
    """The models of several kinds: the matrix is packed and binned once, and
    the kinds train side by side."""
    shared = [k for k in jobs if k in SHARED]
    packed = None
    if shared:
        packed = SP.pack(data, SP.split_columns([f for k in shared for f in jobs[k]]), label, id_col)
        if set(shared) - {"lr"}:
            hist_trees.bin_matrix(packed)
    models = run_parallel(lambda k: fit_all(k, packed if k in SHARED else data, jobs[k], label, id_col),
                          list(jobs))
    return dict(zip(jobs, models))


def slot_scores(slots: list, data: DataFrame, name: str) -> DataFrame:
    """``data`` with an array column of each slot's positive probability. A
    slot is (column, {value: model}), or (None, model) for all rows; a row
    without a model in a slot gets null."""
    cols = list(dict.fromkeys(c for c, _ in slots if c))
    sent = data.sparkSession.sparkContext.broadcast(slots)  # sized by the models

    def score(f: pa.Array, *by: pa.Array) -> pa.Array:
        x = SP.matrix(f)
        values = {c: v.fill_null(-1).to_numpy(zero_copy_only=False) for c, v in zip(cols, by)}
        out = np.full((len(x), len(sent.value)), np.nan)
        groups: dict = {}  # the slots that are cuts of one fit on the same rows
        for s, (col, models) in enumerate(sent.value):
            for v, m in ([(None, models)] if col is None else models.items()):
                groups.setdefault((col, v, id(getattr(m, "all_trees", m))), []).append((s, m))
        for (col, v, _), own in groups.items():
            rows = slice(None) if col is None else np.flatnonzero(values[col] == v)
            part = x[rows]
            if len(part):
                models = [m for _, m in own]
                got = models[0].probas(part, models) if hasattr(models[0], "probas") else \
                    [m.proba(part) for m in models]
                for (s, _), p in zip(own, got):
                    out[rows, s] = p
        flat = pa.array(out.ravel(), from_pandas=True)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1], flat)
    udf = F.arrow_udf(score, "array<double>")
    return data.withColumn(name, udf(vector_to_array("features"), *[F.col(c).cast("int") for c in cols]))


def slot_predictions(key: str, slots: list, data: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., slot, prediction, p1): one row per row and slot that has a
    model for it."""
    if key in SHARED:
        scored = slot_scores(slots, data, "__p")
        return scored.select(*keep, F.posexplode("__p").alias("slot", "p1")).where("p1 IS NOT NULL") \
            .select(*keep, "slot", (F.col("p1") > 0.5).cast("int").alias("prediction"), "p1")
    # the slots that share their rows and what is costly in their model
    groups: dict = {}
    for s, (col, models) in enumerate(slots):
        for v, m in (models.items() if col else [(None, models)]):
            groups.setdefault((col, v, id(getattr(m, "base", m))), []).append((s, m))

    def one(group):
        (col, v, _), members = group
        rows = data if col is None else data.where(F.col(col) == v)
        first = members[0][1]
        if hasattr(first, "views"):
            out, got = first.views(rows, [m for _, m in members], keep)
        else:
            out = first.transform(rows)
            got = [(F.col(f"pred_{key}"), positive_prob(key))]
        return out.select(*keep, F.inline(F.array(*[
            F.struct(F.lit(s).alias("slot"), pred.cast("int").alias("prediction"), p.alias("p1"))
            for (s, _), (pred, p) in zip(members, got)])))
    parts = run_parallel(one, list(groups.items()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_fold(params: list[dict], folds: int, fold_col: str = "fold") -> list[SP.Fit]:
    return [SP.Fit(p, ((fold_col, f),)) for p in params for f in range(folds)]


def _fold_slots(models: list, folds: int, fold_col: str = "fold") -> list:
    """A slot per candidate: each fold is scored by the model that left it out."""
    return [(fold_col, dict(enumerate(models[i:i + folds]))) for i in range(0, len(models), folds)]


def cv_predictions(key: str, params: dict, data: DataFrame, folds: int, label: str = "label",
                   fold_col: str = "fold", id_col: str = "id") -> DataFrame:
    """Out-of-fold predictions of one candidate: (fold, id, label, prediction, p1)."""
    models = fit_keys({key: _by_fold([params], folds, fold_col)}, data, label, id_col)[key]
    return slot_predictions(key, _fold_slots(models, folds, fold_col), data,
                            [fold_col, id_col, label]).drop("slot")


def cv_scores(preds: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of the four metrics, per group of ``by``."""
    per_fold = MT.classification_metrics(preds, label, "prediction", list(by) + ["fold"])
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS],
                                     *[F.stddev_pop(m).alias(f"{m}_std") for m in METRICS])


RESULT = ("model string, candidate int, params string, f1_macro double, accuracy double, "
          "precision_macro double, recall_macro double")


def candidates(grids: dict, data: DataFrame, folds: int, label: str = "label") -> list[tuple]:
    """(key, candidate, params, metrics...) of every candidate of every kind,
    in grid order."""
    cands = {k: grid(g) for k, g in grids.items()}
    models = fit_keys({k: _by_fold(c, folds) for k, c in cands.items()}, data, label)
    preds = None
    for k in grids:
        p = slot_predictions(k, _fold_slots(models[k], folds), data, ["fold", label]) \
            .withColumn("model", F.lit(k))
        preds = p if preds is None else preds.unionByName(p)
    rows = cv_scores(preds, label, ["model", "slot"]).collect()  # one per candidate
    got = {(r["model"], r["slot"]): r for r in rows}
    return [(k, i, str(p), *[float(got[k, i][m]) for m in METRICS])
            for k in grids for i, p in enumerate(cands[k])]


def _best(rows: list[tuple]) -> int:
    """The highest macro-F1, the first of equals."""
    return max(range(len(rows)), key=lambda i: (rows[i][3], -i))


def grid_search(key: str, param_grid: dict, data: DataFrame, folds: int, label: str = "label",
                refit: bool = True):
    """V2: every candidate x fold is fitted once and scored on all four
    metrics; the best macro-F1 candidate (first on a tie) is refitted on all
    rows. Returns (results DataFrame, best params, refitted model)."""
    rows = candidates({key: param_grid}, data, folds, label)
    params = grid(param_grid)[_best(rows)] if rows else None
    model = fit_model(key, data, params, label) if refit and rows else None
    return data.sparkSession.createDataFrame(rows, RESULT), params, model


def _chain(members: dict) -> list:
    """Members in the order they are applied: k-NN, which writes its query
    rows, first."""
    return sorted(members.items(), key=lambda kv: kv[0] != "knn")


class VotingModel:
    """C6/C7 over fitted members (each adds its own pred/prob columns)."""

    def __init__(self, members: dict, voting: str = "hard"):
        self.members, self.voting = members, voting

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for _, m in _chain(self.members):
            out = m.transform(out)
        return self.vote(out)

    def vote(self, out: DataFrame) -> DataFrame:
        """The vote over rows that carry the members' columns."""
        if self.voting == "hard":
            pred = MT.hard_vote([F.col(f"pred_{k}") for k in self.members])
            p1 = F.lit(None).cast("double")
        else:
            p1, pred = MT.soft_vote([positive_prob(k) for k in self.members])
        return out.withColumn("pred_vote", pred.cast("double")).withColumn("p1_vote", p1)


def fit_members(keys: Sequence[str], params: dict, train: DataFrame, label: str = "label") -> dict:
    got = fit_keys({k: [SP.Fit(params.get(k, {}))] for k in keys}, train, label)
    return {k: m[0] for k, m in got.items()}


def fit_voting(keys: Sequence[str], params: dict, train: DataFrame, voting: str,
               label: str = "label") -> VotingModel:
    return VotingModel(fit_members(keys, params, train, label), voting)


class StackingModel:
    """Base members refitted on all rows + logistic meta-learner on
    their positive-class probabilities."""

    def __init__(self, members: dict, meta, meta_cols: list):
        self.members, self.meta, self.meta_cols = members, meta, meta_cols

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for _, m in _chain(self.members):
            out = m.transform(out)
        return self.stack(out)

    def stack(self, out: DataFrame) -> DataFrame:
        """The meta-learner over rows that carry the members' columns."""
        out = out.withColumns({f"__p_{k}": positive_prob(k) for k in self.members})
        out = VectorAssembler(inputCols=self.meta_cols, outputCol="__meta").transform(out)
        out = self.meta.transform(out, "__meta")
        return out.withColumn("pred_stack", F.col("pred_meta")) \
                  .withColumn("p1_stack", positive_prob("meta"))


def _member_scores(models: dict, slots, data: DataFrame, id_col: str) -> DataFrame:
    """``data`` with an array column ``__s_<key>`` per kind: the positive
    probability in each slot. ``slots`` makes the slots from a kind's models."""
    out = data
    for k in models:
        if k in SHARED:
            out = slot_scores(slots(models[k]), out, f"__s_{k}")
    for k in models:
        if k not in SHARED:
            own = slots(models[k])
            got = slot_predictions(k, own, data, [id_col]).groupBy(F.col(id_col).alias("__id")).agg(
                *[F.max(F.when(F.col("slot") == s, F.col("p1"))).alias(f"__{s}") for s in range(len(own))])
            got = got.select("__id", F.array(*[f"__{s}" for s in range(len(own))]).alias(f"__s_{k}"))
            out = out.join(got, F.col(id_col) == F.col("__id"), "left").drop("__id")
    return out


def _fit_meta(rows: DataFrame, probs: dict, label: str, id_col: str):
    """Logistic regression (C=1) on the members' out-of-fold probabilities."""
    flat = rows.select(id_col, label, *[c.alias(f"__p_{k}") for k, c in probs.items()])
    meta_in = VectorAssembler(inputCols=[f"__p_{k}" for k in probs], outputCol="features").transform(flat)
    model = fit_all("lr", settle(meta_in.select(id_col, label, "features"), id_col), [SP.Fit({})],
                    label, id_col)[0]
    model.key = "meta"
    return model


def fit_stacking(keys: Sequence[str], params: dict, train: DataFrame, folds: int = 5,
                 label: str = "label", id_col: str = "id") -> StackingModel:
    """Out-of-fold base probabilities on ``folds`` unshuffled stratified folds
    of the training rows -> meta logistic regression (C=1); the members are
    fitted on all rows in the same passes."""
    data = cut_lineage(settle(stratified_folds(
        train.where(F.col(label).isNotNull()), label, id_col, folds, "__sf"), id_col))
    fits = {k: [*_by_fold([params.get(k, {})], folds, "__sf"), SP.Fit(params.get(k, {}))] for k in keys}
    models = fit_keys(fits, data, label, id_col)
    oof = cut_lineage(_member_scores({k: m[:-1] for k, m in models.items()},
                                     lambda m: _fold_slots(m, folds, "__sf"),
                                     data.select(id_col, label, "__sf", "features"), id_col))
    meta = _fit_meta(oof, {k: F.col(f"__s_{k}")[0] for k in keys}, label, id_col)
    return StackingModel({k: models[k][-1] for k in keys}, meta, [f"__p_{k}" for k in keys])


def nested_folds(data: DataFrame, folds: int, inner: int, label: str, id_col: str) -> DataFrame:
    """Columns ``__sf0..``: the inner stratified fold of a row among the rows
    outside each outer fold (null inside it), all from one ordered pass."""
    ins = [f"__in{f}" for f in range(folds)]
    marked = data.withColumns({c: (F.col("fold") == f).cast("long") for f, c in enumerate(ins)}
                              | {"__one": F.lit(1).cast("long")})
    ranked = running_sums(marked, [label], [id_col], ["__one", *ins], "__c")
    cls = data.groupBy(label).agg(*[e for f in range(folds) for e in (
        F.count(F.when(F.col("fold") != f, 1)).alias(f"n{f}"),
        F.min(F.when(F.col("fold") != f, F.col(id_col))).alias(f"first{f}"))]).collect()  # one per class
    out = {}
    for f in range(folds):
        start, fold = 0, F.lit(None).cast("int")
        pos = F.col("__c__one") - F.col(f"__c__in{f}") - 1
        for r in sorted((r for r in cls if r[f"n{f}"]), key=lambda r: r[f"first{f}"]):
            bounds = _fold_bounds(start, r[f"n{f}"], inner)
            start += r[f"n{f}"]
            own = sum(((pos >= b).cast("int") for b in bounds), F.lit(0))
            fold = F.when(F.col(label) == F.lit(r[label]), own).otherwise(fold)
        out[f"__sf{f}"] = F.when(F.col("fold") != f, fold)
    return ranked.withColumns(out).select(*data.columns, *out)


def ensemble_cv(kinds: Sequence[str], keys: Sequence[str], params: dict, data: DataFrame,
                folds: int, label: str = "label", id_col: str = "id", inner: int = 5) -> DataFrame:
    """V3: CV scores of the ensembles, all four metrics from the same fits. The
    members of every outer fold and the ``inner`` out-of-fold members of its
    stacking train together: folds x (inner + 1) fits of a kind in one go."""
    rows = nested_folds(data.where(F.col(label).isNotNull() & F.col("fold").isNotNull()), folds, inner,
                        label, id_col)
    # slot f of a row: the member that scores it while fold f is held out
    job = {f"__j{f}": F.when(F.col("fold") == f, F.lit(f * (inner + 1) + inner)).otherwise(
        F.col(f"__sf{f}") + f * (inner + 1)) for f in range(folds)}
    rows = cut_lineage(settle(rows.withColumns(job), id_col))
    outs = [o for f in range(folds) for o in (
        *[(("fold", f), (f"__sf{f}", g)) for g in range(inner)], (("fold", f),))]
    need = [o for o in outs if len(o) == 1 or "Stacking" in kinds]
    models = fit_keys({k: [SP.Fit(params.get(k, {}), o) for o in need] for k in keys}, rows, label, id_col)

    def slots(own: list) -> list:
        at = dict(zip(need, own))
        return [(f"__j{f}", {i: at[o] for i, o in enumerate(outs) if o in at and o[0] == ("fold", f)})
                for f in range(folds)]
    scored = cut_lineage(_member_scores(models, slots, rows, id_col))
    p = lambda f: {k: F.col(f"__s_{k}")[f] for k in keys}
    metas = run_parallel(lambda f: _fit_meta(scored.where(F.col("fold") != f), p(f), label, id_col),
                         range(folds)) if "Stacking" in kinds else [None] * folds

    def one(f):
        test, probs = scored.where(F.col("fold") == f), p(f)
        cols = {}
        for kind in kinds:
            if kind == "Stacking":
                w = metas[f].weights
                z = sum((F.lit(float(a)) * c for a, c in zip(w, probs.values())), F.lit(float(w[-1])))
                cols[kind] = (z > 0).cast("int")
            elif kind == "Voting Soft":
                cols[kind] = MT.soft_vote(list(probs.values()))[1]
            else:
                cols[kind] = MT.hard_vote([(c > 0.5).cast("int") for c in probs.values()])
        return test.select("fold", label, F.inline(F.array(*[
            F.struct(F.lit(k).alias("model"), c.cast("int").alias("prediction"))
            for k, c in cols.items()])))
    allp = one(0)
    for f in range(1, folds):
        allp = allp.unionByName(one(f))
    return cv_scores(allp, label, ["model"])


def search_all(grids: dict, data: DataFrame, folds: int, label: str = "label"):
    """C11: every model's grid; the best macro-F1 over all candidates wins (the
    earlier model and candidate on a tie) and is refitted on all rows. Returns
    (results DataFrame, key, params, model)."""
    rows = candidates(grids, data, folds, label)
    best = _best(rows)
    key, params = rows[best][0], grid(grids[rows[best][0]])[rows[best][1]]
    table = data.sparkSession.createDataFrame([(*r, i == best) for i, r in enumerate(rows)],
                                              f"{RESULT}, chosen boolean")
    return table, key, params, fit_model(key, data, params, label)


def comparison(results: DataFrame) -> DataFrame:
    """Leaderboard of positive macro-F1 scores, high to low."""
    return (results.where(F.col("cv_f1_macro") > 0)
            .orderBy(F.desc("cv_f1_macro"), "position"))


def select_best(results: DataFrame, include_ensembles: bool = False) -> DataFrame:
    """Strictly greater macro-F1 wins, the earlier model stays on a tie;
    ensembles compete only with ``include_ensembles``. Without any positive
    base score: Stacking, then Voting Soft, then Voting Hard."""
    r = results.where(F.lit(include_ensembles) | ~F.col("model").isin(*ENSEMBLES))
    best = (r.where(F.col("cv_f1_macro") > 0)
            .orderBy(F.desc("cv_f1_macro"), "position").limit(1))
    fallback = (results.where(F.col("model").isin(*ENSEMBLES))
                .withColumn("__rank", F.when(F.col("model") == "Stacking", 0)
                            .when(F.col("model") == "Voting Soft", 1).otherwise(2))
                .orderBy("__rank").limit(1).drop("__rank"))
    return best if best.limit(1).count() else fallback


def learning_curve(key: str, params: dict, data: DataFrame, folds: int,
                   sizes=(0.1, 0.325, 0.55, 0.775, 1.0), label: str = "label",
                   id_col: str = "id") -> DataFrame:
    """V8: for each fraction of the largest training split and each fold,
    fit on the first n training rows (id order), score macro-F1 on those rows
    and on the validation fold; mean/std over folds and mean fit time."""
    spark = data.sparkSession
    n_max = data.where(F.col("fold") != 0).count()
    abs_sizes = sorted({max(1, int(s * n_max)) for s in sizes})
    # one ordered pass over ids and folds counts the rows of each fold up to a row; a
    # row outside fold f stands in that split at the sum of the other folds' counts
    ins = [f"__in{f}" for f in range(folds)]

    def ranks(rows):
        marked = rows.withColumns({c: (F.col("fold") == f).cast("int") for f, c in enumerate(ins)})
        return cut_lineage(running_sums(marked, [], [id_col], ins, "__c"))

    def place(f):
        return sum((F.col(f"__c__in{g}") for g in range(folds) if g != f), F.lit(0))
    narrow = ranks(data.select(id_col, "fold"))
    # the ids of the last row of each size and of the row after it
    ends = narrow.select(id_col, F.explode(F.array(*[F.when(F.col("fold") != f, F.struct(
        F.lit(f).alias("f"), place(f).cast("long").alias("n"))) for f in range(folds)])).alias("at")) \
        .where(F.col("at.n").isin(*[n + d for n in abs_sizes for d in (0, 1)])).select(id_col, "at.f", "at.n").collect()
    last = {(r["f"], r["n"]): r[id_col] for r in ends}
    split = [(f, n) for f in range(folds) for n in abs_sizes
             if (f, n + 1) in last and last[f, n + 1] == last[f, n]]
    ranked = ranks(data) if split else None     # equal ids on both sides of an end

    def one(job):
        f, n = job
        if job in split:
            sub = ranked.where((F.col("fold") != f) & (place(f) <= n)).select(*data.columns)
        else:
            end, i = last.get(job), F.col(id_col)
            sub = data.where((F.col("fold") != f) & (
                F.lit(True) if (f, n + 1) not in last else i.isNull() if end is None else
                i.isNull() | (i <= F.lit(end))))
        te = data.where(F.col("fold") == f)
        t0 = time.time()
        m = fit_model(key, sub, params, label)
        ft = time.time() - t0
        sc = MT.classification_metrics(
            scored(m, key, sub, [label]).withColumn("__set", F.lit("train")).unionByName(
                scored(m, key, te, [label]).withColumn("__set", F.lit("validation"))),
            label, "prediction", ["__set"]).collect()
        got = {r["__set"]: r["f1_macro"] for r in sc}
        return (n, f, float(got.get("train", 0.0)), float(got.get("validation", 0.0)), ft)
    rows = run_parallel(one, [(f, n) for f in range(folds) for n in abs_sizes])
    df = spark.createDataFrame(rows, "train_size int, fold int, train_f1 double, "
                                     "validation_f1 double, fit_time double")
    return df.groupBy("train_size").agg(
        F.avg("train_f1").alias("train_mean"), F.stddev_pop("train_f1").alias("train_std"),
        F.avg("validation_f1").alias("validation_mean"),
        F.stddev_pop("validation_f1").alias("validation_std"),
        F.avg("fit_time").alias("fit_time_mean"))


def validation_curve(key: str, param: str, values: Sequence, data: DataFrame, folds: int,
                     base_params: dict | None = None, label: str = "label") -> DataFrame:
    """V9: macro-F1 on training and validation rows for each value of one
    parameter; mean/std over folds. Depths of a tree or forest and rounds of a
    boosted model are cut off one fit per fold; neighbours are found once per
    fold. A parameter the model does not have gives no rows."""
    spark = data.sparkSession
    if param not in DEFAULT_PARAMS[key]:
        return spark.createDataFrame([], "param_value double, train_mean double, train_std double, "
                                         "validation_mean double, validation_std double")
    cands = [checked(key, {**(base_params or {}), param: v}) for v in values]
    models = fit_keys({key: _by_fold(cands, folds)}, data, label)[key]
    preds = slot_predictions(key, [(None, m) for m in models], data.where(F.col("fold").isNotNull()),
                             ["fold", label])
    value = F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                         (F.floor(F.col("slot") / folds) + 1).cast("int"))
    held = F.col("slot") % folds
    stacked = preds.select(label, "prediction", value.alias("param_value"), held.alias("of"), F.when(
        F.col("fold") == held, "validation").otherwise("train").alias("__set")).withColumnRenamed("of", "fold")
    per = MT.classification_metrics(stacked, label, "prediction", ["param_value", "fold", "__set"])
    piv = per.groupBy("param_value", "__set").agg(F.avg("f1_macro").alias("m"),
                                                 F.stddev_pop("f1_macro").alias("s"))
    return (piv.groupBy("param_value").agg(
        F.max(F.when(F.col("__set") == "train", F.col("m"))).alias("train_mean"),
        F.max(F.when(F.col("__set") == "train", F.col("s"))).alias("train_std"),
        F.max(F.when(F.col("__set") == "validation", F.col("m"))).alias("validation_mean"),
        F.max(F.when(F.col("__set") == "validation", F.col("s"))).alias("validation_std")))


__all__ = ["KEYS", "grid_search", "cv_predictions", "cv_scores", "VotingModel", "fit_voting",
           "StackingModel", "fit_stacking", "fit_members", "ensemble_cv", "search_all",
           "candidates", "comparison", "select_best",
           "learning_curve", "validation_curve"]
