"""Classification metrics from (label, prediction[, score]) columns
(V4-V7, C6, C7): one confusion-table aggregate per model, macro averages
with zero division -> 0, ROC points via distributed running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.joins import lookup_join
from cohort.operators.ordering import running_sums
from cohort.session import cut_lineage

#: Classes that a confusion matrix over unnamed classes may have.
MAX_CLASSES = 1000


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = (),
              classes: Sequence | None = None) -> DataFrame:
    """V6: counts per (label, prediction) over the full class grid; absent
    cells are 0. The grid is the class list exploded per group (no join of
    row sets)."""
    g = list(by)
    counts = df.groupBy(*g, F.col(label).alias("label"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        counts = cut_lineage(counts)  # the classes come from the counts, not a second scan
        found = counts.select(F.explode(F.array("label", "prediction")).alias("c")).where("c IS NOT NULL") \
            .distinct().limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes: name them, or check the label column")
        classes = sorted(r[0] for r in found)
    cl = F.array(*[F.lit(c) for c in classes])
    grid = (counts.select(*g).distinct() if g else df.sparkSession.range(1).select())
    grid = grid.select(*g, F.explode(cl).alias("label")).select(
        *g, "label", F.explode(cl).alias("prediction"))
    return grid.join(counts, g + ["label", "prediction"], "left").select(
        *g, "label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_metrics(df: DataFrame, label: str, pred: str,
                           by: Sequence[str] = ()) -> DataFrame:
    """V4/V5: accuracy and macro precision / recall / F1 per group. Per class
    c: tp, predicted count, actual count from one grouped count; a class
    with no predictions (or no rows) scores 0, like zero_division=0."""
    g = list(by)
    cells = df.groupBy(*g, F.col(label).alias("y"), F.col(pred).alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    per_y = cells.groupBy(*g, F.col("y").alias("c")).agg(F.sum("n").alias("actual"))
    per_p = cells.groupBy(*g, F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    tp = cells.where(F.col("y") == F.col("p")).groupBy(*g, F.col("y").alias("c")) \
        .agg(F.sum("n").alias("tp"))
    per = (per_y.join(per_p, g + ["c"], "full").join(tp, g + ["c"], "left")
           .na.fill(0, ["actual", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    per = per.select(*g, "tp", "actual", prec.alias("prec"), rec.alias("rec"))
    f1 = F.when(F.col("prec") + F.col("rec") > 0,
                2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    return per.groupBy(*g).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        F.avg("prec").alias("precision_macro"), F.avg("rec").alias("recall_macro"),
        F.avg(f1).alias("f1_macro"), F.sum("actual").cast("long").alias("n"))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
               corners: bool = False) -> DataFrame:
    """V7: one ROC point per distinct score (threshold), high to low:
    fpr/tpr of predicting positive when score >= threshold. Scores are first
    compressed to (group, score, positives, negatives); cumulative sums use
    range partitioning, not a single-task window.

    ``corners``: the points at which the curve turns only - a score's point
    goes if the next score adds as many positives and negatives as this one did -
    and the start point (0, 0) of each group, with a null threshold. The area is
    the same."""
    g = list(by)
    comp = (df.select(*g, F.col(score).cast("double").alias("threshold"),
                      F.col(label).cast("int").alias("__y"))
            .groupBy(*g, "threshold")
            .agg(F.sum("__y").cast("long").alias("pos"),
                 F.sum(1 - F.col("__y")).cast("long").alias("neg")))
    cum = running_sums(comp.withColumn("__neg_t", -F.col("threshold")), g, ["__neg_t"],
                       ["pos", "neg"], ahead=["pos", "neg"] if corners else ())
    # totals from the checkpointed ranged frame (no second scan of the input)
    tot = cum.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if g:
        j = lookup_join(cum, tot, g, how="inner")  # one row per group, size-checked
    else:
        P, N = tot.first()  # no groups: two scalars
        j = cum.withColumn("P", F.lit(P)).withColumn("N", F.lit(N))
    if corners:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        j = j.where(first | F.col("next_pos").isNull() | turns)
    points = j.select(*g, "threshold",
                      F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                      F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
                      "pos", "neg", "cum_pos", "cum_neg")
    if not corners:
        return points
    none = F.lit(0).cast("long")
    start = j.where(first).select(
        *g, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        *[none.alias(c) for c in ("pos", "neg", "cum_pos", "cum_neg")])
    return points.unionByName(start)


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """V7: area under the ROC curve by the trapezoid rule. For a threshold
    with (pos, neg) rows and (cum_pos, cum_neg) rows at or above it, its
    trapezoid is neg * (cum_pos - pos/2) / (P*N); summed per group."""
    g = list(by)
    pts = roc_points(df, label, score, g)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    tot = F.sum("pos") * F.sum("neg")
    return pts.groupBy(*g).agg(F.try_divide(F.sum(area), tot.cast("double")).alias("auc"))


def hard_vote(preds: Sequence[Column | str]) -> Column:
    """Majority class of 0/1 predictions; a tie goes to the lower
    label (0)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in preds]
    ones = sum((c.cast("int") for c in cols), F.lit(0))
    return (ones * 2 > F.lit(len(cols))).cast("int")


def soft_vote(probs: Sequence[Column | str]) -> tuple[Column, Column]:
    """Mean positive-class probability and its argmax (0 on a tie)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in probs]
    mean = sum((c.cast("double") for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    return mean, (mean > F.lit(0.5)).cast("int")
