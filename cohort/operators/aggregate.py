"""Group aggregates.

All group-bys rely on Spark's partial (map-side) aggregation, so a key that
holds a third of the rows is combined inside each input task before the
shuffle. Totals needed for shares are computed as one scalar aggregate, not
as a window over a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.encode import mode_value
from cohort.operators.joins import attach_counts
from cohort.operators.quantiles import exact_quantiles


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate_by_key(df: DataFrame, key: Column | str, label: Column | str,
                scale: float = 100.0, name: str = "key") -> DataFrame:
    """G1: mean of a 0/1 label per key x scale; null keys are dropped."""
    return (df.select(_c(key).alias(name), _c(label).cast("double").alias("__y"))
            .where(F.col(name).isNotNull())
            .groupBy(name)
            .agg((F.avg("__y") * F.lit(scale)).alias("rate"),
                 F.count(F.lit(1)).alias("n")))


def rate_by_keys_long(df: DataFrame, keys: Sequence[str], label: Column | str,
                      scale: float = 100.0) -> DataFrame:
    """G1 for several keys at once: one scan, keys unpivoted to
    (key_name, key_value) and aggregated together."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value"))
        for k in keys])).alias("__k")
    return (df.select(pairs, _c(label).cast("double").alias("__y"))
            .select("__k.key_name", "__k.key_value", "__y")
            .where(F.col("key_value").isNotNull())
            .groupBy("key_name", "key_value")
            .agg((F.avg("__y") * F.lit(scale)).alias("rate"), F.count(F.lit(1)).alias("n")))


def fill_by_type(df: DataFrame, col: str, default_text: str = "Unknown",
                 categories: Sequence | None = None) -> Column:
    """Fill a key's nulls - text keys with the mode (else 'Unknown'; a tie
    goes by category order if there is one), numeric keys with the exact median
    (else 0). One small job to fit."""
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        m = mode_value(df, col, default_text, categories)
        return F.coalesce(F.col(col), F.lit(m))
    q = exact_quantiles(df, col, [0.5]).collect()
    med = q[0]["value"] if q else None
    return F.coalesce(F.col(col), F.lit(0.0 if med is None else med).cast(dtype))


def rate_by_derived_key(df: DataFrame, key: Column, label: Column | str,
                        categories: Sequence | None = None, scale: float = 1.0) -> DataFrame:
    """Rate by a derived key after the N6 fill, high to low. With
    ``categories`` (an ordered category list, like a binned column) every
    category appears, empty ones with a null rate."""
    tmp = df.select(key.alias("key"), _c(label).cast("double").alias("__y"))
    filled = tmp.select(fill_by_type(tmp, "key", categories=categories).alias("key"), "__y")
    rates = filled.groupBy("key").agg((F.avg("__y") * F.lit(scale)).alias("rate"))
    if categories is not None:
        cats = df.sparkSession.createDataFrame([(c,) for c in categories],
                                               f"key {dict(tmp.dtypes)['key']}")
        rates = F.broadcast(cats).join(rates, "key", "left")
    return rates.orderBy(F.desc_nulls_last("rate"), "key")


def rate_pivot(df: DataFrame, row_key: str, col_key: str, label: str,
               values: Sequence, scale: float = 100.0, prefix: str = "") -> DataFrame:
    """Two-key rate, wide; missing cell -> 0. Explicit pivot values
    avoid the extra distinct job."""
    p = (df.groupBy(row_key).pivot(col_key, list(values))
         .agg(F.avg(F.col(label).cast("double")) * F.lit(scale)).na.fill(0.0))
    return p.select(row_key, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def category_share(df: DataFrame, key: str, scale: float = 100.0) -> DataFrame:
    """Share of each non-null category in percent; the total is a
    scalar aggregate (no single-partition window)."""
    nn = df.where(F.col(key).isNotNull())
    counts = nn.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = nn.count()
    return counts.select(key, "n", (F.col("n") * F.lit(scale) / F.lit(max(total, 1))).alias("share"))


def rare_values(df: DataFrame, key: str, threshold: int) -> DataFrame:
    """Per value its count and the value after collapsing those seen
    fewer than ``threshold`` times into 'OTHER'."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, "n", (F.col("n") < threshold).cast("int").alias("is_rare"),
                         F.when(F.col("n") < threshold, F.lit("OTHER"))
                         .otherwise(F.col(key).cast("string")).alias("grouped"))


def group_frequency(df: DataFrame, key: str, name: str = "frequency") -> DataFrame:
    """Rows sharing the key, on every row (skew-safe lookup join)."""
    return attach_counts(df, key, name)


def actual_vs_predicted(df: DataFrame, keys: Sequence[str], label: str, pred: str,
                        scale: float = 100.0) -> DataFrame:
    """Actual and predicted positive rate per group, one pass for all
    keys (unpivoted)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value"))
        for k in keys])).alias("__k")
    return (df.select(pairs, F.col(label).cast("double").alias("__y"),
                      F.col(pred).cast("double").alias("__p"))
            .select("__k.*", "__y", "__p").where(F.col("key_value").isNotNull())
            .groupBy("key_name", "key_value")
            .agg((F.avg("__y") * scale).alias("actual_rate"),
                 (F.avg("__p") * scale).alias("predicted_rate"),
                 F.count(F.lit(1)).alias("n")))


def overall_rates(long_preds: DataFrame, model: str, label: str, pred: str,
                  scale: float = 100.0) -> DataFrame:
    """Actual vs predicted rate per model over stacked predictions."""
    return (long_preds.groupBy(model)
            .agg((F.avg(F.col(label).cast("double")) * scale).alias("actual_rate"),
                 (F.avg(F.col(pred).cast("double")) * scale).alias("predicted_rate"),
                 F.count(F.lit(1)).alias("n")))


def mean_abs_rank(df: DataFrame, cols: Sequence[str], top: int | None = None) -> DataFrame:
    """Mean |value| per column, ranked high to low (unpivot,
    then one aggregate); ``top`` keeps the first rows (a top-k report)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
        .alias("__s")).select("__s.*")
    agg = long.groupBy("feature").agg(F.avg(F.abs("v")).alias("importance"))
    ranked = agg.orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


def first_occurrence(df: DataFrame, value: str, order: str) -> DataFrame:
    """Order-preserving de-duplication: each value once, with the
    position of its first occurrence."""
    return (df.where(F.col(value).isNotNull()).groupBy(value)
            .agg(F.min(order).alias("first_pos")))


# Derived feature name -> profile key (first match wins).
DRILLDOWN_KEYS = ("AgeGroup", "FareGroup", "Sex", "Pclass", "Embarked")
DRILLDOWN_RULES = (("Age", "AgeGroup"), ("Fare", "FareGroup"), ("Sex", "Sex"),
                   ("Pclass", "Pclass"), ("Embarked", "Embarked"))


class DerivedKey:
    """a profile key: its name, the source columns it needs, and a
    function building the key column from the frame (None: the key does not
    apply to this frame and is skipped)."""

    def __init__(self, name: str, required: Sequence[str], build, categories=None):
        self.name, self.required, self.build, self.categories = name, list(required), build, categories


def passenger_keys(roles: dict) -> list:
    """The reference's seven configured profile keys, over role names."""
    from cohort.functions import binning as B
    from cohort.functions import numeric as N
    from cohort.functions import text as T
    r = roles
    return [
        DerivedKey("Sex", [r["sex"]], lambda d: F.col(r["sex"]).cast("string")),
        DerivedKey("Pclass", [r["pclass"]], lambda d: F.col(r["pclass"]).cast("string")),
        DerivedKey("Embarked", [r["embarked"]], lambda d: F.col(r["embarked"]).cast("string")),
        DerivedKey("AgeGroup", [r["age"]],
                   lambda d: B.cut_left(r["age"], B.AGE_BAND7_EDGES, B.AGE_BAND7_LABELS),
                   B.AGE_BAND7_LABELS),
        DerivedKey("FareGroup", [r["fare"]], lambda d: _fare_quintile_label(d, r["fare"]),
                   B.FARE_QUINTILE_LABELS),
        DerivedKey("FamilyType", [r["sibsp"], r["parch"]],
                   lambda d: B.cut_right(N.family_size(r["sibsp"], r["parch"]),
                                         B.FAMILY_TYPE_EDGES, B.FAMILY_TYPE_LABELS),
                   B.FAMILY_TYPE_LABELS),
        DerivedKey("Title_Grouped", [r["name"]], lambda d: T.title_grouped(r["name"])),
    ]


def _fare_quintile_label(df: DataFrame, fare: str) -> Column | None:
    """None when tied edges collapse and the labels no longer fit them."""
    from cohort.functions import binning as B
    from cohort.operators.pipeline import column_quantiles, quantile_edges
    med = column_quantiles(df, [fare], [0.5])[fare][0]
    filled = F.coalesce(F.col(fare), F.lit(med))
    edges = quantile_edges(df.select(filled.alias(fare)), fare, [0, 0.2, 0.4, 0.6, 0.8, 1.0])
    if len(edges) != len(B.FARE_QUINTILE_LABELS) + 1:
        return None
    return B.quantile_label(filled, F.array(*[F.lit(e) for e in edges]), B.FARE_QUINTILE_LABELS)


def profile_rates(df: DataFrame, label: str, keys: Sequence[DerivedKey]) -> DataFrame:
    """G2 over a configured key list: keys whose source columns are absent
    are skipped; one long frame (key_name, category, rate), each key sorted
    high to low inside."""
    out = None
    for k in keys:
        if not all(c in df.columns for c in k.required):
            continue
        key = k.build(df)
        if key is None:
            continue
        r = rate_by_derived_key(df, key, label, categories=k.categories)
        r = r.select(F.lit(k.name).alias("key_name"), F.col("key").cast("string").alias("category"),
                     "rate")
        out = r if out is None else out.unionByName(r)
    return out
