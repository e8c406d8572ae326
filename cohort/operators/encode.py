"""Ordinal encoding with fitted class tables.

Classes are kept as a DataFrame ``(value, code)`` - codes follow sorted
value order like a label encoder - so the number of classes is not limited
by driver memory. Codes are assigned by range-partitioning the distinct
values and adding per-partition offsets (no single-task window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.functions.text import map_lookup
from cohort.operators.joins import lookup_join
from cohort.sources.files import with_generated_ids

# Class lists up to this size are kept as literal maps (no join at all).
INLINE_MAX = 10_000


def mode_value(df: DataFrame, col: str | Column, default=None,
               categories: Sequence | None = None):
    """Most frequent non-null value; a tie goes to the smallest value,
    or to the first in category order where the categories are ordered.
    Counting is distributed; only the top row reaches the driver."""
    c = F.col(col) if isinstance(col, str) else col
    top = (df.select(c.alias("__v")).where(F.col("__v").isNotNull())
           .groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
           .orderBy(F.desc("__n"), *([] if categories is None else [F.array_position(
               F.array(*[F.lit(x) for x in categories]), F.col("__v"))]), F.asc("__v"))
           .limit(1).collect())
    return top[0]["__v"] if top else default


def value_counts(df: DataFrame, col: str | Column, name: str = "n") -> DataFrame:
    """Rows per non-null value (partial aggregation, no skew issue)."""
    c = F.col(col) if isinstance(col, str) else col
    return (df.select(c.alias("value")).where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias(name)))


def fit_classes(df: DataFrame, col: str | Column, always: Sequence[str] = (),
                min_count: int | None = None, other: str | None = None) -> DataFrame:
    """Class table ``(value, code)``, codes 0.. in sorted order.
    With ``min_count``, values seen fewer times are left out (they map to
    ``other`` at transform). Values in ``always`` are added."""
    vc = value_counts(df, col)
    if min_count is not None:
        vc = vc.where(F.col("n") >= min_count)
    vals = vc.select("value")
    spark = df.sparkSession
    if always:
        extra = spark.createDataFrame([(v,) for v in always], "value string")
        vals = vals.select(F.col("value").cast("string")).unionByName(extra).distinct()
    coded = with_generated_ids(vals, "__id", order_by=["value"])
    return coded.select("value", (F.col("__id") - 1).cast("int").alias("code"))


def encode(df: DataFrame, col: str | Column, classes: DataFrame, out: str,
           fallback: Column | str | None = None, n_classes: int | None = None) -> DataFrame:
    """Code of ``col`` in the fitted classes; a value not among them
    is replaced by ``fallback`` (value) before the lookup, as the reference
    does ('OTHER', 'Unknown', the port mode)."""
    c = F.col(col) if isinstance(col, str) else col
    fb_code = None
    if fallback is not None:
        row = classes.where(F.col("value") == F.lit(fallback)).select("code").first()
        fb_code = None if row is None else row["code"]
    known = classes.select(F.col("value").alias("__val"), F.col("code").alias("__kc"))
    tmp = lookup_join(df.withColumn("__val", c), known, "__val", table_rows=n_classes)
    code = F.col("__kc") if fb_code is None else F.coalesce(F.col("__kc"), F.lit(fb_code))
    return tmp.withColumn(out, code.cast("int")).drop("__kc", "__val")


def fit_codes(df: DataFrame, col: str | Column, always: Sequence[str] = (),
              min_count: int | None = None):
    """Fitted codes: a sorted Python list when there are at most
    ``INLINE_MAX`` classes (checked by fetching at most INLINE_MAX+1 values),
    else a ``(value, code)`` DataFrame."""
    vc = value_counts(df, col)
    if min_count is not None:
        vc = vc.where(F.col("n") >= min_count)
    got = [r["value"] for r in vc.select("value").limit(INLINE_MAX + 1).collect()]
    if len(got) + len(always) <= INLINE_MAX:
        return sorted(set(got) | set(always))
    return fit_classes(df, col, always=always, min_count=min_count)


def encode_with(df: DataFrame, value: Column, codes, out: str,
                fallback=None) -> DataFrame:
    """Encode with ``fit_codes`` output: literal map for a list, lookup join
    for a table. Unknown values take the fallback's code."""
    if isinstance(codes, list):
        mapping = {v: i for i, v in enumerate(codes)}
        code = map_lookup(value, mapping)
        if fallback is not None and fallback in mapping:
            code = F.coalesce(code, F.lit(mapping[fallback]))
        return df.withColumn(out, code.cast("int"))
    return encode(df, value, codes, out, fallback=fallback)


def classes_list(classes: DataFrame) -> list:
    """Small class tables as a Python list in code order (for metadata)."""
    return [r["value"] for r in classes.orderBy("code").collect()]
