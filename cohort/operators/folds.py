"""V1: k-fold assignment stratified by label, unshuffled, as a fold column.

Exact rule of the unshuffled stratified splitter: classes are ordered by
first appearance (in id order); the class-sorted sequence of all rows is
dealt round-robin to the k folds, which fixes how many rows of each class
each fold gets; then each class's rows, in id order, fill fold 0, 1, ...
as contiguous blocks. So for a class of ``n`` rows starting at position
``s`` of the class-sorted sequence, fold ``i`` gets the positions
``p in [s, s+n)`` with ``p % k == i``.

So a fold of a class ends at one id. Positions inside the classes are computed
from labels and ids alone, with range partitioning (``ordering.positions``), so a
class holding most rows is still spread over many tasks, and the rows themselves
are only compared with the ids at which the folds begin. Where the ids on both
sides of such a place are equal, the rows are numbered in full. ``hash_folds`` is the unordered alternative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.ordering import positions


#: Classes that folds are stratified by.
MAX_CLASSES = 10_000


def _fold_bounds(s: int, n: int, k: int) -> list[int]:
    """Cumulative block ends of one class: fold i holds the class rows
    whose position j satisfies bounds[i-1] <= j < bounds[i]."""
    def cnt(i):  # positions p in [s, s+n) with p % k == i
        return (s + n - 1 - i) // k - (s - 1 - i) // k
    out, acc = [], 0
    for i in range(k):
        acc += cnt(i)
        out.append(acc)
    return out


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int,
                     name: str = "fold") -> DataFrame:
    """Exact unshuffled stratified k-fold column (0..k-1). A row without a
    label belongs to no class and keeps a null fold."""
    cls = (df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"))
           .orderBy("first").limit(MAX_CLASSES + 1).collect())
    if len(cls) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification label")
    start, rows = 0, []
    for r in cls:
        rows.append((r[label], _fold_bounds(start, r["n"], k)))
        start += r["n"]
    spark = df.sparkSession
    ltype = dict(df.dtypes)[label]
    bounds = spark.createDataFrame(rows, f"{label} {ltype}, __b array<long>")
    # the ids before and at each place where a fold begins (2 * k a class)
    at = spark.createDataFrame([(v, b + d, i, d) for v, own in rows for i, b in enumerate(own[:-1])
                                for d in (-1, 0)], f"{label} {ltype}, __j long, __i int, __d int")
    found = (positions(df.where(F.col(label).isNotNull()).select(label, id_col), [label], [id_col], "__j")
             .join(F.broadcast(at), [label, "__j"]).select(label, "__i", "__d", id_col).collect()) if k > 1 else []
    sides: dict = {}
    for r in found:
        sides.setdefault((r[label], r["__i"]), {})[r["__d"]] = r[id_col]
    if all(s[0] is not None and s.get(-1, None) != s[0] for s in sides.values() if 0 in s):
        itype = dict(df.dtypes)[id_col]
        first = [(v, [s[0] for i in range(k - 1) if 0 in (s := sides.get((v, i), {}))]) for v, _ in rows]
        begins = spark.createDataFrame(first, f"{label} {ltype}, __b array<{itype}>")
        return (df.join(F.broadcast(begins), label, "left")
                .withColumn(name, F.when(F.col("__b").isNotNull(), F.size(
                    F.filter("__b", lambda b: b <= F.col(id_col))).cast("int")))
                .drop("__b"))
    pos = positions(df, [label], [id_col], "__j")
    return (pos.join(F.broadcast(bounds), label, "left")
            .withColumn(name, F.when(F.col("__b").isNotNull(), F.size(
                F.filter("__b", lambda b: b <= F.col("__j"))).cast("int")))
            .drop("__b", "__j"))


def hash_folds(df: DataFrame, id_col: str, k: int, seed: int = 42,
               name: str = "fold") -> DataFrame:
    """Scalable fold column with no ordering, by a hash that any engine has:
    the first 32 bits of md5('seed:id') modulo k."""
    return df.withColumn(name, F.pmod(hash32(F.col(id_col), seed), F.lit(k)).cast("int"))


def hash32(value: Column, seed: int) -> Column:
    """First 32 bits of md5('seed:value') as a long."""
    text = F.concat(F.lit(f"{seed}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
