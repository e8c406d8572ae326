"""Order-dependent numbering without a single-task window.

``Window.orderBy`` with no partition key (or a partition key that holds a
third of the rows) sorts everything in one task. Here rows are
range-partitioned on (group, order) - so one large group spans many
partitions - sorted inside each partition, and numbered with the
per-partition sequence of ``monotonically_increasing_id``. Small tables of
per-(partition, group) counts or sums give each partition its offset.

Range boundaries come from sampling, and the row order inside a shuffled
partition is not fixed, so the ranged frame is written once with a reliable
checkpoint (the shared ``spark.checkpoint.dir``) before it is read twice -
for the offsets and for the rows - and after an executor loss both reads
still see the same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.operators.joins import lookup_join
from cohort.session import cut_lineage


def _ranged(df: DataFrame, keys: list[str], n_parts: int | None) -> DataFrame:
    # without an explicit count AQE may merge adjacent (small) ranges, which
    # keeps the global order
    r = df.repartitionByRange(n_parts, *keys) if n_parts else df.repartitionByRange(*keys)
    s = r.sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    # within a partition the id sequence follows the sorted row order
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    return cut_lineage(s.withColumn("__pid", pid).withColumn("__li", local))


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
              name: str, n_parts: int | None = None) -> DataFrame:
    """0-based position of each row inside its group in ``order_cols``
    order (make the order unique, e.g. end with the id)."""
    g = list(group_cols)
    t = _ranged(df, g + list(order_cols), n_parts)
    stats = t.groupBy("__pid", *g).agg(F.count(F.lit(1)).alias("__c"),
                                        F.min("__li").alias("__first"))
    w = Window.partitionBy(*g).orderBy("__pid") if g else Window.orderBy("__pid")
    offs = stats.withColumn(
        "__off", F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)))
    out = lookup_join(t, offs.drop("__c"), ["__pid", *g])
    return (out.withColumn(name, (F.col("__off") + F.col("__li") - F.col("__first")).cast("long"))
            .drop("__pid", "__li", "__off", "__first"))


def running_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 value_cols: Sequence[str], prefix: str = "cum_",
                 n_parts: int | None = None, ahead: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``value_cols`` inside each group in
    ``order_cols`` order (unique order required), and for each column in ``ahead``
    (without nulls) its value in the next row of the group as ``next_<column>``,
    null at the group's end."""
    g = list(group_cols)
    t = _ranged(df, g + list(order_cols), n_parts)
    vals, ahead = list(value_cols), list(ahead)
    stats = t.groupBy("__pid", *g).agg(
        *[F.sum(v).alias(f"__s_{v}") for v in vals],
        *[F.min_by(v, "__li").alias(f"__f_{v}") for v in ahead])
    by = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("__pid")
    w = by.rowsBetween(Window.unboundedPreceding, -1)
    # the row after a partition's last one of a group is the group's first row
    # in the next partition that has the group
    offs = stats.select("__pid", *g, *[F.coalesce(F.sum(f"__s_{v}").over(w), F.lit(0))
                                      .alias(f"__o_{v}") for v in vals],
                        *[F.lead(f"__f_{v}").over(by).alias(f"__h_{v}") for v in ahead])
    # the rows lie sorted in their partitions: summed up in place, no shuffle
    types = dict(df.dtypes)
    kinds = {v: "double" if types[v] in ("float", "double") else "bigint" for v in vals}
    fields = T.StructType([*t.schema.fields, *[T.StructField(
        f"__l_{v}", T.DoubleType() if kinds[v] == "double" else T.LongType()) for v in vals],
        *[T.StructField(f"__n_{v}", df.schema[v].dataType) for v in ahead]])
    local = t.mapInArrow(_cumulate(g, vals, kinds, ahead), fields)
    out = lookup_join(local, offs, ["__pid", *g])
    return out.select(*df.columns, *[(F.col(f"__o_{v}") + F.col(f"__l_{v}")).alias(f"{prefix}{v}")
                                     for v in vals],
                      *[F.coalesce(f"__n_{v}", f"__h_{v}").alias(f"next_{v}") for v in ahead])


def changes(b: pa.RecordBatch, cols: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """True for each row that differs in ``cols`` from the row before; ``last``
    is the one before the batch (None: the first row begins)."""
    out = np.zeros(b.num_rows, bool)
    out[0] = last is None
    for c in cols:
        col = b.column(c)
        if last is not None:
            col = pa.concat_arrays([last.column(c), col])
        x, y = col[1:], col[:-1]
        ne = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
        out[len(out) - len(ne):] |= ne.to_numpy(zero_copy_only=False)
    return out


def _sums(x: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
    """Running sums that begin anew at ``starts``; ``carry`` goes into the
    rows before the first start."""
    if x.dtype == np.int64:
        out = np.cumsum(x)
        base = np.concatenate([[-carry], out[starts] - x[starts]])
        return out - np.repeat(base, np.diff([0, *starts, len(x)]))
    out = np.empty(len(x))
    for i, (a, e) in enumerate(zip([0, *starts], [*starts, len(x)])):
        if e > a:  # a float sum depends on where it begins
            out[a:e] = np.cumsum(x[a:e])
            if i == 0:
                out[a:e] += carry
    return out


def _cumulate(g: list[str], vals: list[str], kinds: dict[str, str], ahead: list[str]):
    """mapInArrow body: inclusive sums that start over where the group
    changes; the state at the end of a batch goes on into the next. With
    ``ahead`` a batch's last row waits for the row after it."""
    def follow(b: pa.RecordBatch, new: np.ndarray | None) -> pa.RecordBatch:
        n = b.num_rows - (new is not None)
        cols = []
        for v in ahead:
            if new is None:
                cols.append(pa.nulls(n, b.schema.field(v).type))
            else:
                cols.append(pc.if_else(pa.array(~new[1:]), b.column(v)[1:], pa.scalar(None)))
        b = b.slice(0, n)
        return pa.RecordBatch.from_arrays([*b.columns, *cols],
                                          [*b.schema.names, *(f"__n_{v}" for v in ahead)])

    def run(batches):
        last, held, carry = None, None, [0] * len(vals)
        for b in batches:
            if not b.num_rows:
                continue
            new = changes(b, g, last)
            last = b.slice(b.num_rows - 1)
            starts, cols = np.flatnonzero(new), []
            for j, v in enumerate(vals):
                kind = np.float64 if kinds[v] == "double" else np.int64
                x = b.column(v).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                s = _sums(x, starts, kind(carry[j]))
                carry[j] = s[-1]
                cols.append(pa.array(s))
            out = pa.RecordBatch.from_arrays(
                [*b.columns, *cols], [*b.schema.names, *(f"__l_{v}" for v in vals)])
            if not ahead:
                yield out
                continue
            if held is not None:
                out = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([p, q]) for p, q in zip(held.columns, out.columns)],
                    out.schema.names)
                new = np.concatenate([[True], new])
            yield follow(out, new)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield follow(held, None)
    return run
