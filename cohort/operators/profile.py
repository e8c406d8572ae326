"""Table profiles (G8-G10, G13-G18, N10): describe, missing values,
correlations, histograms, densities, box and violin statistics.

Each profile is a few distributed aggregates; Python only sees small
results (one row per column, bin or grid point). Kernel densities are summed
per partition in NumPy (``mapInPandas``) and combined by a group-by, so no
row x grid-point table is materialised.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.operators.joins import group_join, lookup_join
from cohort.operators.quantiles import exact_quantiles
from cohort.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """P10: columns whose type is numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column, null count and share in percent (one aggregate)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"__m{i}") for i, c in enumerate(cols)])
    long = agg.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("n_missing"))
        for i, c in enumerate(cols)])).alias("__s"))
    return long.select("__s.column", "__s.n_missing",
                       (F.col("__s.n_missing") * 100.0 / F.col("__n")).alias("pct_missing"))


def missing_rows(df: DataFrame, id_col: str) -> DataFrame:
    """N10, row level: one 0/1 flag per column (the missingness matrix)."""
    return df.select(id_col, *[F.col(c).isNull().cast("int").alias(c)
                               for c in df.columns if c != id_col])


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top, freq for every column; mean, sample std,
    min, quartiles, max for numeric ones (null where not applicable).
    Top is the most frequent value, smallest on a tie."""
    cols = list(cols or df.columns)
    num = [c for c in cols if c in numeric_columns(df)]
    text = [c for c in cols if c not in num]
    # values are counted for text columns only; numbers need their moments
    long_t = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("s"))
        for c in text or cols])).alias("__s")).select("__s.*").where(F.col("column").isin(text))
    vc = (long_t.where(F.col("s").isNotNull()).groupBy("column", "s")
          .agg(F.count(F.lit(1)).alias("n")))
    cat = vc.groupBy("column").agg(
        F.sum("n").alias("tcount"), F.count(F.lit(1)).alias("unique"),
        F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("top"),
        F.max("n").alias("freq"))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
        for c in num or cols])).alias("__s")).select("__s.*") \
        .where(F.col("x").isNotNull() & F.col("column").isin(num))
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("ncount"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = (exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["column"])
         .groupBy("column").pivot("q_idx", [0, 1, 2]).agg(F.first("value")))
    q = q.select("column", F.col("0").alias("q25"), F.col("1").alias("q50"), F.col("2").alias("q75"))
    names = df.sparkSession.createDataFrame([(c, c in num) for c in cols],
                                            "column string, is_numeric boolean")
    out = (F.broadcast(names).join(cat, "column", "left").join(stats, "column", "left")
           .join(q, "column", "left"))
    isn = F.col("is_numeric")
    return out.select(
        "column", F.coalesce("tcount", "ncount", F.lit(0)).cast("long").alias("count"),
        F.when(~isn, F.col("unique")).cast("long").alias("unique"),
        F.when(~isn, F.col("top")).alias("top"),
        F.when(~isn, F.col("freq")).cast("long").alias("freq"),
        "mean", "std", "min", "q25", "q50", "q75", "max")


def corr_pairwise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation, pairwise-complete rows, all pairs in ONE
    aggregate. A constant column gives null (no division by zero)."""
    cols = list(cols)
    exprs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            cov = F.covar_pop(xa, xb)
            sa = F.stddev_pop(F.when(both, xa))
            sb = F.stddev_pop(F.when(both, xb))
            exprs.append(F.try_divide(cov, sa * sb).alias(f"c_{i}_{j}"))
    row = df.agg(*exprs)
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"c_{min(i, j)}_{max(i, j)}"
            pairs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  F.col(k).alias("corr")))
    return row.select(F.explode(F.array(*pairs)).alias("__p")).select("__p.*")


def _moment_partials(k: int, shift: np.ndarray):
    """mapInArrow body: per partition and column pair, the count, sums, sums
    of squares and cross product over the rows where both are present."""
    def run(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in b.columns])
            there = ~np.isnan(x)
            x = np.where(there, x - shift, 0.0)
            m, sq = there.astype("float64"), x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype("int32")), pa.array(j.astype("int32")),
             *(pa.array(t[i, j]) for t in total)], ["i", "j", "n", "sa", "sb", "qa", "qb", "p"])
    return run


def corr_vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Wide correlation over pairwise-complete rows. Each task adds up
    its moments as a few k x k matrix products (values are shifted by the
    column mean first, so the sums do not cancel); the k * (k + 1) / 2 cells of
    all tasks meet in one aggregate. A constant column gives null."""
    cols = list(cols)
    x = df.select([F.col(c).cast("double").alias(c) for c in cols])
    # a NaN counts as absent
    means = x.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cols]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    cells = x.mapInArrow(_moment_partials(len(cols), shift), "i int, j int, n double, sa double, "
                         "sb double, qa double, qb double, p double")
    s = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    cov = F.col("p") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("qa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("qb") - F.col("sb") * F.col("sb") / F.col("n")
    # sums of squares that are rounding noise of a constant column
    flat = (va <= 1e-12 * F.col("qa")) | (vb <= 1e-12 * F.col("qb"))
    s = s.select("i", "j", F.when((F.col("n") > 0) & ~flat, cov / F.sqrt(va * vb)).alias("corr"))
    both = s.unionByName(s.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.element_at(names, F.col("i") + 1).alias("col_a"),
                       F.element_at(names, F.col("j") + 1).alias("col_b"), "corr")


def histogram(df: DataFrame, x: str, hue: str | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins over the shared [min, max] range, per hue;
    bin = least(floor((x-min)/width), bins-1) so x = max lands in the last
    bin. One scalar aggregate, then one grouped count."""
    xs = F.col(x).cast("double")
    lo, hi = df.agg(F.min(xs), F.max(xs)).first()
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, bin_lo double, bin_hi double, hue string, n long")
    width = (hi - lo) / bins
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((xs - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    h = F.col(hue).cast("string") if hue else F.lit(None).cast("string")
    counts = (df.where(xs.isNotNull()).select(b.alias("bin"), h.alias("hue"))
              .groupBy("bin", "hue").agg(F.count(F.lit(1)).alias("n")))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                         "hue", "n")


#: Groups whose partial densities a task holds before it hands them on.
GROUPS_HELD = 1000


def _density_partials(grid: int, group_cols: list[str]):
    """mapInPandas body: sums of Gaussian kernels of the (value, count) rows
    on their group's grid."""
    def rows(acc):
        for key, tot in acc.items():
            out = {g: [k] * grid for g, k in zip(group_cols, key)}
            out["grid_idx"] = np.arange(grid, dtype="int32")
            out["partial"] = tot
            yield pd.DataFrame(out)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group_cols, dropna=False, sort=False):
                key = tuple(None if isinstance(k, float) and np.isnan(k) else k
                            for k in (key if isinstance(key, tuple) else (key,)))
                bw = part["bw"].iloc[0]
                pts = np.linspace(part["gmin"].iloc[0], part["gmax"].iloc[0], grid)
                xv = part["x"].to_numpy(dtype="float64")
                w = part["n"].to_numpy(dtype="float64")
                tot = acc.setdefault(key, np.zeros(grid))
                for s in range(0, len(xv), 4096):
                    z = (pts[None, :] - xv[s:s + 4096, None]) / bw
                    tot += (w[s:s + 4096, None] * np.exp(-0.5 * z * z)).sum(axis=0)
            if len(acc) >= GROUPS_HELD:
                yield from rows(acc)
                acc = {}
        yield from rows(acc)
    return run


def kde(df: DataFrame, x: str, group_cols: Sequence[str], grid: int = 200,
        cut: float = 3.0, common_norm: bool = True) -> DataFrame:
    """Gaussian KDE per group with Scott's bandwidth
    (sample std x n^(-1/5)), a ``grid``-point support from min - cut*bw to
    max + cut*bw; with ``common_norm`` each group's density is scaled by its
    share of all rows. Values are first compressed to (group, value, count);
    the groups' statistics stay a table, whatever their number. A null group is
    a group. A group of one row or of one value has no bandwidth: it gives one
    row with its value and a null density."""
    g = list(group_cols)
    xs = F.col(x).cast("double")
    base = df.select(*g, xs.alias("x")).where(F.col("x").isNotNull())
    comp = base.groupBy(*g, "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    st = base.groupBy(*g).agg(
        F.count(F.lit(1)).cast("double").alias("cnt"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    bw = F.col("sd") * F.pow("cnt", F.lit(-0.2))
    st = cut_lineage(st.withColumn("bw", bw).select(
        *g, "cnt", "bw", "xmin", (F.col("xmin") - F.lit(cut) * F.col("bw")).alias("gmin"),
        (F.col("xmax") + F.lit(cut) * F.col("bw")).alias("gmax")))
    total = st.agg(F.sum("cnt")).first()[0] or 0.0
    spread = st.where("bw > 0")
    schema = T.StructType([f for f in comp.schema.fields if f.name in g] + [
        T.StructField("grid_idx", T.IntegerType()), T.StructField("partial", T.DoubleType())])
    parts = group_join(comp, spread, g).mapInPandas(_density_partials(grid, g), schema)
    sums = parts.groupBy(*g, "grid_idx").agg(F.sum("partial").alias("ksum"))
    norm = F.lit(total) if common_norm else F.col("cnt")
    step = (F.col("gmax") - F.col("gmin")) / F.lit(grid - 1)
    dense = group_join(sums, spread, g).select(
        *g, "grid_idx", (F.col("gmin") + F.col("grid_idx") * step).alias("x"),
        (F.col("ksum") / (norm * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
    flat = st.where("bw IS NULL OR NOT bw > 0").select(
        *g, F.lit(0).alias("grid_idx"), F.col("xmin").alias("x"),
        F.lit(None).cast("double").alias("density"))
    return dense.unionByName(flat)


def box_stats(df: DataFrame, x: str, group_cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Per group quartiles (exact), whiskers at the furthest values
    within 1.5 IQR of the box, and the outlier count. The per-group stats
    table (one row per group) is broadcast back to the rows."""
    g = list(group_cols)
    xs = F.col(x).cast("double")
    base = df.select(*g, xs.alias("x")).where(F.col("x").isNotNull())
    q = (exact_quantiles(base, "x", [0.25, 0.5, 0.75], g)
         .groupBy(*g).pivot("q_idx", [0, 1, 2]).agg(F.first("value"))
         .select(*g, F.col("0").alias("q1"), F.col("1").alias("median"), F.col("2").alias("q3")))
    q = q.withColumn("__lo", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))) \
         .withColumn("__hi", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    inside = (F.col("x") >= F.col("__lo")) & (F.col("x") <= F.col("__hi"))
    q = q.cache()  # one row per group; broadcast below only if its count is in bound
    w = (lookup_join(base, q, g, how="inner").groupBy(*g).agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n")))
    return q.drop("__lo", "__hi").join(w, g)


def box_outliers(df: DataFrame, x: str, group_cols: Sequence[str], keep: Sequence[str],
                 whisker: float = 1.5) -> DataFrame:
    """G15 outlier rows (every row outside the whiskers' range)."""
    g = list(group_cols)
    s = box_stats(df, x, g, whisker).select(
        *g, (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("__lo"),
        (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("__hi"))
    xs = F.col(x).cast("double")
    return (lookup_join(df, s, g, how="inner").where((xs < F.col("__lo")) | (xs > F.col("__hi")))
            .select(*keep, *g, xs.alias(x)))


def scatter_binned(df: DataFrame, x: str, y: str, hue: str | None = None,
                   bins: int = 50) -> DataFrame:
    """G17 at scale: 2-D equal-width bin counts of complete (x, y) pairs."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    comp = df.where(xs.isNotNull() & ys.isNotNull())
    x0, x1, y0, y1 = comp.agg(F.min(xs), F.max(xs), F.min(ys), F.max(ys)).first()
    if x0 is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, hue string, n long")

    def b(v, lo, hi):
        w = (hi - lo) / bins
        return F.lit(0) if w == 0 else F.least(F.floor((v - F.lit(lo)) / F.lit(w)), F.lit(bins - 1))
    h = F.col(hue).cast("string") if hue else F.lit(None).cast("string")
    return (comp.select(b(xs, x0, x1).cast("int").alias("bx"), b(ys, y0, y1).cast("int").alias("by"),
                        h.alias("hue"))
            .groupBy("bx", "by", "hue").agg(F.count(F.lit(1)).alias("n")))
