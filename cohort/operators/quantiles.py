"""Exact quantiles (pandas-style linear interpolation) without a single-task
gather of the whole column.

Spark's exact ``percentile`` keeps one map of all distinct values per group
and merges it in one task; at 100 TB a continuous column does not fit. Here
exact order statistics are found by bracketing:

1. per group, count ``n``; every probability needs one or two ranks
   (``floor``/``ceil`` of ``p*(n-1)``), its slots, each with an open bracket;
2. while a slot's bracket ``(lo, hi)`` holds more than ``small`` rows, propose
   two bounds inside it - from a mergeable GK sketch (``percentile_approx``,
   rank error <= 1/accuracy; in the first round all slots share one sketch per
   group), or, if the sketch's bounds did not narrow it, its middle value - and
   count rows ``<``/``<=`` each bound. A rank that falls on a bound's ties is
   resolved to that bound (so a value repeated on a third of all rows costs
   nothing); otherwise the bracket shrinks to the side or middle that holds the
   rank. This goes on until every bracket is small;
3. read the order statistics from the sorted rows of the final brackets
   (<= ``small`` per slot); only rows inside some bracket are kept for it.

Each pass is one scan with partial aggregation: a row meets its group's
brackets as one array (an equi-join on the group, or literals without groups)
and the aggregates look into it, so no row is copied per rank.

Interpolation is ``lo + d * (hi - lo)`` with ``d = p*(n-1) - floor(p*(n-1))``
(the SQL ``quantile_cont`` form), in both the small-group and large-group
paths, so results do not depend on which path ran.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.session import cut_lineage

SMALL_BRACKET = 200_000      # rows per rank sorted in one task at the end
ACCURACY = 10_000            # GK sketch accuracy (rank error n/ACCURACY)
GRID = 1000                  # quantile grid per refinement round
#: Groups whose bracket arrays (about 100 bytes a slot) may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20
MAX_FAST_GROUPS = 10_000


def _lerp(v0, v1, frac):
    """lo + frac * (hi - lo), exactly lo when frac is 0."""
    return F.when(frac > 0, v0 + frac * (v1 - v0)).otherwise(v0)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), small: int = SMALL_BRACKET,
                    accuracy: int = ACCURACY) -> DataFrame:
    """Return ``(*group_cols, q_idx, prob, value)``: exact quantiles of the
    non-null, non-NaN values, linear interpolation between order
    statistics (the pandas / NumPy default and Spark ``percentile``)."""
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    base = (df.select(*g, x.alias("__x"))
            .where(F.col("__x").isNotNull() & ~F.isnan("__x")))

    counts = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))
    # Fast path (checked): few groups and every group within the bracket
    # bound -> each group's values (at most ``small``) are sorted in one task
    # and the order statistics read directly.
    head = counts.limit(MAX_FAST_GROUPS + 1).collect()
    if len(head) <= MAX_FAST_GROUPS and all(r["__n"] <= small for r in head):
        srt = base.groupBy(*g).agg(F.sort_array(F.collect_list("__x")).alias("__s"),
                                   F.count(F.lit(1)).alias("__n"))
        pr = F.explode(F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(float(p)).alias("prob"))
                                 for i, p in enumerate(probs)])).alias("__t")
        e = (srt.where(F.col("__n") > 0).select(*g, "__s", "__n", pr)
             .select(*g, "__s", "__n", "__t.q_idx", "__t.prob"))
        pos = F.col("prob") * (F.col("__n") - 1)
        lo = F.floor(pos).cast("int")
        v0 = F.try_element_at("__s", lo + 1)
        v1 = F.try_element_at("__s", F.least(lo + 2, F.col("__n").cast("int")))
        return e.select(*g, "q_idx", "prob",
                        _lerp(v0, v1, pos - F.floor(pos)).alias("value"))
    return _refine(base, counts, probs, g, small, accuracy)


_SLOT = ("slot int, lo double, hi double, below bigint, within bigint, r bigint, "
         "val double, stuck boolean")


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null group is a group."""
    b = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.col(keys[0]).eqNullSafe(F.col(f"__r_{keys[0]}"))
    for k in keys[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return a.join(b, cond, how).drop(*[f"__r_{k}" for k in keys])


def _attach(base: DataFrame, state: DataFrame, g: list[str], groups: int, slots: int) -> DataFrame:
    """Rows with their group's slots as the array ``b``."""
    packed = state.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(
        *[x.split()[0] for x in _SLOT.split(", ")]))).alias("b"))
    if not g:
        rows = [tuple(x) for x in (packed.first() or [[]])["b"]]
        lits = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(
            r, (x.split() for x in _SLOT.split(", ")))]) for r in rows])
        return base.withColumn("b", lits)
    packed = cut_lineage(packed)
    if groups * slots * 100 <= MAX_BROADCAST_BYTES:
        packed = F.broadcast(packed)
    return _join(base, packed, g)


def _refine(base: DataFrame, counts: DataFrame, probs: Sequence[float], g: list[str],
            small: int, accuracy: int, max_rounds: int = 200) -> DataFrame:
    """Large groups: ``(*g, q_idx, prob, value)`` by shrinking brackets."""
    k = 2 * len(probs)                      # slot 2i: floor rank of prob i, 2i+1: ceil rank
    pos = [F.lit(float(p)) * (F.col("__n") - 1) for p in probs]
    null = F.lit(None).cast("double")
    slots = F.explode(F.array(*[F.struct(
        F.lit(s).alias("slot"), null.alias("lo"), null.alias("hi"),
        F.lit(0).cast("bigint").alias("below"), F.col("__n").alias("within"),
        (F.floor if s % 2 == 0 else F.ceil)(pos[s // 2]).cast("bigint").alias("r"),
        null.alias("val"), F.lit(False).alias("stuck")) for s in range(k)])).alias("s")
    counts = cut_lineage(counts.where("__n > 0"))
    groups = counts.count()
    state = cut_lineage(counts.select(*g, slots).select(*g, "s.*"))
    grid = [i / GRID for i in range(GRID + 1)]
    x, names = F.col("__x"), [n.split()[0] for n in _SLOT.split(", ")]

    def inside(s):
        lo, hi = F.col("b")[s]["lo"], F.col("b")[s]["hi"]
        return (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi)) & F.col("b")[s]["val"].isNull()

    for turn in range(max_rounds):
        wide = state.where(F.col("val").isNull() & (F.col("within") > small))
        if wide.isEmpty():
            break
        rows = _attach(base, state, g, groups, k)
        if turn == 0:                       # all brackets are the whole group
            sk = base.groupBy(*g).agg(F.percentile_approx("__x", grid, accuracy).alias("q"),
                                      F.min("__x").alias("mn"), F.max("__x").alias("mx"))
            per = F.array(*[F.struct(F.lit(s).alias("slot"), "q", "mn", "mx") for s in range(k)])
        else:
            aggs = []
            for s in range(k):
                v = F.when(inside(s), x)
                aggs += [F.percentile_approx(v, grid, accuracy).alias(f"q{s}"),
                         F.min(v).alias(f"mn{s}"), F.max(v).alias(f"mx{s}")]
            sk = rows.groupBy(*g).agg(*aggs)
            per = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"q{s}").alias("q"),
                                     F.col(f"mn{s}").alias("mn"), F.col(f"mx{s}").alias("mx"))
                            for s in range(k)])
        long = sk.select(*g, F.explode(per).alias("p")).select(*g, "p.*")
        loc = (F.col("r") - F.col("below")).cast("double") / F.col("within")
        margin = 2.0 / accuracy
        lo_i = F.greatest(F.floor((loc - margin) * GRID), F.lit(0)).cast("int")
        hi_i = F.least(F.ceil((loc + margin) * GRID), F.lit(GRID)).cast("int")
        middle = F.col("mn") / 2 + F.col("mx") / 2
        bounds = _join(state, long, g + ["slot"]).select(
            *g, *names,
            F.when(F.col("stuck"), middle).otherwise(F.element_at("q", lo_i + 1)).alias("nlo"),
            F.when(F.col("stuck"), middle).otherwise(F.element_at("q", hi_i + 1)).alias("nhi"))
        bounds = cut_lineage(bounds)
        # one more scan counts each slot's rows below its two bounds
        seen = _attach(base, bounds.select(*g, "slot", F.col("nlo").alias("lo"),
                                           F.col("nhi").alias("hi"), "below", "within", "r",
                                           "val", "stuck"), g, groups, k)
        lo = [F.col("b")[s]["lo"] for s in range(k)]
        hi = [F.col("b")[s]["hi"] for s in range(k)]
        cells = seen.groupBy(*g).agg(*[F.sum(c.cast("bigint")).alias(f"{n}{s}") for s in range(k)
                                       for n, c in (("a", x < lo[s]), ("b", x <= lo[s]),
                                                    ("c", x < hi[s]), ("d", x <= hi[s]))])
        cnt = cells.select(*g, F.explode(F.array(*[F.struct(
            F.lit(s).alias("slot"), *[F.col(f"{n}{s}").alias(n) for n in "abcd"])
            for s in range(k)])).alias("p")).select(*g, "p.*")
        r, done = F.col("r"), F.col("val").isNotNull()
        # a..d count from the group's start: rank r is below, on or above a bound
        new_lo = F.when(r >= F.col("d"), F.col("nhi")).when(r >= F.col("b"), F.col("nlo")) \
            .otherwise(F.col("lo"))
        new_hi = F.when(r < F.col("a"), F.col("nlo")).when(r < F.col("c"), F.col("nhi")) \
            .otherwise(F.col("hi"))
        first = F.when(r >= F.col("d"), F.col("d")).when(r >= F.col("b"), F.col("b")) \
            .otherwise(F.col("below"))
        end = F.when(r < F.col("a"), F.col("a")).when(r < F.col("c"), F.col("c")) \
            .otherwise(F.col("below") + F.col("within"))
        hit = F.when((r >= F.col("a")) & (r < F.col("b")), F.col("nlo")) \
            .when((r >= F.col("c")) & (r < F.col("d")), F.col("nhi"))
        left = end - first
        state = cut_lineage(_join(bounds, cnt, g + ["slot"]).select(
            *g, "slot", F.when(done, F.col("lo")).otherwise(new_lo).alias("lo"),
            F.when(done, F.col("hi")).otherwise(new_hi).alias("hi"),
            F.when(done, F.col("below")).otherwise(first).alias("below"),
            F.when(done, F.col("within")).otherwise(left).alias("within"), "r",
            F.coalesce("val", hit).alias("val"),
            # no narrower by at least a tenth: halve the values next time
            (left > 0.9 * F.col("within")).alias("stuck")))
    else:
        raise RuntimeError("quantile brackets did not become small")
    rows = _attach(base, state, g, groups, k)
    in_slot = F.filter("b", lambda b: (b["lo"].isNull() | (x > b["lo"]))
                       & (b["hi"].isNull() | (x < b["hi"])) & b["val"].isNull())
    sel = (rows.select(*g, "__x", F.explode(in_slot).alias("s"))
           .groupBy(*g, F.col("s.slot").alias("slot"))
           .agg(F.sort_array(F.collect_list("__x")).alias("v")))
    got = _join(state, sel, g + ["slot"], "left").select(
        *g, "slot", F.coalesce("val", F.try_element_at(
            "v", (F.col("r") - F.col("below") + 1).cast("int"))).alias("v"))
    q = F.floor(F.col("slot") / 2).cast("int")
    pair = got.groupBy(*g, q.alias("q_idx")).agg(
        F.max(F.when(F.col("slot") % 2 == 0, F.col("v"))).alias("v0"),
        F.max(F.when(F.col("slot") % 2 == 1, F.col("v"))).alias("v1"))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("q_idx") + 1)
    at = F.col("prob") * (F.col("__n") - 1)
    pair = pair.withColumn("prob", prob)
    pair = _join(pair, counts, g) if g else pair.withColumn("__n", F.lit(counts.first()["__n"]))
    return pair.select(*g, "q_idx", "prob",
                       _lerp(F.col("v0"), F.col("v1"), at - F.floor(at)).alias("value"))


def quantile_values(df: DataFrame, value_col: str, probs: Sequence[float]) -> list:
    """Global exact quantiles as a Python list (``len(probs)`` values; None
    when the column has no values). The result is ``len(probs)`` rows."""
    rows = exact_quantiles(df, value_col, probs).collect()
    got = {r["q_idx"]: r["value"] for r in rows}
    return [got.get(i) for i in range(len(probs))]


def median_value(df: DataFrame, value_col: str):
    return quantile_values(df, value_col, [0.5])[0]
