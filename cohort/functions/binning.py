"""Binning expressions (B1-B6). Spark's ``Bucketizer`` is left-closed and
takes the top edge into the last bucket, so the closed side is owned here as
plain CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# ---------------------------------------------------------------------------
# Bin edges and labels that must equal the reference's.
FAMILY_TYPE_EDGES = (0, 1, 4, INF)                   # right-closed, labels 0,1,2
AGE_GROUP_EDGES = (-INF, 16, 32, 48, 64, INF)        # right-closed, labels 0..4
AGE_BAND5_EDGES = (0, 12, 20, 40, 60, 100)           # left-closed, labels 0..4
AGE_BAND7_EDGES = (0, 12, 20, 30, 40, 50, 60, 100)   # left-closed, text labels
AGE_BAND7_LABELS = ("0-12", "13-20", "21-30", "31-40", "41-50", "51-60", "60+")
FAMILY_TYPE_LABELS = ("Yalnız", "Küçük Aile (2-4)", "Büyük Aile (5+)")
FARE_QUINTILE_LABELS = ("Çok Düşük", "Düşük", "Orta", "Yüksek", "Çok Yüksek")
# ---------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v: float) -> Column:
    return F.lit(float(v))


def cut_right(c: Column | str, edges: Sequence[float],
              labels: Sequence | None = None) -> Column:
    """Right-closed bins (e0,e1], (e1,e2], ...; outside or null -> null."""
    x = _c(c).cast("double")
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > _lit(edges[i])) & (x <= _lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def cut_left(c: Column | str, edges: Sequence[float],
             labels: Sequence | None = None) -> Column:
    """Left-closed bins [e0,e1), [e1,e2), ...; the top edge itself, values
    outside and null -> null."""
    x = _c(c).cast("double")
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    expr = None
    for i in range(len(edges) - 1):
        cond = (x >= _lit(edges[i])) & (x < _lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def quantile_code(c: Column | str, edges: Column) -> Column:
    """Code of x against sorted distinct quantile edges (array column):
    number of edges strictly below x, minus one, floored at 0 (lowest edge
    included). Fewer than two distinct edges -> null."""
    x = _c(c).cast("double")
    below = F.size(F.filter(edges, lambda e: e < x))
    code = F.greatest(below - 1, F.lit(0))
    return F.when((F.size(edges) >= 2) & x.isNotNull(), code)


def quantile_label(c: Column | str, edges: Column, labels: Sequence[str]) -> Column:
    """Labelled quantile bins. When tied edges collapse, the label count
    no longer matches and the reference skips the feature; here the label
    list is indexed by code only when the edge count is complete."""
    code = quantile_code(c, edges)
    arr = F.array(*[F.lit(s) for s in labels])
    return F.when(F.size(edges) == len(labels) + 1, F.element_at(arr, code + 1))
