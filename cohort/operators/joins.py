"""Lookup joins with a checked broadcast and a hot-key split.

A lookup table (one row per key) is broadcast only when its counted size is
under ``BROADCAST_ROWS``. Beyond that, rows are shuffle-joined; keys that
hold many rows (known from a count column) are split off and attached by a
broadcast of the hot keys alone, whose number is bounded by
``total_rows / hot_threshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.session import cut_lineage

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 << 20
HOT_KEYS_MAX = 100_000


def broadcast_fits(table: DataFrame, rows: int | None = None) -> bool:
    """True if the table's counted rows and bytes (16 a value, and the length
    of every string) are within the bounds."""
    if rows is not None and rows > BROADCAST_ROWS:
        return False
    text = [c for c, t in table.dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(16 * len(table.columns)))
    n, total = table.agg(F.count(F.lit(1)), F.sum(size.cast("bigint"))).first()
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def lookup_join(df: DataFrame, table: DataFrame, on: list[str] | str,
                table_rows: int | None = None, how: str = "left") -> DataFrame:
    """Attach ``table`` (unique on ``on``) to ``df``; broadcast when its
    counted rows and bytes are within bounds, else a shuffle join (AQE splits
    skewed partitions of ``df``)."""
    return df.join(F.broadcast(table) if broadcast_fits(table, table_rows) else table, on, how)


def group_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with one row per group in ``table``, in which a null group
    is a group; broadcast within the same bounds."""
    right = table.withColumnsRenamed({k: f"__r_{k}" for k in on})
    if broadcast_fits(right):
        right = F.broadcast(right)
    cond = F.col(on[0]).eqNullSafe(F.col(f"__r_{on[0]}"))
    for k in on[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, cond).drop(*[f"__r_{k}" for k in on])


def attach_counts(df: DataFrame, key: str, name: str,
                  total_rows: int | None = None) -> DataFrame:
    """W1 at scale: every row gets the number of rows sharing its key
    (null key -> null), without a window that sends a hot key to one task.

    Counting is a partial (map-side) aggregation. The count table is
    broadcast when small; otherwise hot keys (count >= threshold, at most
    HOT_KEYS_MAX of them) are broadcast-joined and the rest shuffle-joined.
    """
    # written once (shared checkpoint folder): the size check and the join
    # read the same aggregate instead of scanning the input twice for it
    counts = cut_lineage(df.where(F.col(key).isNotNull()).groupBy(key)
                         .agg(F.count(F.lit(1)).alias(name)))
    if broadcast_fits(counts):
        return df.join(F.broadcast(counts), key, "left")
    total = df.count() if total_rows is None else total_rows
    threshold = max(1, total // HOT_KEYS_MAX)
    hot = counts.where(F.col(name) >= threshold)
    cold = counts.where(F.col(name) < threshold)
    tagged = df.join(F.broadcast(hot), key, "left")
    hot_rows = tagged.where(F.col(name).isNotNull())
    rest = tagged.where(F.col(name).isNull())
    cold_rows = rest.where(F.col(key).isNotNull()).drop(name).join(cold, key, "left")
    # rows without a key go round the join instead of to one task of it
    return hot_rows.unionByName(cold_rows).unionByName(rest.where(F.col(key).isNull()))
