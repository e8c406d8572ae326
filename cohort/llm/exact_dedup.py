"""Exact dedup: group by a 128-bit content hash, compare bytes inside the
groups, keep one stable id of each class of equal texts.

Plan (nothing is gathered per group, so a text that a third of the rows share
costs one partial-aggregate row per task):

1. ``groupBy(hash, text)`` with map-side combine. Grouping on the text itself
   is the byte comparison: two different texts under one hash stay two rows.
2. The classes, now without their texts, are combined per hash. A hash with one
   class needs no text any more; a hash with several (a collision) is resolved
   by joining the few affected rows on (hash, text).
3. Rows get their class by a join on the 16-byte hash. Only (row, hash, sha256)
   is shuffled, and AQE splits the partition of a hot hash.

Defined results: a null text is the empty text; equal texts keep the row with
the largest (``keep='max'``) or smallest id; rows that repeat both id and text
are copies of one document, count in ``group_size`` and all carry its
``keep_id``; :func:`deduplicate` keeps one of them. A null id is kept only if
all copies have null ids. An empty table gives an empty result. Columns beyond
id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import cut_lineage, fresh, text_or_empty

#: Column names of the result, in this order, after the id.
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def content_hash(text: Column) -> Column:
    """128 bits of content."""
    return F.unhex(F.md5(text.cast("binary")))


def _rows(docs: DataFrame, id_col: str, text_col: str, hash_fn) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), hash_fn(text).alias("h"), text.alias("t"))


def _classes(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_fn) -> DataFrame:
    """One narrow row per class of byte-equal texts: h, sha, keep_id, group_size."""
    pick = {"max": F.max, "min": F.min}[keep]
    by_text = _rows(docs, id_col, text_col, hash_fn).groupBy("h", "t").agg(
        pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return cut_lineage(by_text.select(
        "h", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"),
        "keep_id", "group_size"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: str = "max", hash_fn=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    classes = _classes(docs, id_col, text_col, keep, hash_fn)
    clash = cut_lineage(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"))
                        .where("classes > 1").select("h"))
    clashes = not clash.isEmpty()
    if clashes:
        classes = cut_lineage(classes.join(clash, "h", "left_anti"))
    narrow = docs.select(F.col(id_col).alias("id"), hash_fn(text).alias("h"),
                         F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    # both sides of this join are plain exchanges, so AQE can split a hot hash
    out = narrow.join(classes.drop("sha"), "h")
    if clashes:
        # different texts under one hash: these rows alone are matched by text
        pick = {"max": F.max, "min": F.min}[keep]
        hit = _rows(docs, id_col, text_col, hash_fn).join(clash, "h", "left_semi")
        by_text = hit.groupBy("h", "t").agg(pick("id").alias("keep_id"),
                                            F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(
            hit.join(by_text, ["h", "t"]).select(
                "h", "id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"),
                "keep_id", "group_size"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "max") -> DataFrame:
    """The rows that stay, one per class of equal texts, all columns."""
    sha, k_sha, k_id = (fresh(n, docs.columns) for n in ("content_sha256", "__k_sha", "__k_id"))
    keepers = _classes(docs, id_col, text_col, keep, content_hash).select(
        F.col("sha").alias(k_sha), F.col("keep_id").alias(k_id))
    tagged = docs.withColumn(
        sha, F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    stay = tagged.join(keepers, (F.col(sha) == F.col(k_sha))
                       & F.col(id_col).eqNullSafe(F.col(k_id)), "left_semi")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if not repeated.isEmpty():  # rows that repeat id and text are one document
        stay = stay.dropDuplicates([id_col, sha])
    return stay.drop(sha)
