"""Corpus pipeline over ``documents``.

Stages, in order: quality rules (documents that fail go), exact dedup (the
largest id of equal texts stays), SimHash near-dedup (the smallest id of each
group of linked fingerprints stays), personal data (spans are masked in the
text), best-fit packing (pieces of fixed-length sequences).

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents
that its predecessor kept. ``run`` writes each stage's result as Parquet under
the session's checkpoint folder and reads it back as the next one's input, so
a lost executor never costs more than the running stage. All but the last
return the columns of ``documents``.

SQL cannot express the SimHash, tagging and packing stages, so there is no
``ORACLE_SQL``; the tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import exact_dedup, packing, pii, quality_rules, simhash
from cohort.llm.common import stage_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{stage_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
