"""Scoring of arriving records with a fitted scorer.

``readStream`` (Parquet files) -> the fitted feature pipeline (``bins='fitted'``
so quartile bins and ticket counts come from the fitted state, not from the
micro-batch) -> matrix preparation -> model -> sink. The checkpoint location
lives under the shared checkpoint folder, so a restarted query resumes exactly
once.

A model that is one expression per row is written by ``writeStream`` itself. A
model that joins or writes its rows (k-NN, and an ensemble that holds one) scores
each micro-batch as a batch (``foreachBatch``) against its fitted index; a batch is
written to a folder of its own number, so a batch that runs again replaces its rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cohort.operators.score import Scorer


def score_stream(spark: SparkSession, scorer: Scorer, source_dir: str, schema: str,
                 sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1,
                 id_col: str = "id") -> None:
    """Run the scoring stream over everything available, then stop."""
    src = (spark.readStream.schema(schema)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    if scorer.per_row:
        out = scorer.score(src, id_col).writeStream.format("parquet").outputMode("append") \
            .option("path", sink_dir)
    else:
        def write(batch: DataFrame, number: int) -> None:
            scorer.score(batch, id_col).write.mode("overwrite").parquet(
                os.path.join(sink_dir, f"batch={number}"))
        out = src.writeStream.foreachBatch(write)
    q = (out.option("checkpointLocation", os.path.join(checkpoint_dir, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).drop("batch")
