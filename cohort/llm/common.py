"""Helpers shared by the text operators: table access, Arrow string buffers
as numpy arrays, bounded working chunks, and the label split."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401  (general helpers)

#: Text handled at once inside a task; bounds the arrays derived from it.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors for written stage tables: the
    session's checkpoint folder, as the URI Spark knows it by."""
    return ensure_checkpoint_dir(spark)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels may not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into batches of ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, int64 offsets of n+1 rows) of a string array; a null
    row is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None and o[-1] > o[0] \
        else np.zeros(0, np.uint8)
    return raw, o - o[0]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of that name, in any case as Spark resolves it; an absent
    one is an error."""
    names = [n.lower() for n in batch.schema.names]
    if name.lower() not in names:
        raise KeyError(f"no column {name!r} in {batch.schema.names}")
    return batch.column(names.index(name.lower()))


def chunks(batch: pa.RecordBatch, column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts sum to at most ``limit`` bytes (a
    longer single text is a slice of its own)."""
    _, offs = utf8_buffer(column_of(batch, column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def column_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes per row, null as empty."""
    raw, offs = utf8_buffer(column_of(batch, column))
    data, o = raw.tobytes(), offs.tolist()
    return [data[a:b] for a, b in zip(o[:-1], o[1:])]


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return column_of(batch, column)


def fresh(base: str, taken: list[str]) -> str:
    """A column name that no column in ``taken`` has (case-insensitive)."""
    low, name = {t.lower() for t in taken}, base
    while name.lower() in low:
        name += "_"
    return name
