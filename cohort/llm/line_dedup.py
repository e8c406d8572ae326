"""Line dedup: drop lines whose key is found in many documents, and return the
decision as one compressed keep bitmap per document.

A line's key is the line without the white space at both ends, A-Z
lower-cased. Plan:

1. One row per line with a non-empty key: md5 of the key, document, position.
   Lines are hashed where the text lies; no line text is shuffled.
2. The rows are range-partitioned by (hash, document) and sorted by (hash,
   document, position), so a line that a third of all documents share spreads
   over many tasks. One pass over each sorted partition counts the first
   occurrence of a key in every document and lets the rows of a key go on as
   soon as it is known to be frequent; at most ``min_docs - 1`` documents of the
   current key are held back.
3. A key that crosses a partition edge is settled by one small row per edge.
4. The dropped positions become one bitmap per document, and the bitmaps meet
   the texts in one join. Texts move once and lines never.

Defined results: a null text is the empty text, which is one empty line; empty
lines have no key and always stay. Rows alike in id and text are one document
(counted once, all treated alike); rows alike in the id only are different
documents; a null id is an id. With ``keep_first`` the first line of a frequent
key, by document id (null first) and position, stays. An empty table gives an
empty result. Columns beyond id and text pass through :func:`clean`, whatever
their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohort.llm.common import chunks, column_bytes, cut_lineage, fresh, text_or_empty

SPACE = b" \t\n\x0b\x0c\r"
#: Kinds of rows that the pass over the sorted lines emits.
DROP, CANDIDATE, EDGE = 0, 1, 2


@dataclass(frozen=True)
class Params:
    min_docs: int = 10          # documents that make a key frequent
    min_chars: int = 1          # code points of a key that counts at all
    keep_first: bool = False    # the first line of a frequent key stays


def _mark(id_col: str, text: Column) -> Column:
    """64 bits over id and text; with the id itself it tells documents apart."""
    return F.xxhash64(F.col(id_col), text)


def _keys(data: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines that have a key."""
    for i, line in enumerate(data.lower().split(b"\n")):  # bytes.lower: A-Z only
        key = line.strip(SPACE)
        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
            yield i, key


def _lines(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """h, doc, mark, pos: one row per line with a key."""
    text = text_or_empty(text_col)
    src = docs.select(F.col(id_col).alias("doc"), _mark(id_col, text).alias("mark"),
                      text.alias("text"))
    fields = T.StructType([T.StructField("h", T.BinaryType()), src.schema["doc"],
                           T.StructField("mark", T.LongType()), T.StructField("pos", T.IntegerType())])
    schema = to_arrow_schema(fields)
    min_chars = p.min_chars

    def run(batches):
        for b in batches:
            for part in chunks(b):
                row, pos, hashes = [], [], []
                for r, data in enumerate(column_bytes(part)):
                    for i, key in _keys(data, min_chars):
                        row.append(r)
                        pos.append(i)
                        hashes.append(hashlib.md5(key).digest())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.binary()), part.column(0).take(at),
                     part.column(1).take(at), pa.array(pos, pa.int32())], schema=schema)
    return src.mapInArrow(run, fields)


class _Stream:
    """One sorted partition, batch by batch. ``docs`` counts the documents of
    the open key; its rows are held back until it is frequent."""

    def __init__(self, p: Params, schema: pa.Schema):
        self.need, self.keep_first, self.schema = p.min_docs, p.keep_first, schema
        self.last = None        # last row seen, as a one-row batch
        self.docs, self.first = 0, True
        self.held: list[pa.RecordBatch] = []
        self.lead: list[pa.RecordBatch] = []

    def rows(self, kind: int, t: pa.RecordBatch, docs: int | None = None) -> pa.RecordBatch:
        n = t.num_rows
        h = pa.nulls(n, pa.binary()) if kind == DROP else t.column("h")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), h, t.column("doc"), t.column("mark"),
             t.column("pos"), pa.array([docs] * n, pa.int64())], schema=self.schema)

    def changes(self, t: pa.RecordBatch, name: str) -> np.ndarray:
        """True where a row's value differs from the row before."""
        col = t.column(name)
        if self.last is not None:
            col = pa.concat_arrays([self.last.column(name), col])
        a, b = col[1:], col[:-1]
        ne = pc.fill_null(pc.not_equal(a, b), False)
        ne = pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        return ne if self.last is not None else np.concatenate([[True], ne])

    def close(self, at_end: bool = False) -> Iterator[pa.RecordBatch]:
        """The open key ends: at an edge of the partition it is settled later."""
        if self.last is None:
            return
        if self.first or at_end:
            yield self.rows(EDGE, self.last, self.docs)
            if self.docs < self.need:
                for t in self.held:
                    yield self.rows(CANDIDATE, t)
            for t in self.lead:
                yield self.rows(CANDIDATE, t, 1)
        self.docs, self.first, self.held, self.lead = 0, False, [], []

    def feed(self, t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = self.changes(t, "h")
        fresh_doc = new | self.changes(t, "mark") | self.changes(t, "doc")
        # a document of several rows has its lines several times
        own = fresh_doc | self.changes(t, "pos")
        if not own.all():
            t, new, fresh_doc = t.filter(pa.array(own)), new[own], fresh_doc[own]
            if not t.num_rows:
                return
        if new[0]:
            yield from self.close()
        starts = np.flatnonzero(new)
        # run 0 is the key that is open when the batch begins
        begin = 1 if new[0] else 0
        run = np.cumsum(new) - begin
        docs = np.bincount(run, weights=fresh_doc).astype(np.int64)
        docs[0] += self.docs
        frequent = docs >= self.need
        lead = np.zeros(t.num_rows, bool)
        if self.keep_first:
            lead[starts] = True
        emit = frequent[run] & ~lead
        ends = int(starts[begin]) if len(starts) > begin else t.num_rows   # of run 0
        last = int(run[-1])
        opens = int(starts[-1]) if last else 0          # where the last run begins
        if frequent[0] and self.held:
            yield from (self.rows(DROP, h) for h in self.held)
            self.held = []
        if emit.any():
            yield self.rows(DROP, t.filter(pa.array(emit)))
        if not frequent[0]:
            self._hold(t, np.flatnonzero(~lead[:ends]))
        if lead[0]:
            self.lead = [t.slice(0, 1)]
        self.docs, self.last = int(docs[0]), t.slice(ends - 1, 1)
        if last:        # run 0 has ended in this batch
            yield from self.close()
            if not frequent[last]:
                self._hold(t, opens + np.flatnonzero(~lead[opens:]))
            if lead[opens]:
                self.lead = [t.slice(opens, 1)]
            self.docs, self.last = int(docs[last]), t.slice(t.num_rows - 1, 1)

    def _hold(self, t: pa.RecordBatch, rows: np.ndarray) -> None:
        if len(rows):
            self.held.append(t.take(pa.array(rows)))


def _dropped(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """doc, mark, pos of every line that goes (rows may repeat)."""
    lines = _lines(docs, id_col, text_col, p)
    ranged = lines.repartitionByRange("h", "doc", "mark") \
        .sortWithinPartitions("h", "doc", "mark", "pos")
    fields = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("h", T.BinaryType()),
                           *lines.schema.fields[1:], T.StructField("docs", T.LongType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        s = _Stream(p, schema)
        for b in batches:
            if b.num_rows:
                yield from s.feed(b)
        yield from s.close(at_end=True)
    # read three times below; range edges come from sampling
    out = cut_lineage(ranged.mapInArrow(run, fields))
    row = F.struct("doc", "mark", "pos")
    edges = out.where(F.col("kind") != DROP).groupBy("h").agg(
        F.sum(F.when(F.col("kind") == EDGE, F.col("docs"))).alias("total"),
        F.min(F.when((F.col("kind") == CANDIDATE) & F.col("docs").isNotNull(), row)).alias("lead"))
    late = out.where(F.col("kind") == CANDIDATE).drop("kind", "docs").join(edges, "h") \
        .where((F.col("total") >= p.min_docs) & ~row.eqNullSafe(F.col("lead")))
    return out.where(F.col("kind") == DROP).select("doc", "mark", "pos").unionByName(
        late.select("doc", "mark", "pos"))


def pack_bits(dropped: list[int]) -> bytes:
    """Keep bits of a document's lines up to the last one that goes, filled up
    to whole bytes with ones (the lines after it stay), compressed."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """One boolean a line, true if it stays; no bitmap: all stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 params: Params = Params()) -> DataFrame:
    """doc, mark (64 bits over id and text), bitmap, n_dropped: one row per
    document that loses a line."""
    drops = _dropped(docs, id_col, text_col, params)
    lists = drops.groupBy("doc", "mark").agg(F.collect_list("pos").alias("pos"))
    fields = T.StructType([*lists.schema.fields[:2], T.StructField("bitmap", T.BinaryType()),
                           T.StructField("n_dropped", T.LongType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            pos = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([pack_bits(x) for x in pos], pa.binary()),
                 pa.array([len(set(x)) for x in pos], pa.int64())], schema=schema)
    return lists.mapInArrow(run, fields)


def _marked(docs: DataFrame, id_col: str, text_col: str, params: Params) -> tuple[DataFrame, str]:
    """The rows with their bitmap (null: nothing goes) in a column of a new name."""
    bits = keep_bitmaps(docs, id_col, text_col, params)
    names = list(docs.columns)
    mark, doc, other, bitmap = (fresh(n, names)
                                for n in ("__mark", "__doc", "__other_mark", "keep_bitmap"))
    left = docs.withColumn(mark, _mark(id_col, text_or_empty(text_col)))
    right = bits.select(F.col("doc").alias(doc), F.col("mark").alias(other),
                        F.col("bitmap").alias(bitmap))
    out = left.join(right, (F.col(mark) == F.col(other))
                    & F.col(id_col).eqNullSafe(F.col(doc)), "left")
    return out.drop(mark, other, doc), bitmap


def _apply(data: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """(kept lines, number of lines, number of lines that go) of one text."""
    if bitmap is None:
        return data, data.count(b"\n") + 1, 0
    lines = data.split(b"\n")
    keep = unpack_bits(bitmap, len(lines))
    stay = [x for x, k in zip(lines, keep.tolist()) if k]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           params: Params = Params()) -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, kept_sha256."""
    rows, bitmap = _marked(docs.select(id_col, text_col), id_col, text_col, params)
    src = rows.select(F.col(id_col), F.col(text_col).alias("text"), F.col(bitmap).alias("bits"))
    fields = T.StructType([src.schema.fields[0], T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        for b in batches:
            for part in chunks(b):
                got = [_apply(*x) for x in zip(column_bytes(part), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n, _ in got], pa.int64()),
                     pa.array([d for _, _, d in got], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in got], pa.string())],
                    schema=schema)
    return src.mapInArrow(run, fields)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          params: Params = Params()) -> DataFrame:
    """All rows and columns, the text without the lines that go; a null text
    stays null."""
    rows, bitmap = _marked(docs, id_col, text_col, params)

    @F.pandas_udf("string")
    def cut(text: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or b is None else _apply(t.encode(), b)[0].decode()
                          for t, b in zip(text, bits)], dtype=object)
    return rows.withColumn(text_col, cut(F.col(text_col), F.col(bitmap))).select(*docs.columns)
