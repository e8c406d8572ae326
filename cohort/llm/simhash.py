"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of word shingles are compared exactly, all against all, without a
candidate filter that could lose a link: the distinct fingerprints are laid out
in cells by the population counts of three bit blocks, cells are cut into tiles
of bounded size, and a pair of tiles is skipped only if the counts of their
cells differ by more than the radius in sum, since then no pair in them can be
within it. Tile pairs are met by an equi-join on the cell (a tile is sent to
the half of the neighbouring cells that comes before its own), and a task
holds two tiles at a time: exclusive-or and bit counts in numpy.

A tile pair reports a spanning star of the links it finds, not the links, so a
family of n near copies costs rows in proportion to n. Components are joined
up by :mod:`cohort.llm.components`. Copies collapse to one fingerprint by a
combine before any comparison, so a text that a third of the rows share is one
entry. The comparison work itself grows with the square of the distinct
fingerprints, which the method implies; the population counts take off about
four fifths of it.

Defined results: null and word-free texts have fingerprint zero and link like
any other; a null id counts as smaller than any id, so a component that holds
one has a null id; repeated rows share a component; an empty table gives an empty
result; other columns are ignored (``keep`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import (chunks, column_bytes, cut_lineage, fresh, map_arrow,
                               text_or_empty)
from cohort.llm.components import connected_components

#: Bit blocks whose population counts name a cell.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Distances compared at once in a task.
COMPARE_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Params:
    shingle_words: int = 4
    max_bits: int = 4
    seed: int = 42
    tile: int = 2048


def fingerprint(text: bytes, p: Params) -> int:
    words = text.lower().split()            # ASCII letters and ASCII white space only
    if not words:
        return 0
    k = min(p.shingle_words, len(words))
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], p.seed) for a, b in zip(starts, ends[k - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(id, mark, fp): mark tells apart different texts under a repeated id."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            fp = np.array([fingerprint(t, p) for t in column_bytes(c)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [c.column(0), c.column(1), pa.array(fp.view(np.int64))], ["id", "mark", "fp"])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(text_or_empty()).alias("mark"), "text")
    return map_arrow(rows, run, "id long, mark long, fp long")


# -- tiles --------------------------------------------------------------------

def _cell(fp: str = "fp"):
    counts = [F.bit_count(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(
        F.lit((1 << width) - 1))) for at, width in BLOCKS]
    return (counts[0] * 10_000 + counts[1] * 100 + counts[2]).cast("int")


def cell_offsets(radius: int) -> list[int]:
    """Cell number differences of the half ball of the radius, zero included;
    the other half is the same pairs from their other side."""
    span = range(-radius, radius + 1)
    return [d[0] * 10_000 + d[1] * 100 + d[2] for d in product(span, span, span)
            if sum(map(abs, d)) <= radius and d >= (0, 0, 0)]


def tiles(nodes: DataFrame, p: Params) -> DataFrame:
    """(cell, sub, fps): distinct fingerprints in tiles of about ``p.tile``."""
    cells = nodes.select("fp", _cell().alias("cell"))
    # at most 22 * 22 * 23 cells exist, whatever the input
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / p.tile).alias("subs"))
    return (cells.join(F.broadcast(sizes), "cell")
            .groupBy("cell", F.pmod(F.xxhash64("fp"), "subs").cast("int").alias("sub"))
            .agg(F.collect_list("fp").alias("fps")))


def tile_pairs(t: DataFrame, p: Params) -> DataFrame:
    existing = F.broadcast(t.select("cell").distinct())
    offsets = F.array(*[F.lit(x) for x in cell_offsets(p.max_bits)])
    guests = t.select(F.explode(F.transform(offsets, lambda x: x + F.col("cell"))).alias("to"),
                      F.col("cell").alias("g_cell"), F.col("sub").alias("g_sub"),
                      F.col("fps").alias("b"))
    guests = guests.join(existing.withColumnRenamed("cell", "to"), "to", "left_semi")
    home = t.select(F.col("cell").alias("to"), "sub", F.col("fps").alias("a"))
    met = home.join(guests, "to").where("g_cell <> to OR g_sub >= sub")
    return met.select("a", "b", ((F.col("g_cell") == F.col("to"))
                                 & (F.col("g_sub") == F.col("sub"))).alias("same"))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i[k] and j[k]; label maps each entry to the
    smallest entry of its class and is kept fully compressed."""
    while True:
        a, b = label[i], label[j]
        if np.array_equal(a, b):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """Spanning star edges (entry, representative) of the links between two
    tiles, as fingerprints (uint64)."""
    both = a if same else np.concatenate([a, b])
    label = np.arange(len(both))
    step = max(1, COMPARE_AT_ONCE // max(1, len(b)))
    for s in range(0, len(a), step):
        near = np.bitwise_count(a[s:s + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            i += s
            if same:
                i, j = i[i < j], j[i < j]
            else:
                j = j + len(a)
            _merge(label, i, j)
    moved = np.nonzero(label != np.arange(len(both)))[0]
    return np.stack([both[moved], both[label[moved]]], axis=1)


def links(nodes: DataFrame, p: Params) -> DataFrame:
    """(u, v): star edges whose components are those of all links."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for r in range(batch.num_rows):
            a, b = (batch.column(k)[r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    for k in (0, 1))
            found.append(tile_links(a, b, batch.column(2)[r].as_py(), p.max_bits))
        e = np.concatenate(found).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])
    t = cut_lineage(tiles(nodes, p))
    return map_arrow(tile_pairs(t, p), run, "u long, v long")


def _clustered(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, fp) and the first row (id, mark) of each fp's component."""
    rows = cut_lineage(fingerprints(docs, p))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("first")))
    roots = cut_lineage(connected_components(links(nodes, p), "u", "v")
                        .withColumnRenamed("node", "fp"))
    linked = cut_lineage(nodes.join(roots, "fp"))
    firsts = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("head")))
    heads = linked.join(firsts, "root").select("fp", "head")
    per_fp = nodes.join(heads, "fp", "left").select(
        "fp", F.coalesce("head", "first").alias("head"))
    return rows, cut_lineage(per_fp)


def cluster(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    rows, per_fp = _clustered(docs, p)
    return rows.join(per_fp, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"))


def keep(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each component stays: the smallest id; all columns."""
    _, per_fp = _clustered(docs, p)
    mark, k_id, k_mark = (fresh(n, docs.columns) for n in ("text_mark", "__k_id", "__k_mark"))
    heads = per_fp.select(F.col("head.id").alias(k_id), F.col("head.mark").alias(k_mark)).distinct()
    tagged = docs.withColumn(mark, F.xxhash64(text_or_empty()))
    stay = tagged.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col(k_id))
                       & (F.col(mark) == F.col(k_mark)), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if not repeated.isEmpty():  # rows that repeat id and text are one document
        stay = stay.dropDuplicates(["doc_id", mark])
    return stay.drop(mark)
