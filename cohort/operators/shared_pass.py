"""Training passes shared by many fits.

Cross-validation, grids and ensembles fit the same model kind many times on
overlapping rows. Here all fits of a kind advance together: the matrix is packed
once into blocks of bounded size, and each pass is one Spark job in which every
task works on its blocks for all fits (a fit's rows are a mask over the block)
and emits small partial sums; these meet by unit (a fit, or a few nodes of a
tree) in a shuffle, where they are added in a fixed order. Only what the reduce
step makes of a unit goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.session import cut_lineage

#: Rows of a packed block.
BLOCK_ROWS = 131_072
#: Partitions whose partial sums are added at once (a power of two); with more
#: blocks they are added in two steps.
FAN_IN = 64
#: Partial sums of a pass that may be added on the driver: little, since a boosted
#: model takes hundreds of passes.
DRIVER_BYTES = 2 << 20
#: Bits of a block's number that count within its partition.
PART_BITS = 24


@dataclass(frozen=True)
class Fit:
    """One fit: parameters, and the rows it leaves out - those with the given
    value in a column, for any of the (column, value) pairs."""
    params: dict
    out: tuple = ()


@dataclass
class Block:
    """Rows of a task: features, label (0 or 1), hash of the id, and the
    columns that fits leave rows out by."""
    x: np.ndarray
    y: np.ndarray
    key: np.ndarray
    splits: dict = field(default_factory=dict)
    state: np.ndarray | None = None

    def rows(self, fit: Fit) -> np.ndarray:
        """Indices of the rows that a fit learns from."""
        keep = np.ones(len(self.y), bool)
        for c, v in fit.out:
            keep &= self.splits[c] != v
        return np.flatnonzero(keep)


@dataclass
class Packed:
    """A training matrix as written blocks: features as doubles, or as what
    ``recode`` made of them."""
    df: DataFrame
    n_blocks: int
    n_rows: int
    dims: int
    cols: list
    dtype: type = np.float64
    made: dict = field(default_factory=dict)    # what learners derive from it once


SCHEMA = "part long, n long, x binary, y binary, key binary, splits binary, state binary"


def split_columns(fits: list[Fit]) -> list[str]:
    return sorted({c for f in fits for c, _ in f.out})


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def pack(data: DataFrame | Packed, cols: Sequence[str], label: str = "label",
         id_col: str = "id") -> Packed:
    """The labelled rows as blocks, written; ``cols`` are the columns that
    fits leave rows out by. Labels other than 0 and 1 raise an error, and so does
    a frame without labelled rows."""
    if isinstance(data, Packed):
        return data
    cols = list(cols)
    f = vector_to_array("features")
    key = F.xxhash64(id_col) if id_col in data.columns else F.xxhash64(f)
    src = data.where(F.col(label).isNotNull()).select(
        f.alias("f"), F.col(label).cast("double").alias("y"), key.alias("k"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"s{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId() << PART_BITS, [], 0
        for b in batches:
            for s in range(0, b.num_rows, BLOCK_ROWS):
                piece = b.slice(s, BLOCK_ROWS)
                if n + piece.num_rows > BLOCK_ROWS and held:
                    yield block(part, held)
                    part, held, n = part + 1, [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield block(part, held)

    def block(part: int, held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        y = t.column("y").to_numpy()
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        x = np.ascontiguousarray(matrix(t.column("f")), np.float64)
        splits = np.array([t.column(f"s{i}").to_numpy() for i in range(len(cols))], np.int64)
        row = {"part": part, "n": len(y), "x": x.tobytes(), "y": y.astype(np.uint8).tobytes(),
               "key": t.column("k").to_numpy().tobytes(), "splits": splits.tobytes(), "state": None}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)
    df = cut_lineage(src.mapInArrow(run, SCHEMA))
    blocks_, rows, width = df.agg(F.count(F.lit(1)), F.sum("n"),
                                  F.max(F.octet_length("x") / F.col("n"))).first()
    if not rows:
        raise ValueError("no labelled rows to learn from")
    return Packed(df, blocks_, rows, int(width) // 8, cols)


def recode(packed: Packed, encode: Callable[[np.ndarray], np.ndarray], dtype: type) -> Packed:
    """The same blocks with other feature arrays, written."""
    cols, was = packed.cols, packed.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, block in blocks(batches, cols, was):
            blob = np.ascontiguousarray(encode(block.x), dtype).tobytes()
            yield row.set_column(row.schema.get_field_index("x"), "x", pa.array([blob], pa.binary()))
    return replace(packed, df=cut_lineage(packed.df.mapInArrow(run, SCHEMA)), dtype=dtype)


_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()),
                    ("key", pa.binary()), ("splits", pa.binary()), ("state", pa.binary())])


def blocks(batches: Iterator[pa.RecordBatch], cols: list[str],
           dtype: type) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    """(one-row batch, block number, block) of a packed partition."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            r = {c: row.column(c)[0] for c in row.schema.names}
            part, n = r["part"].as_py(), r["n"].as_py()

            def array(name: str, kind: type, r: dict = r) -> np.ndarray:
                return np.frombuffer(r[name].as_buffer(), kind)     # as it lies in the batch
            splits = array("splits", np.int64).reshape(len(cols), n)
            state = array("state", np.float64).reshape(-1, n) if r["state"].is_valid else None
            yield row, part, Block(
                array("x", dtype).reshape(n, -1), array("y", np.uint8),
                array("key", np.int64).view(np.uint64), dict(zip(cols, splits)), state)


def collected(packed: Packed) -> list[tuple[bytes, ...]]:
    """The blocks of a small matrix on the driver, in order: x, y, key, splits."""
    got = packed.df.select("part", *HELD).toArrow().sort_by("part")
    return list(zip(*(got.column(c).to_pylist() for c in HELD)))


HELD = ("x", "y", "key", "splits")


def held_blocks(held: list[tuple[bytes, ...]], cols: list[str], dtype: type) -> list[Block]:
    """The blocks that ``collected`` gave."""
    out = []
    for x, y, key, splits in held:
        n = len(y)
        out.append(Block(np.frombuffer(x, dtype).reshape(n, -1), np.frombuffer(y, np.uint8),
                         np.frombuffer(key, np.int64).view(np.uint64),
                         dict(zip(cols, np.frombuffer(splits, np.int64).reshape(len(cols), n)))))
    return out


class Units:
    """What a pass emits: per unit a sum of arrays, as bytes. ``add`` takes
    the running sum (None at first) and a partial; ``end`` makes the result."""

    def add(self, unit: int, total, blob: bytes):
        part = np.frombuffer(blob, np.float64)
        return part.copy() if total is None else np.add(total, part, out=total)

    def dump(self, unit: int, total) -> bytes:
        return total.tobytes()

    def end(self, unit: int, total) -> bytes:
        return total.tobytes()


def _added(partials: DataFrame, sums: Units, last: bool, n_units: int) -> DataFrame:
    """Partials of a unit added in block order; those of ``FAN_IN`` partitions
    at a time if this is not the last step."""
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = 63 if last else PART_BITS + FAN_IN.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, total = None, 0, None
        for b in batches:
            for u, p, blob in zip(*(c.to_pylist() for c in b.columns)):
                if (u, p >> shift) != at:
                    if at is not None:
                        yield one(at[0], part, total)
                    at, part, total = (u, p >> shift), p, None
                total = sums.add(u, total, blob)
        if at is not None:
            yield one(at[0], part, total)

    def one(unit: int, part: int, total) -> pa.RecordBatch:
        return _partial(unit, part, sums.end(unit, total) if last else sums.dump(unit, total))
    keys = ["unit"] if last else ["unit", F.shiftright("part", shift)]
    n = max(1, min(n_units, parts))
    return partials.repartition(n, *keys).sortWithinPartitions("unit", "part").mapInArrow(run, PARTIAL)


PARTIAL = "unit long, part long, blob binary"


def _partial(unit: int, part: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([part], pa.int64()),
                                       pa.array([blob], pa.binary())], ["unit", "part", "blob"])


def run_pass(packed: Packed, work: Callable[[Block], Iterator[tuple[int, bytes]]], sums: Units,
             n_units: int, unit_bytes: int) -> dict[int, bytes]:
    """One pass: ``work`` yields (unit, partial) of a block, and the result is
    what ``sums.end`` makes of each unit. ``unit_bytes`` bounds the partials of a
    block: where those of all blocks are at most ``DRIVER_BYTES`` they are added on
    the driver (one stage), else in a shuffle, both in block order."""
    cols, dtype = packed.cols, packed.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, block in blocks(batches, cols, dtype):
            for unit, blob in work(block):
                yield _partial(unit, part, blob)
    partials = packed.df.mapInArrow(run, PARTIAL)
    if packed.n_blocks * unit_bytes <= DRIVER_BYTES:
        got = partials.toArrow()
        rows = sorted(zip(*(got.column(c).to_pylist() for c in ("unit", "part", "blob"))))
        totals: dict = {}
        for unit, _, blob in rows:
            totals[unit] = sums.add(unit, totals.get(unit), blob)
        return {u: sums.end(u, t) for u, t in totals.items()}
    if packed.n_blocks > FAN_IN:
        partials = _added(partials, sums, False, n_units * -(-packed.n_blocks // FAN_IN))
    out = _added(partials, sums, True, n_units).toArrow()
    return dict(zip(out.column("unit").to_pylist(), out.column("blob").to_pylist()))


def with_state(packed: Packed, state: Callable[[Block], np.ndarray]) -> Packed:
    """The blocks with an array of one row per fit beside them, written."""
    cols, dtype = packed.cols, packed.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, block in blocks(batches, cols, dtype):
            blob = np.ascontiguousarray(state(block), np.float64).tobytes()
            yield row.set_column(row.schema.get_field_index("state"), "state", pa.array([blob], pa.binary()))
    return replace(packed, df=cut_lineage(packed.df.mapInArrow(run, SCHEMA)))
