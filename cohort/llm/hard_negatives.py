"""Hard-negative mining over embeddings by angular triangle filtering.

Vectors are quantised (floor of ``scale`` times each component), and the score
of two rows is the exact integer inner product. For every anchor the first
``positives`` rows of its label are its positives; for every positive the first
``negatives`` rows of other labels whose score lies within ``low`` to ``high``
percent of the positive's score are the hard negatives. Higher scores come
first, ties go by id.

Plan:

1. Reference directions are fitted on a bounded sample (spherical k-means on
   ``sample_rows`` rows chosen by an id hash). Every row is indexed: its norm and
   its angles to all directions are stored with it, and the rows are
   range-partitioned by (nearest direction, angle, id), so a frequent vector
   spreads over tasks. The index is written once.
2. Anchors are a stated query set. They meet all rows a block at a time; a block
   of at most about ``anchor_block`` anchors is broadcast and the rows do not
   move. Beside d(a, r) and d(r, x), the angles to direction r, the angle of
   anchor and row lies in |d(a, r) - d(r, x)| to min(d(a, r) + d(r, x), 2 pi - the
   sum). Over all directions that gives an interval, widened for rounding,
   whose cosines times both norms bound the score. First whole chunks of rows,
   then rows are left out where the bounds do not reach an open window (positives: from
   the current last one up; negatives: the windows, from the current last one
   up). Only the rest is scored.
3. Each task returns its best rows per anchor (and window), and one aggregate
   per anchor keeps the first of all. Of many partitions every n-th (n: the root
   of their number) is met first; what it gives bounds from below what the others
   need to return, so that rows returned grow with the root. Nothing is capped:
   the bounds are safe, so the result is that of scoring all pairs.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. An id is one row: of rows that repeat an id the one
with the smallest label, then vector counts. Shorter vectors are filled with
zeros; an empty vector scores 0. A score beyond 64 bits raises an error. An empty table,
or one without anchors, gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohort.llm.common import cut_lineage

#: Radians by which an angle may be off (arccos near 0 loses half the digits).
ANGLE_SLACK = 1e-6
#: Share of the product of norms by which a bound may be off.
SCORE_SLACK = 1e-9
#: Rows of a task that meet the anchors at once.
CHUNK_ROWS = 1024
EXACT = 2.0 ** 53


@dataclass(frozen=True)
class Params:
    positives: int = 5
    negatives: int = 10
    low: int = 30               # percent of the positive's score
    high: int = 90
    scale: int = 256
    directions: int = 8         # reference directions
    sample_rows: int = 4096     # rows that the directions are fitted on
    anchor_block: int = 2048    # anchors broadcast at once
    task_rows: int = 8192       # indexed rows per task


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled with zeros."""
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offs)
    if (size == dims).all():
        return flat[offs[0]:offs[-1]].reshape(len(col), dims)
    out = np.zeros((len(col), dims))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], size)] = flat[offs[0]:offs[-1]]
    return out


def _quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str,
               p: Params, anchor: Column) -> DataFrame:
    """id, label, q (array of whole doubles), anchor: the rows that take part."""
    ok = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  (NaN is larger)
    v = F.col(vector_col)
    out = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
                     & F.forall(v, ok)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        v.cast("array<double>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    if not out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("id", "r.*")
    scale = float(p.scale)
    # floor as a double: whole at any size
    return out.withColumn("q", F.transform("q", lambda x: F.rint(x * scale) - F.when(
        F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)))


def fit_directions(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors: spherical k-means from farthest-first starts."""
    norm = np.linalg.norm(x, axis=1)
    u = x[norm > 0] / norm[norm > 0, None]
    if not len(u):
        return np.eye(max(1, min(k, x.shape[1])), max(1, x.shape[1]))[:, :x.shape[1]]
    start, near = [0], u @ u[0]
    while len(start) < min(k, len(u)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, u @ u[start[-1]])
    c = u[start]
    for _ in range(rounds):
        own = np.argmax(u @ c.T, axis=1)
        s = np.stack([u[own == j].sum(axis=0) for j in range(len(c))])
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 1e-9, s / np.maximum(n, 1e-9)[:, None], c)
    return c


def angles(q: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a zero vector has the right angle
    to all (its bounds are zero by its norm)."""
    cos = (q / np.where(norm > 0, norm, 1.0)[:, None]) @ directions.T
    return np.arccos(np.clip(cos, -1.0, 1.0))


def bounds(a_ang: np.ndarray, a_norm: np.ndarray, x_ang: np.ndarray,
           x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of anchors x rows."""
    least = np.zeros((len(a_ang), len(x_ang)))
    most = np.full_like(least, np.pi)
    for r in range(a_ang.shape[1]):
        a, x = a_ang[:, r, None], x_ang[None, :, r]
        np.maximum(least, np.abs(a - x), out=least)
        s = a + x
        np.minimum(most, np.minimum(s, 2 * np.pi - s), out=most)
    n = a_norm[:, None] * x_norm[None, :]
    slack = n * SCORE_SLACK + 1e-6
    low = n * np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) - slack
    return low, n * np.cos(np.maximum(least - ANGLE_SLACK, 0.0)) + slack


def chunk_bounds(a_ang: np.ndarray, a_norm: np.ndarray, x_ang: np.ndarray,
                 x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same per anchor for all rows of a chunk together."""
    lo, hi = x_ang.min(axis=0), x_ang.max(axis=0)
    least = np.maximum(np.maximum(lo - a_ang, a_ang - hi), 0.0).max(axis=1)
    most = np.minimum(a_ang + hi, 2 * np.pi - a_ang - lo).min(axis=1)
    big, small = a_norm * x_norm.max(), a_norm * x_norm.min()
    slack = big * SCORE_SLACK + 1e-6
    up, down = np.cos(np.maximum(least - ANGLE_SLACK, 0.0)), np.cos(np.clip(most + ANGLE_SLACK, 0, np.pi))
    return (np.where(down < 0, big, small) * down - slack,
            np.where(up < 0, small, big) * up + slack)


def scores(a: np.ndarray, x: np.ndarray, a_norm: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Exact integer inner products, anchors x rows."""
    if a_norm.max(initial=0) * x_norm.max(initial=0) < EXACT:  # every partial sum is exact
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return (whole(a) @ whole(x).T).astype(np.int64)  # OverflowError beyond 64 bits


@dataclass
class Block:
    """A block of anchors: what a task needs to meet them."""
    id: np.ndarray
    code: np.ndarray        # number of the label
    q: np.ndarray
    norm: np.ndarray
    ang: np.ndarray
    labels: dict
    # windows (pass over negatives): anchors x positives
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Best:
    """The first ``k`` (score, id) pairs of each slot so far; ``floor`` is a
    score that the k-th of all rows has at least."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        s = np.concatenate([self.slot, slot])
        v, i = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -v, s))
        s, v, i = s[order], v[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        rank = np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))
        keep = rank < self.k
        self.slot, self.score, self.id = s[keep], v[keep], i[keep]
        full = rank == self.k - 1
        self.floor[s[full]] = np.maximum(self.floor[s[full]], v[full])


def _first_of(s: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """``ok`` without what is below the k-th largest score of its row."""
    if s.shape[1] <= k:
        return ok
    seen = np.where(ok, s, np.iinfo(np.int64).min)
    kth = np.partition(seen, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return ok & (s >= kth[:, None])


def meet_positives(b: Block, best: Best, ids, code, q, norm, ang) -> int:
    """A chunk of rows against the anchors; returns the number of pairs scored."""
    scored = 0
    up = chunk_bounds(b.ang, b.norm, ang, norm)[1]
    for c in np.unique(code[code >= 0]):
        a = np.flatnonzero((b.code == c) & (up >= best.floor))
        x = np.flatnonzero(code == c)
        if not len(a):
            continue
        near = bounds(b.ang[a], b.norm[a], ang[x], norm[x])[1] >= best.floor[a, None]
        near &= b.id[a, None] != ids[None, x]
        rows, cols = near.any(axis=1), near.any(axis=0)
        a, x, near = a[rows], x[cols], near[rows][:, cols]
        if not near.any():
            continue
        s = scores(b.q[a], q[x], b.norm[a], norm[x])
        scored += int(near.sum())
        i, j = np.nonzero(_first_of(s, near & (s >= best.floor[a, None]), best.k))
        best.add(a[i], s[i, j], ids[x[j]])
    return scored


def meet_negatives(b: Block, best: Best, ids, code, q, norm, ang) -> int:
    """The same for rows of other labels and the anchors' windows; slot
    a * windows + w."""
    n_w = b.low.shape[1]
    floor = np.maximum(best.floor.reshape(-1, n_w), b.low)
    low, up = chunk_bounds(b.ang, b.norm, ang, norm)
    a = np.flatnonzero(((up[:, None] >= floor) & (low[:, None] <= b.high)).any(axis=1))
    if not len(a):
        return 0
    low, up = bounds(b.ang[a], b.norm[a], ang, norm)
    other = b.code[a, None] != code[None, :]
    near = np.zeros(other.shape, bool)
    for w in range(n_w):
        near |= (up >= floor[a, w, None]) & (low <= b.high[a, w, None])
    near &= other
    rows, cols = near.any(axis=1), near.any(axis=0)
    a, near = a[rows], near[rows][:, cols]
    if not near.any():
        return 0
    x = np.flatnonzero(cols)
    s = scores(b.q[a], q[x], b.norm[a], norm[x])
    for w in range(n_w):
        ok = near & (s >= floor[a, w, None]) & (s <= b.high[a, w, None])
        i, j = np.nonzero(_first_of(s, ok, best.k))
        best.add(a[i] * n_w + w, s[i, j], ids[x[j]])
    return int(near.sum())


def _index(rows: DataFrame, p: Params, n: int, dims: int) -> DataFrame:
    """id, label, anchor, q, norm, ang: every row with its angles, written in
    the order of (nearest direction, angle, id)."""
    sample = rows.select("id", "q").orderBy(F.xxhash64("id"), "id").limit(p.sample_rows).toArrow()
    directions = fit_directions(_matrix(sample.column("q").combine_chunks(), dims), p.directions)
    fields = T.StructType([*(rows.schema[c] for c in ("id", "label", "anchor")),
                           T.StructField("q", T.ArrayType(T.DoubleType())),
                           T.StructField("norm", T.DoubleType()),
                           T.StructField("ang", T.ArrayType(T.DoubleType())),
                           T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])
    schema = to_arrow_schema(fields)

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1],
                                        pa.array(m.ravel()))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q"), dims)
            norm = np.linalg.norm(q, axis=1)
            ang = angles(q, norm, directions)
            cell = ang.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"), lists(q), pa.array(norm),
                 lists(ang), pa.array(cell), pa.array(ang[np.arange(len(ang)), cell])], schema=schema)
    parts = max(1, -(-n // p.task_rows))
    return cut_lineage(rows.mapInArrow(run, fields)
                       .repartitionByRange(parts, "cell", "near", "id")
                       .sortWithinPartitions("cell", "near", "id").drop("cell", "near"))


def _block(t: pa.Table, dims: int) -> Block:
    t = t.combine_chunks()
    label = t.column("label").to_pylist()
    labels = {v: i for i, v in enumerate(dict.fromkeys(label))}
    q = _matrix(t.column("q").combine_chunks(), dims)
    ang = t.column("ang").combine_chunks()
    return Block(t.column("id").to_numpy(), np.array([labels[v] for v in label], np.int64), q,
                 t.column("norm").to_numpy(), _matrix(ang, len(ang[0])), labels)


#: Fewer partitions are met in one step.
STEP_PARTITIONS = 16


def _pass(index: DataFrame, b: Block, floor: np.ndarray, k: int, dims: int, meet) -> DataFrame:
    """slot, score, id: each task's best rows for the anchors of a block."""
    shared = index.sparkSession.sparkContext.broadcast((b, floor))
    schema = pa.schema([("slot", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches):
        blk, best = shared.value[0], Best(shared.value[1], k)
        width = blk.ang.shape[1]
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK_ROWS):
                c = batch.slice(s, CHUNK_ROWS)
                code = np.array([blk.labels.get(v, -1) for v in c.column("label").to_pylist()], np.int64)
                meet(blk, best, c.column("id").to_numpy(), code, _matrix(c.column("q"), dims),
                     c.column("norm").to_numpy(), _matrix(c.column("ang"), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.slot), pa.array(best.score), pa.array(best.id)], schema=schema)
    return index.mapInArrow(run, "slot long, score long, id long")


def _meet(index: DataFrame, parts: int, b: Block, slots: int, k: int, dims: int, meet) -> DataFrame:
    """slot, score, id, rank: the first k rows of all for each slot."""
    floor = np.full(slots, np.iinfo(np.int64).min)
    if parts < STEP_PARTITIONS:
        return _firsts(_pass(index, b, floor, k, dims, meet), k)
    step = int(parts ** 0.5)
    early = F.spark_partition_id() % step == 0
    some = cut_lineage(_firsts(_pass(index.where(early), b, floor, k, dims, meet), k))
    last = some.where(F.col("rank") == k).select("slot", "score").toArrow()  # one a slot of the block
    floor[last.column("slot").to_numpy()] = last.column("score").to_numpy()
    rest = _pass(index.where(~early), b, floor, k, dims, meet)
    return _firsts(some.drop("rank").unionByName(rest), k)


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each slot over all tasks, with their rank from 1."""
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _windows(b: Block, top: pa.Table, p: Params) -> np.ndarray:
    """Ids and scores of the anchors' positives (anchors x positives x 2) from
    the first rows of all; sets the block's windows, empty where there is none."""
    n = len(b.id)
    pos = np.zeros((n, p.positives, 2), np.int64)
    low, high = np.ones((n, p.positives), np.int64), np.zeros((n, p.positives), np.int64)
    for slot, rank, score, i in zip(*(top.column(c).to_pylist() for c in ("slot", "rank", "score", "id"))):
        pos[slot, rank - 1] = i, score
        low[slot, rank - 1] = -(-p.low * score // 100)
        high[slot, rank - 1] = p.high * score // 100
    empty = low > high
    b.low = np.where(empty, np.iinfo(np.int64).max, low)
    b.high = np.where(empty, np.iinfo(np.int64).min, high)
    return pos


OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
       "negative_score long")


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; ``anchor`` tells which rows are anchors."""
    p, spark = params, rows.sparkSession
    part = _quantised(rows, id_col, label_col, vector_col, p, anchor)
    n, dims, n_anchors = part.agg(F.count(F.lit(1)), F.max(F.size("q")),
                                  F.sum(F.col("anchor").cast("long"))).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], OUT)
    dims = max(1, dims)
    index = _index(part, p, n, dims)
    parts = index.rdd.getNumPartitions()
    anchors = index.where("anchor").drop("anchor")
    # blocks by id hash: twice the number needed keeps each below the bound
    blocks = 1 if n_anchors <= p.anchor_block else -(-2 * n_anchors // p.anchor_block)
    out = None
    for i in range(blocks):
        mine_ = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        t = mine_.orderBy("id").toArrow()
        if not t.num_rows:
            continue
        b = _block(t, dims)
        top = _meet(index, parts, b, len(b.id), p.positives, dims,
                    meet_positives).toArrow()  # positives of one block
        pos = _windows(b, top, p)
        n_w = p.positives
        found = _meet(index, parts, b, len(b.id) * n_w, p.negatives, dims, meet_negatives)
        names = spark.createDataFrame(
            [(s, int(b.id[s // n_w]), int(pos[s // n_w, s % n_w, 0]), int(pos[s // n_w, s % n_w, 1]))
             for s in range(len(b.id) * n_w)],
            "slot long, anchor_id long, positive_id long, positive_score long")
        # one row per window of the block: bounded by anchor_block x positives
        got = found.join(F.broadcast(names), "slot").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        got = cut_lineage(got) if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    return out
