"""Exact k-nearest-neighbour classification (Euclidean, uniform or
distance weights) over a metric partition.

Fit: a tree of median cuts, or the cells and rings of pivots, from a bounded sample
(whichever leaves out more of the sample) cuts the training rows into blocks of about
``BLOCK_ROWS`` rows; a
block that a frequent vector makes larger is split by hash. Each block keeps its
number of rows, its bounding box and the least and greatest distance to every
pivot; these bounds (at most ``2 * MAX_BLOCKS`` blocks) go to every task.

Search, in two rounds: a query first meets its home block (a cogroup by block),
which gives a k-th distance. Queries of neighbouring home blocks then form at most
about ``GROUPS`` groups, and a group's task streams, nearest first, the blocks whose
lower bound for any of its queries does not exceed that distance, while the
distances shrink. So a query moves once and a training row at most once a group,
not once for every query that wants its block; the copies grow with the rows
until a group holds ``GROUP_ROWS`` queries. Bounds are safe against rounding, so the
result is that of comparing all pairs. A home block that many queries have is copied
to as many tasks as it needs, so no task gets more than about ``BLOCK_ROWS`` queries.

Inside a task a matrix product finds the candidates, with a margin for its
rounding, and their squared distances are then summed dimension by dimension in
order, so ties compare the same way as a SQL ``sum`` over the dimensions; equal
distances go by training id. A query row travels with its candidates, so nothing
is joined back and ids may repeat.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohort.operators.shared_pass import matrix
from cohort.session import cut_lineage

BLOCK_ROWS = 2048
MAX_BLOCKS = 8192
PIVOTS = 64
SAMPLE_ROWS = 4096
#: Sampled rows per block where these are more.
SAMPLE_PER_BLOCK = 16
CHUNK_ELEMS = 4_000_000
#: Groups of queries in the second round, until a group has ``GROUP_ROWS`` rows.
GROUPS, GROUP_ROWS = 48, 65_536
#: Bytes of features of a piece: training rows travel in pieces, not one by one.
PIECE_BYTES = 8192
#: Pairs compared at once while blocks stream (they stay in a core's cache).
TILE = 1 << 18
#: Candidates of a group beyond which those that are too far are dropped.
HELD = 2_000_000
#: Dimensions that a query is held against a block by before the others.
WIDE = 8
MAX_CLASSES = 1000
#: Share by which a bound or an approximate distance may be off.
SLACK = 1e-11


# ---------------------------------------------------------------- partition

def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Approximate squared distances of all pairs."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def find_pivots(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means centres from farthest-first starts."""
    start, d = [0], squared(x, x[:1])[:, 0]
    while len(start) < min(k, len(x)) and d.max() > 0:
        start.append(int(d.argmax()))
        d = np.minimum(d, squared(x, x[start[-1:]])[:, 0])
    c = x[start].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def median_tree(x: np.ndarray, leaves: int) -> np.ndarray:
    """Cuts at the median of the dimension of greatest variance, one row a node:
    dimension (-1: a leaf), cut, and the nodes below and from the cut on (of a leaf
    its number and itself). Leaves are numbered from one end to the other."""
    nodes, number, open_ = [], 0, [(np.arange(len(x)), leaves, None)]
    while open_:
        rows, m, above = open_.pop()
        at = len(nodes)
        if above is not None:
            nodes[above[0]][above[1]] = at
        own, found = x[rows], None
        for dim in np.argsort(-own.var(axis=0), kind="stable") if m > 1 and len(rows) > 1 else ():
            v = np.sort(own[:, dim])
            cut = v[len(v) // 2]
            if cut == v[0]:     # the median is the least value: cut above it
                cut = v[min(np.searchsorted(v, cut, side="right"), len(v) - 1)]
            if cut > v[0]:
                found = dim, cut, own[:, dim] < cut
                break
        if found is None:
            nodes.append([-1, 0.0, number, at])
            number += 1
            continue
        dim, cut, low = found
        part = min(max(1, round(m * low.mean())), m - 1)
        nodes.append([dim, cut, 0, 0])
        open_ += [(rows[~low], m - part, (at, 3)), (rows[low], part, (at, 2))]
    return np.array(nodes, float)


def leaf_of(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of each row's leaf."""
    dim, below, above = (tree[:, c].astype(np.int64) for c in (0, 2, 3))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[dim[at[rows]] >= 0]
        node = at[rows]
        at[rows] = np.where(x[rows, dim[node]] < tree[node, 1], below[node], above[node])
    return below[at]


NO_TREE = np.zeros((0, 4))


@dataclass
class Partition:
    """Pivots, for each the distances at which its cell is cut, and the number
    of the first block of each cell. With a tree its leaves are the blocks."""
    pivots: np.ndarray
    edges: list
    first: np.ndarray
    tree: np.ndarray = field(default_factory=lambda: NO_TREE)

    @classmethod
    def fit(cls, x: np.ndarray, n_blocks: int) -> "Partition":
        pivots = find_pivots(x, min(PIVOTS, n_blocks))
        d = np.sqrt(squared(x, pivots))
        own = d.argmin(axis=1)
        edges = []
        for j in range(len(pivots)):
            mine = np.sort(d[own == j, j])
            m = max(1, round(n_blocks * len(mine) / len(x)))
            edges.append(np.unique(mine[(np.arange(1, m) * len(mine)) // m]) if m > 1 else np.zeros(0))
        return cls(pivots, edges, np.cumsum([0, *(len(e) + 1 for e in edges)]))

    @classmethod
    def best(cls, x: np.ndarray, n_blocks: int) -> "Partition":
        """The pivots' cells or a tree, whichever has fewer rows of the sample in
        the blocks that some of its rows reach."""
        cells = cls.fit(x[:SAMPLE_ROWS], n_blocks)
        if n_blocks == 1:
            return cells
        # boxes bound the leaves, and one ring
        tree = cls(cells.pivots[:1], [], np.zeros(0, np.int64), median_tree(x, min(2 * n_blocks, MAX_BLOCKS)))
        return min((tree, cells), key=lambda p: p.reached(x))

    def reached(self, x: np.ndarray, queries: int = 128) -> int:
        """Rows in the blocks whose bound is within the distance of a query's
        fifth neighbour, over some rows of ``x`` as queries."""
        q, b = x[:queries], self.block(x)
        order = np.argsort(b, kind="stable")
        at = np.flatnonzero(np.diff(b[order], prepend=-1))
        d = np.sqrt(squared(x, self.pivots))
        bounds = Bounds(b[order][at], np.diff(at, append=len(b)),
                        *(f.reduceat(v[order], at) for v in (x, d) for f in (np.minimum, np.maximum)), self.pivots)
        k = min(5, len(x) - 1)      # after the row itself
        kth = np.concatenate([np.partition(squared(q[s:s + 16], x), k, axis=1)[:, k] for s in range(0, len(q), 16)])
        return int(((bounds.lower(q) <= kth[:, None]) * bounds.rows).sum())

    def block(self, x: np.ndarray) -> np.ndarray:
        if len(self.tree):
            return leaf_of(self.tree, x)
        d = np.sqrt(squared(x, self.pivots))
        own = d.argmin(axis=1)
        out = np.zeros(len(x), np.int64)
        for j in np.unique(own):
            rows = own == j
            out[rows] = self.first[j] + np.searchsorted(self.edges[j], d[rows, j], side="right")
        return out


@dataclass
class Bounds:
    """Per block: its number, rows, bounding box and distances to the pivots; the
    tree whose leaves are the blocks, if there is one."""
    block: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    far: np.ndarray
    pivots: np.ndarray
    tree: np.ndarray = field(default_factory=lambda: NO_TREE)

    def home(self, q: np.ndarray) -> np.ndarray:
        """A block of each query's neighbourhood: its leaf, or in the cell of its nearest
        pivot the one whose ring is closest (a start of the search, not a bound)."""
        if len(self.tree):
            at = np.searchsorted(self.block, leaf_of(self.tree, q))
            return self.block[np.minimum(at, len(self.block) - 1)]
        d = np.sqrt(squared(q, self.pivots))
        own, cell = d.argmin(axis=1), (self.near + self.far).argmin(axis=1)
        out = np.zeros(len(q), np.int64)
        for p in np.unique(own):
            rows = np.flatnonzero(own == p)
            of = np.flatnonzero(cell == p)
            of = of if len(of) else np.arange(len(self.block))
            v = d[rows, p, None]
            gap = np.maximum(self.near[None, of, p] - v, v - self.far[None, of, p])
            out[rows] = self.block[of[gap.argmin(axis=1)]]
        return out

    def within(self, q: np.ndarray, reach: float) -> "Bounds":
        """The blocks that may be as near as ``reach`` to any of the queries."""
        gap = np.maximum(np.maximum(self.low - q.max(axis=0), q.min(axis=0) - self.high), 0.0)
        d = np.sqrt(squared(q, self.pivots))
        ring = np.maximum(self.near - d.max(axis=0), d.min(axis=0) - self.far).max(axis=1)
        size = (q * q).sum(1).max() + (self.pivots * self.pivots).sum(1).max()
        ring = np.maximum(ring - 2 * np.sqrt(SLACK * size), 0.0)
        return self.some(np.maximum((gap * gap).sum(axis=1), ring * ring) * (1 - 1e-9) <= reach)

    def some(self, at: np.ndarray) -> "Bounds":
        return Bounds(*(getattr(self, n)[at] for n in ("block", "rows", "low", "high", "near", "far")),
                      self.pivots, self.tree)

    def lower(self, q: np.ndarray) -> np.ndarray:
        """Safe lower bounds of the squared distances, queries x blocks."""
        box = np.zeros((len(q), len(self.block)))
        for j in range(q.shape[1]):
            v = q[:, j, None]
            gap = np.maximum(self.low[None, :, j] - v, v - self.high[None, :, j])
            np.maximum(gap, 0.0, out=gap)
            box += gap * gap
        d = np.sqrt(squared(q, self.pivots))
        ring = np.zeros_like(box)
        for p in range(len(self.pivots)):
            v = d[:, p, None]
            np.maximum(ring, np.maximum(self.near[None, :, p] - v, v - self.far[None, :, p]), out=ring)
        # distances to pivots come from a matrix product: off by the root of its rounding
        size = (q * q).sum(1)[:, None] + (self.pivots * self.pivots).sum(1).max()
        ring = np.maximum(ring - 2 * np.sqrt(SLACK * size), 0.0)
        return np.maximum(box * (1 - 1e-9), ring * ring * (1 - 1e-9))

    def nearest(self, q: np.ndarray, kth: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Per block the least bound that is within a query's ``kth``, of the queries
        whose ``own`` block it is not; infinite if there is none."""
        out = np.full(len(self.block), np.inf)
        if not len(self.tree):
            low = self.lower(q)
            low[(low > kth[:, None]) | (self.block[None, :] == own[:, None])] = np.inf
            return low.min(axis=0, initial=np.inf)
        box = np.zeros((len(q), len(self.block)))
        for j in self.wide():       # a few dimensions leave out most pairs
            v = q[:, j, None]
            gap = np.maximum(self.low[None, :, j] - v, v - self.high[None, :, j])
            np.maximum(gap, 0.0, out=gap)
            box += gap * gap
        i, j = np.nonzero((box * (1 - 1e-9) <= kth[:, None]) & (self.block[None, :] != own[:, None]))
        step = max(1, CHUNK_ELEMS // max(1, q.shape[1]))
        for s in range(0, len(i), step):
            a, b = i[s:s + step], j[s:s + step]
            gap = np.maximum(np.maximum(self.low[b] - q[a], q[a] - self.high[b]), 0.0)
            low = (gap * gap).sum(axis=1) * (1 - 1e-9)
            ok = low <= kth[a]
            np.minimum.at(out, b[ok], low[ok])
        return out

    def wide(self) -> np.ndarray:
        """The dimensions in which the blocks' sides differ most."""
        return np.argsort(-(self.high - self.low).std(axis=0), kind="stable")[:WIDE]


# ---------------------------------------------------------------- in a task

def nearest(a: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray | None = None,
            same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, squared distance) of each query's k nearest rows of
    ``x`` by (distance, column), at most ``limit`` away; pairs in ``same`` are left
    out. Queries ascend, their neighbours by distance."""
    d = squared(a, x)
    if same is not None:
        d[same] = np.inf
    margin = SLACK * ((a * a).sum(1) + (x * x).sum(1).max(initial=0.0)) + 1e-300
    reach = np.full(len(a), np.inf)
    if len(x) > k:
        reach = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * margin
    if limit is not None:
        reach = np.minimum(reach, limit + margin)
    i, j = np.nonzero((d <= reach[:, None]) & (d < np.inf))
    exact = np.zeros(len(i))
    for c in range(a.shape[1]):  # in dimension order
        diff = a[i, c] - x[j, c]
        exact += diff * diff
    if limit is not None:
        ok = exact <= limit[i]
        i, j, exact = i[ok], j[ok], exact[ok]
    order = np.lexsort((j, exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], exact[keep]


def _meet(k: int, exclude_self: bool, schema: pa.Schema):
    """cogroup body: queries against one block; their other columns pass."""
    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows:
            return schema.empty_table()
        parts = []
        if t.num_rows:
            t = t.take(pc.sort_indices(t.column("tid")))  # columns in id order
            x, a = matrix(t.column("f")), matrix(q.column("f"))
            limit = None if "kth" not in q.column_names else q.column("kth").to_numpy()
            m = max(1, CHUNK_ELEMS // len(x))
            for s in range(0, len(a), m):
                same = None
                if exclude_self:
                    qid, tid = q.column("qid").slice(s, m).to_numpy(), t.column("tid").to_numpy()
                    same = qid[:, None] == tid[None, :]
                i, j, d = nearest(a[s:s + m], x, k, None if limit is None else limit[s:s + m], same)
                parts.append((i + s, j, d))
        i, j, d = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, int),) * 3
        offs = pa.array(np.searchsorted(i, np.arange(q.num_rows + 1)), pa.int32())
        lists = {"d": pa.array(np.asarray(d, float))}
        if t.num_rows:
            lists |= {"t": t.column("tid").take(pa.array(j)).combine_chunks(),
                      "l": t.column("y").take(pa.array(j)).combine_chunks()}
        else:
            lists |= {n: pa.array([], schema.field(n).type.value_type) for n in "tl"}
        return pa.Table.from_arrays(
            [pa.ListArray.from_arrays(offs, lists[n]) if n in lists else q.column(n) for n in schema.names],
            schema=schema)
    return run


class _Group:
    """The queries of a group while the blocks stream by: their k least distances
    so far (the last one is how far a neighbour may be) and the candidates."""

    def __init__(self, rows: pa.Table, k: int, exclude_self: bool, bounds: Bounds):
        self.k, self.exclude_self, self.rows = k, exclude_self, rows
        self.x, self.home = matrix(rows.column("f")), rows.column("b").to_numpy()
        self.size = (self.x * self.x).sum(axis=1)
        # distances to the pivots bound those to any block
        self.bounds, self.at = bounds, {b: i for i, b in enumerate(bounds.block.tolist())}
        self.ring = np.sqrt(squared(self.x, bounds.pivots))
        self.slack = 2 * np.sqrt(SLACK * (self.size + (bounds.pivots * bounds.pivots).sum(1).max()))
        # the queries of a home block lie together: their box and rings bound them all
        self.starts = np.flatnonzero(np.concatenate([[True], np.diff(self.home) != 0]))
        self.ends = np.append(self.starts[1:], len(self.home))
        self.box, self.rings = ([f.reduceat(v, self.starts) for f in (np.minimum, np.maximum)]
                                for v in (self.x, self.ring))
        self.slacks = np.maximum.reduceat(self.slack, self.starts)
        self.wide = bounds.wide()
        self.few = self.x[:, self.wide]
        lists = rows.column("d").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(len(n)), n)
        self.best = np.full((len(n), k), np.inf)
        self.best[at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
        self.found: list = []
        self.held = 0

    def asking(self, block: int) -> np.ndarray:
        """The queries that a block of another home may have neighbours for."""
        j, b = self.at[block], self.bounds
        reach = np.maximum.reduceat(self.best[:, -1], self.starts)
        gap = np.maximum(np.maximum(b.low[j] - self.box[1], self.box[0] - b.high[j]), 0.0)
        ring = np.maximum(b.near[j] - self.rings[1], self.rings[0] - b.far[j]).max(axis=1) - self.slacks
        low = np.maximum((gap * gap).sum(axis=1), np.maximum(ring, 0.0) ** 2) * (1 - 1e-9)
        runs = np.flatnonzero((low <= reach) & (self.home[self.starts] != block))
        if not len(runs):
            return runs
        q = np.concatenate([np.arange(self.starts[r], self.ends[r]) for r in runs])
        ring = np.maximum(b.near[j] - self.ring[q], self.ring[q] - b.far[j]).max(axis=1) - self.slack[q]
        q = q[np.maximum(ring, 0.0) ** 2 * (1 - 1e-9) <= self.best[q, -1]]
        for x, dims in ((self.few, self.wide), (self.x, slice(None))):  # a few dimensions leave out most
            gap = np.maximum(np.maximum(b.low[j, dims] - x[q], x[q] - b.high[j, dims]), 0.0)
            q = q[(gap * gap).sum(axis=1) * (1 - 1e-9) <= self.best[q, -1]]
        return q

    def meet(self, block: int, pieces: pa.Table) -> None:
        """Pieces of one block."""
        q = self.asking(block)
        if not len(q):
            return
        x = np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in pieces.column("x")]) \
            .reshape(-1, self.x.shape[1])
        t = pa.table({c: pieces.column(c).combine_chunks().flatten() for c in ("tid", "y")})
        xx = (x * x).sum(axis=1)
        top = max(xx.max(), self.size[q].max())
        # half the digits find the candidates, with the margin that they need
        kind, slack, least = (np.float32, 1e-6 * (x.shape[1] + 8), 1e-30) if 1e-20 < top < 1e20 else \
            (np.float64, SLACK, 1e-300)
        left = np.vstack([-2.0 * x.T, xx]).astype(kind)  # a query and 1, times this: d - |query|^2
        m = max(1, TILE // len(x))
        for s in range(0, len(q), m):
            own = q[s:s + m]
            a = self.x[own]
            d = np.column_stack([a, np.ones(len(a))]).astype(kind) @ left
            margin = slack * (self.size[own] + xx.max()) + least
            reach = self.best[own, -1] - self.size[own]
            wide = np.flatnonzero(np.isinf(reach))  # no k neighbours yet
            if len(wide) and len(x) > self.k and not self.exclude_self:
                reach[wide] = np.partition(d[wide], self.k - 1, axis=1)[:, self.k - 1] + margin[wide]
            # rounded to the kind of the products, which the margin covers
            i, j = np.divmod(np.flatnonzero(d <= (reach + margin).astype(kind)[:, None]), len(x))
            if self.exclude_self and len(i):
                same = pc.equal(self.rows.column("qid").take(pa.array(own[i])), t.column("tid").take(pa.array(j)))
                ok = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
                i, j = i[ok], j[ok]
            exact = np.zeros(len(i))
            for c in range(x.shape[1]):  # in dimension order
                diff = a[i, c] - x[j, c]
                exact += diff * diff
            i = own[i]
            ok = exact <= self.best[i, -1]
            self.take(i[ok], exact[ok], t, j[ok])

    def take(self, i: np.ndarray, d: np.ndarray, t: pa.Table, j: np.ndarray) -> None:
        if not len(i):
            return
        order = np.lexsort((d, i))
        i, d, j = i[order], d[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        u, at = np.unique(i[top], return_inverse=True)
        new = np.full((len(u), self.k), np.inf)
        new[at, rank[top]] = d[top]
        self.best[u] = np.sort(np.concatenate([self.best[u], new], axis=1), axis=1)[:, :self.k]
        near = d <= self.best[i, -1]
        i, d, at = i[near], d[near], pa.array(j[near])
        self.found.append(pa.table({"i": i, "d": d, "t": t.column("tid").take(at), "l": t.column("y").take(at)}))
        self.held += len(i)
        if self.held > HELD + 2 * self.best.size:
            self.found = [self.nearest()]
            self.held = self.found[0].num_rows

    def nearest(self) -> pa.Table:
        """The k nearest candidates of each query by (distance, id)."""
        t = pa.concat_tables(self.found)
        t = t.filter(pa.array(t.column("d").to_numpy() <= self.best[t.column("i").to_numpy(), -1]))
        t = t.sort_by([("i", "ascending"), ("d", "ascending"), ("t", "ascending")]).combine_chunks()
        i = t.column("i").to_numpy()
        return t.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < self.k))

    def result(self, schema: pa.Schema) -> pa.RecordBatch | None:
        if not self.found:
            return None
        t = self.nearest()
        u, first = np.unique(t.column("i").to_numpy(), return_index=True)
        offs = pa.array(np.append(first, t.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(offs, t.column(c).combine_chunks()) for c in "dtl"]
        key = self.rows.column("key").take(pa.array(u)).combine_chunks()
        return pa.RecordBatch.from_arrays([key, *lists], schema=schema)


def _stream(k: int, exclude_self: bool, bounds, schema: pa.Schema):
    """mapInArrow body over rows sorted by (group, queries before blocks, bound)."""
    def run(batches):
        at, asked, group = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            g, kind, block = (t.column(c).to_numpy() for c in ("g", "kind", "b"))
            # runs of one group and kind, and of one block of training rows
            part = np.where(kind == 0, -1, block)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(kind) != 0)
                                                    | (np.diff(part) != 0)])) if len(g) else []
            for s, e in zip(starts, [*starts[1:], len(g)]):
                if g[s] != at:
                    if group is not None and (out := group.result(schema)) is not None:
                        yield out
                    at, asked, group = g[s], [], None
                if kind[s] == 0:
                    asked.append(t.slice(s, e - s))
                    continue
                if group is None:
                    group = _Group(pa.concat_tables(asked).combine_chunks(), k, exclude_self, bounds.value)
                group.meet(int(block[s]), t.slice(s, e - s))
        if group is not None and (out := group.result(schema)) is not None:
            yield out
    return run


# ---------------------------------------------------------------- model

class Base:
    """The partitioned training rows (tid, f, y, b), written, with the bounds
    of the blocks and the classes."""

    def __init__(self, train: DataFrame, bounds: Bounds, classes: list):
        self.train, self.bounds, self.classes = train, bounds, classes
        self._pieces: DataFrame | None = None

    def pieces(self) -> DataFrame:
        """The training rows as (b, x, tid, y), some rows of a block together,
        written once."""
        if self._pieces is None:
            tid = self.train.schema["tid"].dataType
            fields = T.StructType([T.StructField("b", T.LongType()), T.StructField("x", T.BinaryType()),
                                   T.StructField("tid", T.ArrayType(tid)),
                                   T.StructField("y", T.ArrayType(T.DoubleType()))])
            self._pieces = cut_lineage(self.train.select("b", "f", "tid", "y").repartition("b")
                                       .sortWithinPartitions("b").mapInArrow(_cut(to_arrow_schema(fields)), fields))
        return self._pieces

    def meet(self, asked: DataFrame, k: int, exclude_self: bool, extra: Sequence[str]) -> DataFrame:
        """Cogroup queries (b, f, qid, [kth], extra...) with their blocks."""
        spark = asked.sparkSession
        counts = asked.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # one per block
        copies = spark.createDataFrame([(r["b"], -(-r["n"] // BLOCK_ROWS)) for r in counts],
                                       "b long, copies int")
        q = asked.join(F.broadcast(copies), "b").withColumn(
            "s", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int"))
        t = self.train.join(F.broadcast(copies), "b").select(
            "tid", "f", "y", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("s"))
        types = {f.name: f for f in asked.schema.fields}
        fields = T.StructType([
            *[types[c] for c in extra], T.StructField("d", T.ArrayType(T.DoubleType())),
            T.StructField("t", T.ArrayType(self.train.schema["tid"].dataType)),
            T.StructField("l", T.ArrayType(T.DoubleType()))])
        return q.groupBy("b", "s").cogroup(t.groupBy("b", "s")).applyInArrow(
            _meet(k, exclude_self, to_arrow_schema(fields)), fields)

    def grouped(self, first: DataFrame) -> tuple[DataFrame, int]:
        """The queries with the number of their group ``g``: neighbouring home
        blocks together, a frequent one split by hash."""
        counts = sorted((r["b"], r["n"]) for r in first.groupBy("b").agg(
            F.count(F.lit(1)).alias("n")).collect())  # one per block
        size = max(BLOCK_ROWS, min(GROUP_ROWS, -(-sum(n for _, n in counts) // GROUPS)))
        table, g, room = [], -1, 0
        for b, n in counts:
            m = -(-n // size)
            if m > 1 or n > room:
                g, room = g + 1, size
            table.append((b, g, m))
            g, room = g + m - 1, room - n if m == 1 else 0
        groups = first.sparkSession.createDataFrame(table, "b long, g0 long, m long")
        return first.join(F.broadcast(groups), "b").withColumn(
            "g", F.col("g0") + F.pmod(F.xxhash64("key"), F.col("m"))).drop("g0", "m"), g + 1

    def sweep(self, first: DataFrame, k: int, exclude_self: bool, bounds) -> DataFrame:
        """(key, d, t, l): the nearest rows outside a query's home block that are
        no farther than its k-th there. ``bounds`` is the broadcast ones."""
        asked, groups = self.grouped(first.select("key", "f", "qid", "b", "d"))
        needed = asked.select("g", "f", "b", "d").mapInArrow(
            _wanted(k, bounds), "g long, b long, near double") \
            .groupBy("g", "b").agg(F.min("near").alias("near"))
        none = F.lit(None).cast
        pieces = self.pieces()
        queries = asked.select("g", F.lit(0).alias("kind"), F.lit(0.0).alias("near"), "b", "key", "f", "qid", "d",
                               *[none(pieces.schema[c].dataType).alias(c) for c in ("x", "tid", "y")])
        rows = pieces.join(needed, "b").select(
            "g", F.lit(1).alias("kind"), "near", "b",
            *[none(asked.schema[c].dataType).alias(c) for c in ("key", "f", "qid", "d")], "x", "tid", "y")
        fields = T.StructType([
            T.StructField("key", T.LongType()), T.StructField("d", T.ArrayType(T.DoubleType())),
            T.StructField("t", T.ArrayType(self.train.schema["tid"].dataType)),
            T.StructField("l", T.ArrayType(T.DoubleType()))])
        return queries.unionByName(rows).repartition(2 * groups, "g") \
            .sortWithinPartitions("g", "kind", "near", "b") \
            .mapInArrow(_stream(k, exclude_self, bounds, to_arrow_schema(fields)), fields)


class KNNModel:
    """``cut`` gives a model with other neighbours or weights over the same
    training rows."""

    def __init__(self, base: Base, k: int, weights: str, key: str, id_col: str | None,
                 exclude_self: bool = False):
        self.base, self.k, self.weights, self.key = base, k, weights, key
        self.id_col, self.exclude_self = id_col, exclude_self

    @property
    def classes(self) -> list:
        return self.base.classes

    def cut(self, k: int, weights: str) -> "KNNModel":
        return KNNModel(self.base, k, weights, self.key, self.id_col, self.exclude_self)

    def _packed(self, df: DataFrame, keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
        """Query rows (the columns in ``keep``, or all) as one struct; Arrow takes no
        vectors, so these travel as arrays."""
        keep = df.columns if keep is None else keep
        vectors = [f.name for f in df.schema.fields if f.name in keep and isinstance(f.dataType, VectorUDT)]
        cols = [(vector_to_array(c) if c in vectors else F.col(c)).alias(c) for c in keep]
        qid = F.col(self.id_col) if self.exclude_self else F.lit(None)
        return df.select(F.struct(*cols).alias("row"), vector_to_array("features").alias("f"),
                         qid.cast(dict(self.base.train.dtypes)["tid"]).alias("qid"),
                         F.monotonically_increasing_id().alias("key")), vectors

    def neighbours(self, df: DataFrame, k: int | None = None,
                   keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
        """(row, d, t, l) per query row - the k nearest by (distance, id), the
        distance squared - and the row's vector columns."""
        k = k or self.k
        bounds = self.base.bounds
        packed, vectors = self._packed(df, keep)
        if not len(bounds.block):
            none = F.array().cast
            return packed.select("row", none("array<double>").alias("d"), F.array().cast(
                T.ArrayType(self.base.train.schema["tid"].dataType)).alias("t"),
                none("array<double>").alias("l")), vectors
        shared = df.sparkSession.sparkContext.broadcast(bounds)  # at most 2 * MAX_BLOCKS blocks
        home_fields = T.StructType([*packed.schema.fields, T.StructField("b", T.LongType())])
        home_schema = to_arrow_schema(home_fields)

        def home(batches):
            for b in batches:
                if b.num_rows:
                    at = _chunked(matrix(b.column("f")), len(shared.value.block), shared.value.home)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(at))],
                                                     schema=home_schema)
        # keys must be the same in every use of the rows
        asked = cut_lineage(packed.mapInArrow(home, home_fields))
        first = self.base.meet(asked, k, self.exclude_self, ["key", "row", "f", "qid", "b"])
        if len(bounds.block) == 1:
            return first.select("row", "d", "t", "l"), vectors
        first = cut_lineage(first)
        second = self.base.sweep(first, k, self.exclude_self, shared)
        # a query has one row in each round
        zipped = F.arrays_zip("d", "t", "l")
        merged = first.select("key", "row", zipped.alias("own")).join(
            second.select("key", zipped.alias("more")), "key", "left").select("row", F.slice(F.array_sort(
                F.when(F.col("more").isNull(), F.col("own")).otherwise(F.concat("own", "more"))), 1, k).alias("s"))
        return merged.select("row", F.col("s.d").alias("d"), F.col("s.t").alias("t"),
                             F.col("s.l").alias("l")), vectors

    def _vote(self) -> tuple[Column, Column]:
        """(class, probabilities) from columns d and l of at least k neighbours."""
        d, lab = F.slice("d", 1, self.k), F.slice("l", 1, self.k)
        w = (F.transform(d, lambda v: F.lit(1.0)) if self.weights == "uniform" else
             # distance weights; an exact match (d = 0) takes all the weight
             F.when(F.exists(d, lambda v: v == 0), F.transform(d, lambda v: F.when(v == 0, 1.0).otherwise(0.0)))
             .otherwise(F.transform(d, lambda v: 1.0 / F.sqrt(v))))
        pairs = F.arrays_zip(lab.alias("l"), w.alias("w"))

        def vote_for(c):
            return lambda acc, e: acc + F.when(e["l"] == F.lit(c), e["w"]).otherwise(0.0)
        sc = F.array(*[F.aggregate(pairs, F.lit(0.0), vote_for(c)) for c in self.classes])
        tot = F.aggregate(sc, F.lit(0.0), lambda a, b: a + b)
        # argmax; the first (smallest) class wins a tie
        best = F.array_position(sc, F.array_max(sc)).cast("int")
        cls = F.array(*[F.lit(float(c)) for c in self.classes])
        return F.element_at(cls, best), F.transform(sc, lambda s: s / tot)

    def views(self, df: DataFrame, models: Sequence["KNNModel"],
              keep: Sequence[str] | None = None) -> tuple[DataFrame, list]:
        """The rows (their columns in ``keep``, or all) with their neighbours, found
        once, and per model (of the same base) its prediction and probability of class
        1 as columns."""
        keep = df.columns if keep is None else keep
        nb, vectors = self.neighbours(df, max(m.k for m in models), keep)
        out = nb.select(*_unpacked(keep, vectors), "d", "l")
        at = self.classes.index(1.0) if 1.0 in self.classes else None
        got = []
        for m in models:
            pred, probs = m._vote()
            got.append((pred, F.lit(0.0) if at is None else probs[at]))
        return out, got

    def transform(self, df: DataFrame) -> DataFrame:
        nb, vectors = self.neighbours(df)
        pred, probs = self._vote()
        return nb.select(*_unpacked(df.columns, vectors), pred.alias(f"pred_{self.key}"),
                         array_to_vector(probs).alias(f"prob_{self.key}"))

    def save(self, path: str) -> None:
        spark = self.base.train.sparkSession
        self.base.train.write.mode("overwrite").parquet(os.path.join(path, "train"))
        meta = json.dumps({"k": self.k, "weights": self.weights, "key": self.key, "id_col": self.id_col,
                           "exclude_self": self.exclude_self, "classes": self.classes})
        blob = io.BytesIO()
        np.savez_compressed(blob, **vars(self.base.bounds))
        spark.createDataFrame([(meta, bytearray(blob.getvalue()))], "meta string, bounds binary").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "knn"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KNNModel":
        r = spark.read.parquet(os.path.join(path, "knn")).first()
        m, z = json.loads(r["meta"]), np.load(io.BytesIO(bytes(r["bounds"])))
        base = Base(spark.read.parquet(os.path.join(path, "train")), Bounds(**{n: z[n] for n in z.files}),
                    m.pop("classes"))
        return cls(base, **m)


def _cut(schema: pa.Schema):
    """mapInArrow body: rows (b, f, tid, y) sorted by block as pieces."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, block = matrix(b.column("f")), b.column("b").to_numpy()
            most = max(1, PIECE_BYTES // max(8, 8 * x.shape[1]))
            ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            starts = np.concatenate([np.arange(a, e, most) for a, e in zip(ends, ends[1:])])
            offs = pa.array(np.append(starts, len(block)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts]),
                 pa.array([x[a:e].tobytes() for a, e in zip(starts, [*starts[1:], len(block)])], pa.binary()),
                 *(pa.ListArray.from_arrays(offs, b.column(c)) for c in ("tid", "y"))], schema=schema)
    return run


def _wanted(k: int, bounds):
    """mapInArrow body over (g, f, b, d): the blocks that a group's queries ask
    for beside their own, with the least bound."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, g, own = matrix(b.column("f")), b.column("g").to_numpy(), b.column("b").to_numpy()
            kth, d = np.full(len(x), np.inf), b.column("d")
            offs = d.offsets.to_numpy()
            full = np.flatnonzero(np.diff(offs) >= k)
            if len(full):
                kth[full] = d.values.to_numpy(zero_copy_only=False)[offs[full] + k - 1]
            order = np.lexsort((own, g))
            cut = np.flatnonzero(np.diff(own[order]) != 0) + 1
            for rows in np.split(order, cut):
                some = bounds.value.within(x[rows], kth[rows].max())
                near = np.full(len(some.block), np.inf)
                step = max(1, CHUNK_ELEMS // max(1, len(near)))
                for s in range(0, len(rows), step):
                    r = rows[s:s + step]
                    near = np.minimum(near, some.nearest(x[r], kth[r], own[r]))
                hit = np.flatnonzero(near < np.inf)
                for one in np.unique(g[rows]):  # a frequent home block has several groups
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), one)), pa.array(some.block[hit]), pa.array(near[hit])],
                        ["g", "b", "near"])
    return run


def _unpacked(columns: Sequence[str], vectors: Sequence[str]) -> list[Column]:
    return [(array_to_vector(F.col(f"row.`{c}`")) if c in vectors else F.col(f"row.`{c}`")).alias(c)
            for c in columns]


def _chunked(q: np.ndarray, width: int, fn) -> list:
    m = max(1, CHUNK_ELEMS // max(1, width))
    return [fn(q[s:s + m]) for s in range(0, len(q), m)]


class KNNClassifier:
    def __init__(self, k=5, weights="uniform", key="knn", label="label", id_col="id",
                 exclude_self=False):
        self.k, self.weights, self.key, self.label = k, weights, key, label
        self.id_col, self.exclude_self = id_col, exclude_self

    def fit(self, df: DataFrame) -> KNNModel:
        """The training rows are written once; a frame without the id column
        is numbered by its rows' hash."""
        has_id = self.id_col in df.columns
        f = vector_to_array("features")
        src = cut_lineage(df.select(
            (F.col(self.id_col) if has_id else F.xxhash64(f)).alias("tid"), f.alias("f"),
            F.col(self.label).cast("double").alias("y")).where("y IS NOT NULL"))
        per_class = src.groupBy("y").agg(F.count(F.lit(1)).alias("n")) \
            .limit(MAX_CLASSES + 1).collect()
        if len(per_class) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes: not a classification label")
        rows = sum(r["n"] for r in per_class)
        classes = sorted(r["y"] for r in per_class)
        train, bounds = _partitioned(src, rows)
        return KNNModel(Base(train, bounds, classes), self.k, self.weights, self.key, self.id_col,
                        self.exclude_self)


def _renumbered(tree: np.ndarray, splits: Sequence[tuple]) -> np.ndarray:
    """The tree with the new numbers of its leaves: (old, first new, parts) in
    order; a leaf without rows takes the one after it."""
    out = tree.copy()
    leaf = np.flatnonzero(tree[:, 0] < 0) if len(tree) else np.zeros(0, int)
    at = np.searchsorted([s[0] for s in splits], tree[leaf, 2])
    out[leaf, 2] = np.array([s[1] for s in splits])[np.minimum(at, len(splits) - 1)]
    return out


def _partitioned(src: DataFrame, rows: int) -> tuple[DataFrame, Bounds]:
    """The rows with their block, written, and the blocks' bounds."""
    if not rows:
        none = np.zeros((0, 0))
        return src.withColumn("b", F.lit(0).cast("long")), Bounds(
            np.zeros(0, np.int64), np.zeros(0, np.int64), none, none, none, none, none)
    want = min(MAX_BLOCKS, max(1, -(-rows // BLOCK_ROWS)))
    # the rows of the least hashes; those far above are left out before the sort
    size, h = max(SAMPLE_ROWS, SAMPLE_PER_BLOCK * want), F.xxhash64("tid", "f")
    few = src if rows <= 4 * size else src.where(h < F.lit(int(-2.0**63 + 2.0**64 * 1.5 * size / rows)))
    sample = few.orderBy(h).limit(size).select("f").toArrow()
    shape = Partition.best(matrix(sample.column("f")), want)
    fields = T.StructType([*src.schema.fields, T.StructField("b", T.LongType())])
    schema = to_arrow_schema(fields)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(shape.block(matrix(b.column("f"))))], schema=schema)
    placed = cut_lineage(src.mapInArrow(place, fields))
    # a block far above its size (a frequent vector) is split by hash
    most = 2 * -(-rows // want)
    counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most want + pivots
    number, splits = 0, []
    for r in sorted(counts):
        m = 1 if r["n"] <= most else -(-2 * r["n"] // most)
        splits.append((r["b"], number, m))
        number += m
    if number > len(counts) or [s[1] for s in splits] != [s[0] for s in splits]:
        table = src.sparkSession.createDataFrame(splits, "b long, number long, m long")
        placed = cut_lineage(placed.join(F.broadcast(table), "b").select(
            "tid", "f", "y", (F.col("number") + F.pmod(F.xxhash64("tid", "f"), F.col("m"))).alias("b")))
        shape.tree = _renumbered(shape.tree, splits)
    pivots = shape.pivots

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, b = matrix(batch.column("f")), batch.column("b").to_numpy()
            d = np.sqrt(squared(x, pivots))
            order = np.argsort(b, kind="stable")
            at = np.flatnonzero(np.diff(b[order], prepend=-1))
            stats = [np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at),
                     np.minimum.reduceat(d[order], at), np.maximum.reduceat(d[order], at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[order][at]), pa.array(np.diff(at, append=len(b))),
                 pa.array([np.concatenate(r).tobytes() for r in zip(*stats)], pa.binary())],
                ["b", "n", "blob"])

    dims, n_pivots = pivots.shape[1], len(pivots)

    def merge(t: pa.Table) -> pa.Table:
        v = np.array([np.frombuffer(x, np.float64) for x in t.column("blob").to_pylist()])
        lo, hi, near, far = np.split(v, [dims, 2 * dims, 2 * dims + n_pivots], axis=1)
        row = np.concatenate([lo.min(0), hi.max(0), near.min(0), far.max(0)])
        return pa.table({"b": t.column("b").slice(0, 1), "n": [pc.sum(t.column("n")).as_py()],
                         "blob": pa.array([row.tobytes()], pa.binary())})
    got = placed.mapInArrow(measure, "b long, n long, blob binary").groupBy("b") \
        .applyInArrow(merge, "b long, n long, blob binary").orderBy("b").toArrow()
    v = np.array([np.frombuffer(x, np.float64) for x in got.column("blob").to_pylist()])
    lo, hi, near, far = np.split(v, [dims, 2 * dims, 2 * dims + n_pivots], axis=1)
    return placed, Bounds(got.column("b").to_numpy(), got.column("n").to_numpy(), lo, hi, near, far, pivots,
                          shape.tree)
