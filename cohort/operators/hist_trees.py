"""Trees, forests and boosted trees over a quantile-binned matrix,
many fits a pass.

Features are cut once into at most ``max_bins`` bins (each value its own bin if
a feature has few), so a row is one byte per feature. A pass grows one level of
all trees of all fits: tasks route their rows and sum, per open node, feature
and bin, the statistics of the label; the sums meet by a few nodes at a time,
where the best split of each node is found; only splits go to the driver.

* tree and forest: Gini impurity; statistics are weight and positive weight. A
  forest draws its bootstrap (Poisson(1) weights) and the features of a node (the
  square root of their number) by hashes of tree, row and node, so a tree is the
  same on any partitioning, and a tree of depth 3 is the top of the one of depth 15.
* boosted: second-order gain on gradient and hessian of the log loss with
  shrinkage, L2 1 and child weight 1; the first k rounds are those of any longer
  fit. Margins are written every ``STATE_ROUNDS`` rounds.

A matrix of at most ``LOCAL_BYTES`` goes to the tasks whole, and each grows its own
fits or trees by the same sums in the same order (so the same trees): hundreds of
passes over few rows cost more to start than to run.

So fits that differ only in depth (tree, forest) or rounds (boosted) are one
fit, cut off at scoring (``depth``, ``rounds``). Ties between splits go to the
lower feature, then the lower bin; a row goes left if its value is at most the
threshold.
"""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.operators import shared_pass as SP

MAX_BINS = 64
#: Rounds of boosting between two writes of the margins.
STATE_ROUNDS = 25
#: Values kept of a feature with many.
SUMMARY = 4096
#: Nodes of the trees that one pass sends to the tasks.
PASS_NODES = 1 << 20
#: Splits up to which a tree is routed node by node over whole columns.
FEW_SPLITS = 48
#: Histogram entries (nodes x features x bins) of a unit.
UNIT_CELLS = 1 << 18
#: Bytes of a binned matrix up to which a task holds it whole.
LOCAL_BYTES = 16 << 20
#: Nodes of the trees that such tasks return at once, at most.
LOCAL_NODES = 1 << 22
LAMBDA, CHILD_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-6
POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117,
                     0.061313240195240384, 0.015328310048810096, 0.0030656620097620196,
                     0.0005109436682936699, 7.299195261338141e-05, 9.123994076672677e-06])


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def seed_of(seed: int, tree: int) -> np.uint64:
    return mix(mix(np.uint64(seed)) ^ np.uint64(tree))


def uniform(key: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A number in [0, 1) for each row."""
    return (mix(key ^ seed) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def bootstrap(key: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Poisson(1) weight of each row."""
    return np.searchsorted(POISSON, uniform(key, seed), side="right").astype(np.int64)


def node_features(path: np.ndarray, seed: np.uint64, n_features: int, take: int) -> np.ndarray:
    """nodes x take: the features a node looks at, ascending."""
    if take >= n_features:
        return np.tile(np.arange(n_features), (len(path), 1))
    h = mix(mix(path ^ seed)[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :take], axis=1)


# ---------------------------------------------------------------- binning

class _Values(SP.Units):
    """A feature's values with their counts; beyond ``SUMMARY`` values a
    summary of evenly spaced ranks. Ends in the values that end a bin."""

    def __init__(self, max_bins: int):
        self.max_bins = max_bins

    def add(self, unit: int, total, blob: bytes):
        part = np.frombuffer(blob, np.float64)
        exact, n = bool(part[0]), int(part[1])
        v, c = part[2:2 + n], part[2 + n:]
        if total is None:
            return exact, v, c
        u, at = np.unique(np.concatenate([total[1], v]), return_inverse=True)
        return total[0] and exact, *summary(u, np.bincount(at, np.concatenate([total[2], c])), 4 * SUMMARY)

    def dump(self, unit: int, total) -> bytes:
        return np.concatenate([[total[0], len(total[1])], total[1], total[2]]).tobytes()

    def end(self, unit: int, total) -> bytes:
        exact, v, c = total
        if exact and len(v) <= self.max_bins:
            return ((v[:-1] + v[1:]) / 2).tobytes()
        cum = np.cumsum(c)
        at = np.searchsorted(cum, cum[-1] * np.arange(1, self.max_bins) / self.max_bins)
        return np.unique(v[at[v[at] < v[-1]]]).tobytes()


def summary(v: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts, cut to ``SUMMARY`` of them if they are more than ``most``."""
    if len(v) <= most:
        return v, c
    cum = np.cumsum(c)
    at = np.unique(np.searchsorted(cum, cum[-1] * (np.arange(SUMMARY) + 1) / SUMMARY).clip(0, len(v) - 1))
    return v[at], np.diff(cum[at], prepend=0)


def fit_cuts(packed: SP.Packed, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature the values that end a bin (the last bin has no end): the
    middles between its values if there are at most ``max_bins``, otherwise
    quantiles. One pass."""
    def work(block: SP.Block) -> Iterator[tuple[int, bytes]]:
        for j in range(block.x.shape[1]):
            v, c = np.unique(block.x[:, j], return_counts=True)
            s = summary(v, c, SUMMARY)
            yield j, np.concatenate([[len(v) == len(s[0]), len(s[0])], *s]).tobytes()
    got = SP.run_pass(packed, work, _Values(max_bins), packed.dims, packed.dims * 16 * (SUMMARY + 1))
    return [np.frombuffer(got[j], np.float64) for j in range(packed.dims)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def bin_matrix(packed: SP.Packed, max_bins: int = MAX_BINS) -> tuple[list[np.ndarray], SP.Packed]:
    """Cuts and byte matrix of a packed matrix, made once and kept with it."""
    if max_bins not in packed.made:
        cuts = fit_cuts(packed, max_bins)
        packed.made[max_bins] = cuts, SP.recode(packed, lambda x: binned(x, cuts), np.uint8)
    return packed.made[max_bins]


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes as arrays; ``left`` is -1 for a leaf, the right child is left + 1.
    ``a``, ``b``: weight and positive weight, or gradient and hessian."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    a: np.ndarray
    b: np.ndarray
    level: np.ndarray
    path: np.ndarray
    threshold: np.ndarray | None = None
    value: np.ndarray | None = None

    @classmethod
    def root(cls) -> "Tree":
        return cls(np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, -1, np.int32), np.zeros(1),
                   np.zeros(1), np.zeros(1), np.zeros(1, np.int16), np.ones(1, np.uint64))

    def route(self, flat: np.ndarray, base: np.ndarray, steps: int) -> np.ndarray:
        """Node of each row; ``flat`` holds bins, ``base`` is where a row begins."""
        node = np.zeros(len(base), np.int32)
        for _ in range(steps):
            left = self.left[node]
            go = left >= 0
            if not go.any():
                break
            right = flat[base + self.feature[node]] > self.bin[node]
            node = np.where(go, left + right, node)
        return node

    def route_columns(self, columns: np.ndarray) -> np.ndarray:
        """Node of each row, by the bins as one array per feature; a tree of
        few splits is walked split by split."""
        inner = np.flatnonzero(self.left >= 0)      # parents come before their children
        if len(inner) > FEW_SPLITS:
            n = columns.shape[1]
            flat, base, node = columns.ravel(), np.arange(n), np.zeros(n, np.int32)
            while (go := self.left[node] >= 0).any():
                right = flat[base + self.feature[node].astype(np.int64) * n] > self.bin[node]
                node = np.where(go, self.left[node] + right, node)
            return node
        node = np.zeros(columns.shape[1], np.uint8)
        for i in inner.tolist():
            here = node == i
            kid = (columns[self.feature[i]] > self.bin[i]).view(np.uint8) + np.uint8(self.left[i])
            np.copyto(node, kid, where=here)
        return node

    def leaf(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Node of each row of a matrix of values, at most ``depth`` deep."""
        return next(self.leaves(x, [int(self.level.max()) if depth is None else depth]))

    def leaves(self, x: np.ndarray, depths: Sequence[int]) -> Iterator[np.ndarray]:
        """Node of each row at each of the rising depths, in one descent."""
        node, at, level, go = np.zeros(len(x), np.int32), np.arange(len(x)), 0, None
        for depth in depths:
            while level < depth and (go is None or go.any()):
                left = self.left[node]
                go = left >= 0
                if go.any():
                    node = np.where(go, left + (x[at, self.feature[node]] > self.threshold[node]), node)
                level += 1
            yield node

    def split(self, nodes: np.ndarray, f, b, gain, la, lb) -> np.ndarray:
        """Split nodes; returns the children."""
        k, n = len(nodes), len(self.left)
        kids = n + np.arange(2 * k)
        self.feature[nodes], self.bin[nodes], self.gain[nodes] = f, b, gain
        self.left[nodes] = kids[::2]
        pair = lambda l, t: np.column_stack([l, t - l]).ravel()
        path = np.column_stack([self.path[nodes] * np.uint64(2), self.path[nodes] * np.uint64(2)
                                + np.uint64(1)]).ravel()
        self.path = np.concatenate([self.path, path])
        self.a = np.concatenate([self.a, pair(la, self.a[nodes])])
        self.b = np.concatenate([self.b, pair(lb, self.b[nodes])])
        self.level = np.concatenate([self.level, np.repeat(self.level[nodes] + 1, 2)])
        zero = np.zeros(2 * k, np.int32)
        self.feature, self.bin = np.concatenate([self.feature, zero]), np.concatenate([self.bin, zero])
        self.left = np.concatenate([self.left, zero - 1])
        self.gain = np.concatenate([self.gain, np.zeros(2 * k)])
        return kids

    def settle(self, cuts: np.ndarray, kind: str, rate: float) -> None:
        """Thresholds of the splits (from features x bins) and the nodes' values."""
        self.threshold = np.where(self.left >= 0, cuts[self.feature, self.bin], 0.0)
        self.value = rate * -self.a / (self.b + LAMBDA) if kind == "gb" else \
            self.b / np.maximum(self.a, 1e-300)


def best_splits(h: np.ndarray, kind: str, params: dict) -> dict[str, np.ndarray]:
    """Per node of a histogram (2 x nodes x features x bins) the best split:
    slot (-1: none), bin, gain, statistics of the left child and of the node."""
    a, b = h
    n_bins = a.shape[-1]
    ta, tb = a[:, 0].sum(axis=-1), b[:, 0].sum(axis=-1)
    la, lb = np.cumsum(a, axis=-1)[..., :-1], np.cumsum(b, axis=-1)[..., :-1]
    ra, rb = ta[:, None, None] - la, tb[:, None, None] - lb
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "gb":
            gain = 0.5 * (la ** 2 / (lb + LAMBDA) + ra ** 2 / (rb + LAMBDA)
                          - (ta ** 2 / (tb + LAMBDA))[:, None, None])
            ok = (lb >= CHILD_WEIGHT) & (rb >= CHILD_WEIGHT) & (gain > LEAST_GAIN)
        else:
            least = params["min_samples_leaf"]
            impure = lambda w, p: 2 * p * (w - p) / w
            gain = impure(ta, tb)[:, None, None] - impure(la, lb) - impure(ra, rb)
            ok = (la >= least) & (ra >= least) & (la > 0) & (ra > 0)
            ok &= ((ta >= params["min_samples_split"]) & (tb > 0) & (tb < ta))[:, None, None]
    gain = np.where(ok, gain, -np.inf).reshape(len(ta), -1)
    at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(ta), int)
    row = np.arange(len(ta))
    found = gain[row, at] > -np.inf if gain.shape[1] else np.zeros(len(ta), bool)
    pick = lambda v: v.reshape(len(ta), -1)[row, at]
    return {"slot": np.where(found, at // (n_bins - 1), -1), "bin": at % (n_bins - 1),
            "gain": np.where(found, gain[row, at], 0.0), "la": pick(la), "lb": pick(lb), "ta": ta, "tb": tb}


_SPLIT = np.dtype([("slot", "f8"), ("bin", "f8"), ("gain", "f8"), ("la", "f8"), ("lb", "f8"),
                   ("ta", "f8"), ("tb", "f8")])


def none_found(n: int) -> np.ndarray:
    out = np.zeros(n, _SPLIT)
    out["slot"] = -1
    return out


# ---------------------------------------------------------------- a pass

@dataclass
class Growing:
    """A tree that is being grown: its fit, seed and the nodes to split."""
    fit: int
    tree: Tree
    frontier: np.ndarray
    level: int = 0
    seed: np.uint64 | None = None

    def slim(self) -> "Growing":
        """What a task needs: the splits, and the paths of the open nodes."""
        t = self.tree
        none = np.zeros(0)
        paths = np.zeros(len(t.left), np.uint64)
        paths[self.frontier] = t.path[self.frontier]
        return replace(self, tree=Tree(t.feature, t.bin, t.left, none, none, none, none, paths))


@dataclass
class Unit:
    """Some open nodes of a tree."""
    grow: int
    begin: int
    end: int


class _Splits(SP.Units):
    """Adds histograms; ends in the best split of each node."""

    def __init__(self, shapes: list[tuple[int, int, int]], kind: str, params: list[dict]):
        self.shapes, self.kind, self.params = shapes, kind, params

    def add(self, unit: int, total, blob: bytes):
        cells = int(np.prod(self.shapes[unit]))
        if total is None:
            total = np.zeros(2 * cells)
        if blob[0] == 2:
            at, a, b = row_entries(blob, self.shapes[unit])
            np.add.at(total, at, a)
            np.add.at(total, at + cells, b)
        elif blob[0]:
            at, values = sparse(blob)
            total[at] += values
        else:
            total += np.frombuffer(blob, np.float64, offset=8)
        return total

    def dump(self, unit: int, total) -> bytes:
        return dense(total)

    def end(self, unit: int, total) -> bytes:
        got = best_splits(total.reshape(2, *self.shapes[unit]), self.kind, self.params[unit])
        out = np.zeros(len(got["ta"]), _SPLIT)
        for name in _SPLIT.names:
            out[name] = got[name]
        return out.tobytes()


def dense(h: np.ndarray) -> bytes:
    return bytes(8) + np.ascontiguousarray(h, np.float64).tobytes()


def coded(h: np.ndarray) -> bytes:
    """The entries that are not zero if they are few, else all."""
    at = np.flatnonzero(h)
    if 12 * len(at) >= 8 * len(h):
        return dense(h)
    head = b"\1" + bytes(3) + np.int32(len(at)).tobytes()
    return head + h[at].tobytes() + at.astype(np.int32).tobytes()


def sparse(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int32, 1, 4)[0])
    return np.frombuffer(blob, np.int32, n, 8 + 8 * n), np.frombuffer(blob, np.float64, n, 8)


#: Whole weights and positive weights of a block's rows meet in one number.
PAIR = float(1 << 26)


def histograms(bins: Iterator[np.ndarray], n_feats: int, stats: tuple[np.ndarray, np.ndarray], slot: np.ndarray,
               n_bins: int, nodes: int, whole: bool) -> np.ndarray:
    """Sums of both statistics over (node, feature, bin); ``slot`` is the open
    node of each row, ``bins`` its bins feature by feature. ``whole``: the
    statistics are whole numbers, at most a few a row, and are summed as one."""
    out = np.empty((2, nodes, n_feats, n_bins))
    start = slot * n_bins
    pair = stats[0] + PAIR * stats[1] if whole else None
    for j, own in enumerate(bins):
        at = start + own
        if whole:
            both = np.bincount(at, pair, nodes * n_bins)
            b = np.floor(both / PAIR)
            out[1, :, j], out[0, :, j] = b.reshape(nodes, -1), (both - PAIR * b).reshape(nodes, -1)
        else:
            for s in (0, 1):
                out[s, :, j] = np.bincount(at, stats[s], nodes * n_bins).reshape(nodes, -1)
    return out.ravel()


def coded_rows(bins: Iterator[np.ndarray], a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> bytes:
    """Rows as they are: where nodes hold few rows, these are less than the
    entries of their histograms. The weights are small whole numbers."""
    weight = (2 * a + (b > 0)).astype(np.uint8)
    return b"\2" + bytes(3) + np.int32(len(slot)).tobytes() + slot.astype(np.int32).tobytes() \
        + weight.tobytes() + np.column_stack([x.astype(np.uint8) for x in bins]).tobytes()


def row_entries(blob: bytes, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, weight, positive weight) of coded rows, one per row and feature."""
    _, n_feats, n_bins = shape
    n = int(np.frombuffer(blob, np.int32, 1, 4)[0])
    slot, weight = np.frombuffer(blob, np.int32, n, 8), np.frombuffer(blob, np.uint8, n, 8 + 4 * n)
    bins = np.frombuffer(blob, np.uint8, n * n_feats, 8 + 5 * n).reshape(n, n_feats)
    at = (slot[:, None].astype(np.int64) * n_feats + np.arange(n_feats)) * n_bins + bins
    a = (weight >> 1).astype(float)
    return at.ravel(), np.repeat(a, n_feats), np.repeat(a * (weight & 1), n_feats)


def open_features(g: Growing, take: int, dims: int) -> np.ndarray | None:
    """Features that each open node of a tree looks at; None: all."""
    return None if take == dims else node_features(g.tree.path[g.frontier], g.seed, dims, take)


@dataclass
class Shape:
    """What trees of a kind are grown by beside the rows."""
    kind: str
    fits: list[SP.Fit]
    n_bins: int
    dims: int
    take: int
    ends: np.ndarray

    @property
    def width(self) -> int:
        """Open nodes of a unit."""
        return max(1, UNIT_CELLS // (self.take * self.n_bins))

    def split(self, g: Growing, found: np.ndarray) -> None:
        t = g.tree
        if not g.level:
            t.a[0], t.b[0] = found["ta"][0], found["tb"][0]
        feats = open_features(g, self.take, self.dims)
        ok = found["slot"] >= 0
        slot = found["slot"][ok].astype(int)
        f = slot if feats is None else feats[np.flatnonzero(ok), slot]
        kids = t.split(g.frontier[ok], f, found["bin"][ok].astype(int), found["gain"][ok],
                       found["la"][ok], found["lb"][ok])
        if self.kind != "gb":  # a pure or small node stays a leaf
            p = self.fits[g.fit].params
            kids = kids[(t.b[kids] > 0) & (t.b[kids] < t.a[kids])
                        & (t.a[kids] >= max(p["min_samples_split"], 2 * p["min_samples_leaf"]))]
        g.frontier, g.level = kids, g.level + 1


@dataclass
class Part:
    """Rows of a block that a tree learns from: their bins by feature, their
    statistics, and their open node."""
    columns: np.ndarray
    a: np.ndarray
    b: np.ndarray
    slot: np.ndarray


def grow_here(g: Growing, parts: list[Part], shape: Shape) -> None:
    """``Learner.level`` until the tree is grown, over rows at hand. Rows of closed
    nodes are left out of ``parts``, but not where ``slot`` has to stay (boosted)."""
    params, n_bins, take, whole = shape.fits[g.fit].params, shape.n_bins, shape.take, shape.kind != "gb"
    while len(g.frontier) and g.level < params["max_depth"]:
        feats, found, n = open_features(g, take, shape.dims), [], len(g.frontier)
        by = [np.argsort(p.slot, kind="stable") if n > shape.width else None for p in parts]
        for begin in range(0, n, shape.width):
            end = min(begin + shape.width, n)
            total = np.zeros(2 * (end - begin) * take * n_bins)
            some = False
            for p, order in zip(parts, by):
                at = np.flatnonzero(p.slot >= 0) if order is None else \
                    order[slice(*np.searchsorted(p.slot[order], [begin, end]))]
                if not len(at):
                    continue
                every = len(at) == len(p.slot)
                slot = (p.slot if every else p.slot[at]) - begin
                if feats is None:
                    bins = (c if every else c[at] for c in p.columns)
                else:
                    mine = feats[begin:end]
                    bins = (p.columns[mine[slot, j], at] for j in range(take))
                stats = (p.a, p.b) if every else (p.a[at], p.b[at])
                total += histograms(bins, take, stats, slot, n_bins, end - begin, whole)
                some = True
            if not some:
                found.append(none_found(end - begin))
                continue
            got = best_splits(total.reshape(2, end - begin, take, n_bins), shape.kind, params)
            out = np.zeros(end - begin, _SPLIT)
            for name in _SPLIT.names:
                out[name] = got[name]
            found.append(out)
        was = g.frontier
        shape.split(g, np.concatenate(found))
        t, again = g.tree, np.full(len(g.tree.left), -1, np.int64)
        again[g.frontier] = np.arange(len(g.frontier))
        for i, p in enumerate(parts):
            at = np.flatnonzero(p.slot >= 0)
            node = was[p.slot[at]]
            left = t.left[node]
            right = p.columns[t.feature[node], at] > t.bin[node]
            p.slot[at] = np.where(left >= 0, again[left + right], -1)
            if whole and 2 * np.count_nonzero(p.slot >= 0) < len(p.slot):
                at = np.flatnonzero(p.slot >= 0)
                parts[i] = Part(p.columns[:, at], p.a[at], p.b[at], p.slot[at])


def trees_here(shape: Shape, blocks: list[SP.Block], fit: int, seeds: list[np.uint64]) -> list[Tree]:
    """Trees of one fit of a tree or forest, by their seeds."""
    # sums of whole numbers are the same in any order
    rows = [b.rows(shape.fits[fit]) for b in blocks]
    columns = np.ascontiguousarray(np.concatenate([b.x[r] for b, r in zip(blocks, rows)]).T)
    y, key = (np.concatenate([getattr(b, c)[r] for b, r in zip(blocks, rows)]) for c in ("y", "key"))
    out = []
    for seed in seeds:
        if shape.kind == "rf":
            a = bootstrap(key, seed)
            drawn = np.flatnonzero(a > 0)
            a = a[drawn]
            part = Part(columns[:, drawn], a, a * y[drawn], np.zeros(len(drawn), np.int64))
        else:
            part = Part(columns, np.ones(len(y)), y.astype(float), np.zeros(len(y), np.int64))
        g = Growing(fit, Tree.root(), np.zeros(1, int), 0, seed)
        grow_here(g, [part], shape)
        g.tree.settle(shape.ends, shape.kind, 1.0)
        out.append(g.tree)
    return out


def boosted_here(shape: Shape, blocks: list[SP.Block], fit: int, seeds: list[np.uint64]) -> list[Tree]:
    """Trees of one boosted fit, a round per seed."""
    share, rate = shape.fits[fit].params.get("subsample", 1.0), shape.fits[fit].params["learning_rate"]
    rows = [b.rows(shape.fits[fit]) for b in blocks]
    rows = [(np.ascontiguousarray(b.x[r].T), b.y[r], b.key[r], np.zeros(len(r))) for b, r in zip(blocks, rows)
            if len(r)]
    out = []
    for seed in seeds:
        parts = []
        for columns, y, key, m in rows:
            p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
            a, b, slot = p - y, np.maximum(p * (1 - p), 1e-16), np.zeros(len(y), np.int64)
            if share < 1.0:
                slot[uniform(key, seed) >= share] = -1
            parts.append(Part(columns, a, b, slot))
        g = Growing(fit, Tree.root(), np.zeros(1, int), 0, seed)
        grow_here(g, parts, shape)
        g.tree.settle(shape.ends, "gb", rate)
        for columns, _, _, m in rows:
            m += g.tree.value[g.tree.route_columns(columns)]
        out.append(g.tree)
    return out


class Learner:
    """Grows the trees of many fits of one kind over packed blocks."""

    def __init__(self, kind: str, data: DataFrame | SP.Packed, fits: list[SP.Fit], seed: int = 42,
                 label: str = "label", id_col: str = "id", max_bins: int = MAX_BINS):
        self.kind, self.fits, self.seed = kind, fits, seed
        values = SP.pack(data, SP.split_columns(fits), label, id_col)
        cuts, self.packed = bin_matrix(values, max_bins)
        self.n_bins = max(2, 1 + max(len(c) for c in cuts))
        self.dims = len(cuts)
        self.ends = np.zeros((self.dims, self.n_bins))
        for j, c in enumerate(cuts):
            self.ends[j, :len(c)] = c
        self.take = max(1, int(np.sqrt(self.dims))) if kind == "rf" else self.dims
        self.shape = Shape(kind, fits, self.n_bins, self.dims, self.take, self.ends)

    @property
    def local(self) -> bool:
        """Whether a task can hold the matrix."""
        return self.packed.n_rows * self.dims <= LOCAL_BYTES and self.packed.n_blocks <= SP.FAN_IN

    def grown_here(self, seeds: list[list[np.uint64]]) -> list[list[Tree]]:
        """Per fit a tree for each of its seeds. A boosted fit is a task, other
        trees are shared out; as many at once as return ``LOCAL_NODES`` at most."""
        spark, kind = self.packed.df.sparkSession, self.kind
        cores = spark.sparkContext.defaultParallelism
        held = SP.collected(self.packed)
        sent = spark.sparkContext.broadcast((self.shape, held))     # at most LOCAL_BYTES of bins
        cols, dtype, run_fit = self.packed.cols, self.packed.dtype, boosted_here if kind == "gb" else trees_here
        most = max(min(2.0 ** (f.params["max_depth"] + 1), 2.0 * self.packed.n_rows) for f in self.fits)
        few = max(1, int(LOCAL_NODES // most))
        if kind == "gb":
            step = max(1, few // max(map(len, seeds)))
            waves = [[(i, 0, len(seeds[i])) for i in range(s, min(s + step, len(seeds)))]
                     for s in range(0, len(seeds), step)]
        else:
            total = sum(map(len, seeds))
            size = max(1, min(few, total) // (2 * cores))
            jobs = [(i, s, min(s + size, len(own))) for i, own in enumerate(seeds) for s in range(0, len(own), size)]
            step = max(1, few // size)
            waves = [jobs[s:s + step] for s in range(0, len(jobs), step)]
        out: list[list[Tree]] = [[None] * len(own) for own in seeds]
        for jobs in waves:
            def run(batches: Iterator[pa.RecordBatch], jobs: list = jobs) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for j in b.column(0).to_pylist():
                        shape, rows = sent.value
                        i, begin, end = jobs[j]
                        own = run_fit(shape, SP.held_blocks(rows, cols, dtype), i, seeds[i][begin:end])
                        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array(
                            [pickle.dumps(own, pickle.HIGHEST_PROTOCOL)], pa.binary())], ["job", "trees"])
            got = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "job long, trees binary").toArrow()
            for j, blob in zip(got.column("job").to_pylist(), got.column("trees").to_pylist()):
                i, begin, end = jobs[j]
                out[i][begin:end] = pickle.loads(blob)
        sent.unpersist()
        return out

    def level(self, growing: list[Growing], margins=None) -> None:
        """One pass: split the frontier of every tree. ``margins`` turns a
        block into the fits' margins (boosted)."""
        width = self.shape.width
        units, of = [], {}
        for i, g in enumerate(growing):
            of[i] = range(len(units), len(units) + -(-len(g.frontier) // width))
            units += [Unit(i, s, min(s + width, len(g.frontier))) for s in range(0, len(g.frontier), width)]
        shapes = [(u.end - u.begin, self.take, self.n_bins) for u in units]
        params = [self.fits[growing[u.grow].fit].params for u in units]
        fits, kind, n_bins, take, dims = self.fits, self.kind, self.n_bins, self.take, self.dims

        sent = [g.slim() for g in growing]

        def work(block: SP.Block) -> Iterator[tuple[int, bytes]]:
            rows_of, stats_of = {}, {}
            columns = np.ascontiguousarray(block.x.T)
            m = margins(block, columns) if margins is not None else None
            for i, g in enumerate(sent):
                if g.fit not in rows_of:
                    rows_of = {g.fit: block.rows(fits[g.fit])}  # trees come fit by fit
                    stats_of = {}
                rows = rows_of[g.fit]
                if not len(rows):
                    continue
                y = block.y[rows]
                if kind == "gb":
                    share = fits[g.fit].params.get("subsample", 1.0)
                    if share < 1.0 and not stats_of:
                        rows = rows_of[g.fit] = rows[uniform(block.key[rows], g.seed) < share]
                        y = block.y[rows]
                    if not stats_of:
                        p = 1.0 / (1.0 + np.exp(-np.clip(m[g.fit][rows], -700, 700)))
                        stats_of = {0: (p - y, np.maximum(p * (1 - p), 1e-16))}
                    a, b = stats_of[0]
                elif kind == "rf":
                    a = bootstrap(block.key[rows], g.seed)
                    drawn = a > 0
                    rows, a, y = rows[drawn], a[drawn], y[drawn]
                    b = a * y
                else:
                    a, b = np.ones(len(rows)), y.astype(float)
                if np.count_nonzero(g.tree.left >= 0) <= FEW_SPLITS:
                    node = g.tree.route_columns(columns)[rows]
                else:
                    node = g.tree.route(block.x.ravel(), rows * block.x.shape[1], g.level)
                slot = np.full(len(g.tree.left), -1, np.int64)
                slot[g.frontier] = np.arange(len(g.frontier))
                slot = slot[node]
                if len(of[i]) > 1:
                    order = np.argsort(slot, kind="stable")
                    order = order[np.searchsorted(slot[order], 0):]
                else:
                    order = np.flatnonzero(slot >= 0)
                if not len(order):
                    continue
                s, own = slot[order], rows[order]
                a, b, feats = a[order], b[order], open_features(g, take, dims)
                for u in of[i]:
                    lo, hi = (0, len(s)) if len(of[i]) == 1 else \
                        np.searchsorted(s, [units[u].begin, units[u].end])
                    if hi == lo:
                        continue
                    at, part, nodes = own[lo:hi], s[lo:hi] - units[u].begin, units[u].end - units[u].begin
                    if feats is None:
                        bins = (c[at] for c in columns)
                    else:
                        base, mine = at * dims, feats[units[u].begin:units[u].end]
                        bins = (block.x.ravel()[base + mine[part, j]] for j in range(take))
                    if kind != "gb" and 4 * len(at) < nodes * n_bins:
                        yield u, coded_rows(bins, a[lo:hi], b[lo:hi], part)
                    else:
                        yield u, coded(histograms(bins, take, (a[lo:hi], b[lo:hi]), part, n_bins, nodes,
                                                  kind != "gb"))
        size = sum(16 * int(np.prod(s)) + 8 for s in shapes)
        got = SP.run_pass(self.packed, work, _Splits(shapes, kind, params), len(units), size)
        for i, g in enumerate(growing):
            self.shape.split(g, np.concatenate([np.frombuffer(got[u], _SPLIT) if u in got else
                                           none_found(units[u].end - units[u].begin) for u in of[i]]))

    def grow(self, growing: list[Growing], depth, margins=None) -> None:
        while open_ := [g for g in growing if len(g.frontier) and g.level < depth(self.fits[g.fit].params)]:
            part, nodes = [], 0
            for g in open_:  # deep trees take several passes a level
                if part and nodes + len(g.tree.left) > PASS_NODES:
                    self.level(part, margins)
                    part, nodes = [], 0
                part.append(g)
                nodes += len(g.tree.left)
            self.level(part, margins)

    def trees(self) -> list[list[Tree]]:
        """Trees (one a fit) or forests."""
        n = [f.params.get("n_estimators", 1) if self.kind == "rf" else 1 for f in self.fits]
        if self.local:
            return self.grown_here([[seed_of(self.seed, t) for t in range(k)] for k in n])
        growing = [Growing(i, Tree.root(), np.zeros(1, int), 0, seed_of(self.seed, t))
                   for i in range(len(self.fits)) for t in range(n[i])]
        self.grow(growing, lambda p: p["max_depth"])
        out: list[list[Tree]] = [[] for _ in self.fits]
        for g in growing:
            g.tree.settle(self.ends, self.kind, 1.0)
            out[g.fit].append(g.tree)
        return out

    def boosted(self) -> list[list[Tree]]:
        out: list[list[Tree]] = [[] for _ in self.fits]
        rounds = [f.params["n_estimators"] for f in self.fits]
        if self.local:
            return self.grown_here([[seed_of(self.seed, r) for r in range(k)] for k in rounds])
        written = 0
        n_fits = len(self.fits)
        for r in range(max(rounds)):
            if r and r % STATE_ROUNDS == 0:
                self.packed = SP.with_state(self.packed, _margins([t[written:] for t in out], n_fits))
                written = r
            growing = [Growing(i, Tree.root(), np.zeros(1, int), 0, seed_of(self.seed, r))
                       for i in range(n_fits) if r < rounds[i]]
            self.grow(growing, lambda p: p["max_depth"], _margins([t[written:] for t in out], n_fits))
            for g in growing:
                g.tree.settle(self.ends, "gb", self.fits[g.fit].params["learning_rate"])
                out[g.fit].append(g.tree)
        return out


def _margins(trees: list[list[Tree]], n_fits: int):
    """Block -> margins of every fit: the written ones and the trees since."""
    def margins(block: SP.Block, columns: np.ndarray | None = None) -> np.ndarray:
        m = np.zeros((n_fits, len(block.y))) if block.state is None else block.state.copy()
        if columns is None:
            columns = np.ascontiguousarray(block.x.T)
        for i, own in enumerate(trees):
            for t in own:
                m[i] += t.value[t.route_columns(columns)]
        return m
    return margins


# ---------------------------------------------------------------- models

class TreeModel:
    """A fitted tree ('dt'), forest ('rf') or boosted model ('gb'). ``depth``
    and ``rounds`` cut a larger fit off."""

    def __init__(self, kind: str, trees: list[Tree], n_features: int, key: str | None = None,
                 depth: int | None = None, rounds: int | None = None):
        self.kind, self.all_trees, self.n_features = kind, trees, n_features
        self.key, self.depth, self.rounds = key or kind, depth, rounds

    @property
    def trees(self) -> list[Tree]:
        return self.all_trees[:self.rounds]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Boosted: log odds; otherwise the probability."""
        return self.margins(x, [self])[0]

    @staticmethod
    def margins(x: np.ndarray, models: Sequence["TreeModel"]) -> list[np.ndarray]:
        """The margins of cuts of one fit: each tree is descended once, whatever
        the number of depths and rounds."""
        of = models[0]
        deepest = [int(t.level.max()) for t in of.all_trees]
        depths = sorted({m.depth for m in models} - {None})
        rounds = [len(m.trees) for m in models]
        total = {d: np.zeros(len(x)) for d in {m.depth for m in models}}
        out: list = [np.zeros(len(x)) for _ in models]
        for r, t in enumerate(of.all_trees[:max(rounds)]):
            stops = [(d, d) for d in depths] + ([(deepest[r], None)] if None in total else [])
            stops.sort(key=lambda s: s[0])
            for (_, d), node in zip(stops, t.leaves(x, [s for s, _ in stops])):
                total[d] += t.value[node]
            for i, m in enumerate(models):
                if rounds[i] == r + 1:
                    out[i] = total[m.depth].copy()
        return [o if of.kind == "gb" else o / max(1, n) for o, n in zip(out, rounds)]

    def proba(self, x: np.ndarray) -> np.ndarray:
        return self.probas(x, [self])[0]

    @staticmethod
    def probas(x: np.ndarray, models: Sequence["TreeModel"]) -> list[np.ndarray]:
        got = TreeModel.margins(x, models)
        if models[0].kind != "gb":
            return got
        return [1.0 / (1.0 + np.exp(-np.clip(m, -700, 700))) for m in got]

    @property
    def featureImportances(self):
        """Tree and forest: share of the impurity decrease, averaged over
        trees; boosted: mean gain of a feature's splits. Sums to one."""
        total, count = np.zeros(self.n_features), np.zeros(self.n_features)
        for t in self.trees:
            on = (t.left >= 0) & (t.level < (self.depth if self.depth is not None else 1 << 14))
            own = np.bincount(t.feature[on], t.gain[on], self.n_features)
            if self.kind == "gb":
                total += own
                count += np.bincount(t.feature[on], minlength=self.n_features)
            elif own.sum() > 0:
                total += own / own.sum()
        if self.kind == "gb":
            total = total / np.maximum(count, 1)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)  # sized by the model

        @F.arrow_udf("double")
        def score(f: pa.Array) -> pa.Array:
            return pa.array(sent.value.margin(SP.matrix(f)))
        m, p = f"__m_{self.key}", f"__p_{self.key}"
        out = df.withColumn(m, score(vector_to_array(features)))
        if self.kind == "gb":
            out = out.withColumn(p, 1.0 / (1.0 + F.exp(-F.col(m))))
            raw = F.array(-F.col(m), F.col(m))
        else:
            out = out.withColumn(p, F.col(m))
            raw = F.array(1.0 - F.col(m), F.col(m))
        return out.withColumns({
            f"raw_{self.key}": array_to_vector(raw),
            f"prob_{self.key}": array_to_vector(F.array(1.0 - F.col(p), F.col(p))),
            f"pred_{self.key}": (F.col(p) > 0.5).cast("double")}).drop(m, p)

    def cut(self, depth: int | None = None, rounds: int | None = None) -> "TreeModel":
        return TreeModel(self.kind, self.all_trees, self.n_features, self.key, depth, rounds)

    def save(self, path: str) -> None:
        arrays = {f"{n}{i}": getattr(t, n) for i, t in enumerate(self.trees)
                  for n in ("feature", "bin", "left", "gain", "a", "b", "level", "path", "threshold", "value")}
        blob = io.BytesIO()
        np.savez_compressed(blob, **arrays)
        meta = json.dumps({"kind": self.kind, "n": len(self.trees), "n_features": self.n_features,
                           "key": self.key, "depth": self.depth})
        SparkSession.getActiveSession().createDataFrame(
            [(meta, bytearray(blob.getvalue()))], "meta string, trees binary").coalesce(1) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeModel":
        r = spark.read.parquet(path).first()
        m, z = json.loads(r["meta"]), np.load(io.BytesIO(bytes(r["trees"])))
        names = ("feature", "bin", "left", "gain", "a", "b", "level", "path", "threshold", "value")
        trees = [Tree(**{n: z[f"{n}{i}"] for n in names}) for i in range(m["n"])]
        return cls(m["kind"], trees, m["n_features"], m["key"], m["depth"])


def _shared(kind: str, params: dict) -> tuple[str, tuple]:
    """The parameter a larger fit covers, and the others."""
    free = "n_estimators" if kind == "gb" else "max_depth"
    return free, tuple(sorted((k, v) for k, v in params.items() if k != free))


def fit_many(kind: str, data: DataFrame | SP.Packed, fits: Sequence[SP.Fit], key: str | None = None,
             seed: int = 42, label: str = "label", id_col: str = "id",
             max_bins: int = MAX_BINS) -> list[TreeModel]:
    """One model per fit. Fits that differ only in depth (dt, rf) or rounds
    (gb) are grown once, at the largest."""
    groups: dict = {}
    for i, f in enumerate(fits):
        free, rest = _shared(kind, f.params)
        groups.setdefault((f.out, rest), []).append(i)
    free = "n_estimators" if kind == "gb" else "max_depth"
    grown = [replace(fits[m[0]], params={**fits[m[0]].params, free: max(fits[i].params[free] for i in m)})
             for m in groups.values()]
    learner = Learner(kind, data, grown, seed, label, id_col, max_bins)
    trees = learner.boosted() if kind == "gb" else learner.trees()
    out: list = [None] * len(fits)
    for members, own in zip(groups.values(), trees):
        whole = TreeModel(kind, own, learner.dims, key)
        for i in members:
            limit = fits[i].params[free]
            out[i] = whole.cut(rounds=limit) if kind == "gb" else whole.cut(depth=limit)
    return out
