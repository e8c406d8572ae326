"""Merkle manifest of a dataset, with an inclusion proof for every row.

Each row is a leaf. The leaves of a source, by id, form one tree whose runs of
``arity`` consecutive nodes become one node each; the roots of these trees
(subroots), by source, form the top tree in the same way.

Plan:

1. Leaf digests are made where the texts lie; from then on a row is its digest.
2. Leaves get their place in their source by range partitioning on (source, id,
   digest), so one source may hold a third of all rows.
3. One aggregate per level makes the nodes of the next level; a group has at most
   ``arity`` rows. The driver counts nodes only.
4. Proofs by pointer jumping: every inner node starts with the segment of its
   siblings in its run and a pointer to its parent. In each round a node that
   points to an ancestor joins that ancestor, appends its segment and takes over
   its pointer, which doubles the distance, until every pointer has reached the
   root: ceil(log2(depth)) rounds. The leaves of a run share the path of their
   parent, so they travel as one row and join it when it is complete. Ancestors
   are few and many nodes point to them: they are joined by a broadcast of
   checked size, beyond that by a shuffle that adaptive execution splits.

A segment holds, level by level, two bytes (place in the run, number of
siblings) and the siblings' 32-byte digests.

Defined results: a null field is ``-``; a null source is a source and comes
first; ties of the id (null first) go by leaf digest; rows alike in all fields
are leaves of their own. A source with one row has its leaf as subroot, a table
with one source its subroot as root. An empty table gives an empty result. Only
the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohort.llm.common import chunks, cut_lineage, utf8_buffer
from cohort.operators.joins import lookup_join
from cohort.operators.ordering import positions

#: Tree key of the top tree; a source's key is '' (null) or 's' and its name,
#: which keeps the order of the sources.
TOP = "t"
DIGEST = 32
BROADCAST_BYTES = 64 << 20
#: Runs turned into proof rows at once inside a task.
RUNS = 512


@dataclass(frozen=True)
class Fields:
    """Columns hashed into a leaf, in this order."""
    id: str = "doc_id"
    source: str = "source"
    lang: str = "lang"
    n_chars: str = "n_chars"
    text: str = "text"


@dataclass(frozen=True)
class Manifest:
    """The trees of a table, written.

    ``runs``: k, i, lone (the source has one row), c (array of pos, id, leaf,
    bad). ``paths``: nk, nl, ni (node), seg (siblings up to the root), sub
    (subroot; null: it is the root). ``root``: its digest, None without rows.
    """
    runs: DataFrame
    paths: DataFrame | None
    root: bytes | None


def field_bytes(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _utf8(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, None for null."""
    raw, offs = utf8_buffer(col)
    data, o = raw.tobytes(), offs.tolist()
    return [data[a:b] if v else None for a, b, v in zip(o[:-1], o[1:], col.is_valid().to_pylist())]


def _leaves(docs: DataFrame, f: Fields, tampered: Column) -> DataFrame:
    """k (tree key), id, leaf, bad (digest of the row with the A-Z of its text
    lower-cased, where ``tampered``): one row per input row."""
    text = [F.col(c).cast("string").alias(n) for n, c in
            (("idt", f.id), ("source", f.source), ("lang", f.lang), ("n", f.n_chars), ("text", f.text))]
    src = docs.select(F.col(f.id).alias("id"), tampered.alias("hit"), *text)
    fields = T.StructType([T.StructField("k", T.StringType()), src.schema["id"],
                           T.StructField("leaf", T.BinaryType()), T.StructField("bad", T.BinaryType())])
    schema = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for b in chunks(batch):
                k, leaf, bad = [], [], []
                for hit, i, source, lang, n, t in zip(
                        b.column(1).to_pylist(), *(_utf8(b.column(j)) for j in range(2, 7))):
                    head = b"".join(map(field_bytes, (i, source, lang, n)))
                    leaf.append(digest(head + field_bytes(t)))
                    # bytes.lower: A-Z only
                    bad.append(digest(head + field_bytes(t and t.lower())) if hit else None)
                    k.append("" if source is None else "s" + source.decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.string()), b.column(0), pa.array(leaf, pa.binary()),
                     pa.array(bad, pa.binary())], schema=schema)
    return src.mapInArrow(run, fields)


def _hex(digests: Column) -> Column:
    return F.lower(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def _div(col: str, n: int) -> Column:
    return F.expr(f"{col} div {n}")


def _climb(level: DataFrame, most: int, arity: int, last: bool) -> tuple[list[DataFrame], DataFrame]:
    """Build trees upwards. ``level``: tree, height, pos, m (nodes of the tree
    at this height, ``most`` at most), d, and the node's name nk, nl, ni.

    Returns the nodes below the trees' roots (a frame per height: nk, nl, ni,
    d, segment seg of the run, parent pk, pl, pi - null if the parent is the
    root of all, which a tree's root is if ``last``) and the roots (in the
    columns of ``level``)."""
    below, roots = [], level.where("m = 1")
    while most > 1:
        runs = cut_lineage(level.where("m > 1").groupBy("tree", _div("pos", arity).alias("up")).agg(
            F.max(_div(f"(m + {arity - 1})", arity)).alias("m"), (F.max("height") + 1).alias("height"),
            F.array_sort(F.collect_list(F.struct("pos", "d", "nk", "nl", "ni"))).alias("c")))
        others = F.filter(F.col("c"), lambda c: c["pos"] != F.col("me.pos"))
        seg = F.concat(_byte(F.pmod("me.pos", F.lit(arity))), _byte(F.size(others)),
                       F.unhex(_hex(F.transform(others, lambda c: c["d"]))))
        points = F.lit(not last) | (F.col("m") > 1)
        below.append(runs.select("*", F.explode("c").alias("me")).select(
            "me.nk", "me.nl", "me.ni", "me.d", seg.alias("seg"),
            F.when(points, F.col("tree")).alias("pk"), F.when(points, F.col("height")).alias("pl"),
            F.when(points, F.col("up")).alias("pi")))
        level = runs.select(
            "tree", "height", F.col("up").alias("pos"), "m",
            F.unhex(F.sha2(_hex(F.col("c.d")), 256)).alias("d"),
            F.col("tree").alias("nk"), F.col("height").alias("nl"), F.col("up").alias("ni"))
        roots = roots.unionByName(level.where("m = 1"))
        most = -(-most // arity)
    return below, roots


def _steps(n: int, arity: int) -> int:
    """Levels between n nodes and their root."""
    steps = 0
    while n > 1:
        n, steps = -(-n // arity), steps + 1
    return steps


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _jump(nodes: DataFrame, depth: int) -> DataFrame:
    """Pointer jumping: after round r a node's segment covers 2^r steps and its
    pointer is so far away, or null where the root is reached. ``depth``: steps
    of the longest path."""
    distance = 1
    while distance < depth:
        nodes = cut_lineage(nodes)
        # a node within a source's tree is only pointed to from that far below
        above = nodes.where((F.col("nk") == TOP) | (F.col("nl") > distance)).select(
            *[F.col(c).alias(f"a_{c}") for c in nodes.columns])
        n, size = above.agg(F.count(F.lit(1)), F.sum(F.octet_length("a_seg") + 200)).first()
        if (size or 0) <= BROADCAST_BYTES:
            above = F.broadcast(above)
        nodes = nodes.join(above, (F.col("pk") == F.col("a_nk")) & (F.col("pl") == F.col("a_nl"))
                           & (F.col("pi") == F.col("a_ni")), "left").select(
            "nk", "nl", "ni",
            F.concat("seg", F.coalesce("a_seg", F.lit(b""))).alias("seg"),
            F.coalesce("sub", "a_sub").alias("sub"),
            F.col("a_pk").alias("pk"), F.col("a_pl").alias("pl"), F.col("a_pi").alias("pi"))
        distance *= 2
    return nodes


def build(docs: DataFrame, f: Fields = Fields(), arity: int = 16,
          tampered: Column | None = None) -> Manifest:
    """Hash all rows, build the trees and every run's path to the root."""
    if not 2 <= arity <= 128:
        raise ValueError("arity must be 2 to 128")
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    placed = positions(_leaves(docs, f, hit), ["k"], ["id", "leaf"], "pos")
    runs = cut_lineage(placed.groupBy("k", _div("pos", arity).alias("i")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "bad"))).alias("c")))
    sizes = cut_lineage(runs.groupBy("k").agg(F.sum(F.size("c")).alias("leaves")))
    sources, most = sizes.agg(F.count(F.lit(1)), F.max("leaves")).first()
    runs = lookup_join(runs, sizes, "k").withColumn("lone", F.col("leaves") == 1)
    if not sources:
        return Manifest(runs, None, None)
    # the node above a run; a lone leaf stands for itself
    level = runs.select(
        F.col("k").alias("tree"), F.lit(1).alias("height"), F.col("i").alias("pos"),
        _div(f"(leaves + {arity - 1})", arity).alias("m"),
        F.when(F.col("lone"), F.col("c")[0]["leaf"]).otherwise(
            F.unhex(F.sha2(_hex(F.col("c.leaf")), 256))).alias("d"),
        F.col("k").alias("nk"), F.lit(1).alias("nl"), F.col("i").alias("ni"))
    most = -(-most // arity)
    below, subroots = _climb(level, most, arity, sources == 1)
    nodes = [b.withColumn("sub", F.lit(None).cast("binary")) for b in below]
    if sources == 1:
        root = subroots.first()["d"]
    else:
        ranked = positions(subroots.drop("pos"), [], ["tree"], "pos")
        level = ranked.withColumns({"tree": F.lit(TOP), "height": F.lit(0),
                                    "m": F.lit(sources).cast("long")})
        above, tops = _climb(level, sources, arity, True)
        root = tops.first()["d"]
        # the lowest level of the top tree are the subroots
        nodes += [b.withColumn("sub", F.col("d") if i == 0 else F.lit(None).cast("binary"))
                  for i, b in enumerate(above)]
    depth = _steps(most, arity) + _steps(sources, arity)
    return Manifest(runs, _jump(_union(nodes).drop("d"), depth) if nodes else None, bytes(root))


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf digest and its proof give."""
    at = 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1]
        side = proof[at + 2:at + 2 + n * DIGEST]
        cut = place * DIGEST
        leaf = digest((side[:cut] + leaf + side[cut:]).hex().encode())
        at += 2 + n * DIGEST
    return leaf


def siblings(proof: bytes) -> bytes:
    """The digests of a proof without its places."""
    out, at = [], 0
    while at < len(proof):
        n = proof[at + 1]
        out.append(proof[at + 2:at + 2 + n * DIGEST])
        at += 2 + n * DIGEST
    return b"".join(out)


def _rows(m: Manifest, fields: T.StructType, fn) -> DataFrame:
    """``fn(path, subroot, lone, children)`` yields the result rows of a run."""
    runs, root = m.runs.select("k", "i", "lone", "c"), m.root
    if m.paths is None:
        with_path = runs.withColumns({"seg": F.lit(b""), "sub": F.lit(None).cast("binary")})
    else:
        low = m.paths.where((F.col("nl") == 1) & (F.col("nk") != TOP)).select("nk", "ni", "seg", "sub")
        with_path = runs.join(low, (F.col("k") == F.col("nk")) & (F.col("i") == F.col("ni")), "left")
    src = with_path.select("seg", "sub", "lone", "c")
    schema = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, RUNS):
                rows = [r for x in batch.slice(s, RUNS).to_pylist()
                        for r in fn(x["seg"] or b"", x["sub"] or root, x["lone"], x["c"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return src.mapInArrow(run, fields)


def _own(lone: bool, children: list, j: int) -> bytes:
    """Segment of a leaf in its run."""
    if lone:
        return b""
    return bytes([j, len(children) - 1]) + b"".join(
        c["leaf"] for x, c in enumerate(children) if x != j)


def _id_field(m: Manifest, name: str) -> T.StructField:
    return T.StructField(name, m.runs.schema["c"].dataType.elementType["id"].dataType)


def proofs(docs: DataFrame, f: Fields = Fields(), arity: int = 16) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof (binary; ``fold``
    checks it)."""
    m = build(docs, f, arity)
    fields = T.StructType([_id_field(m, f.id), *[T.StructField(n, T.BinaryType())
                                                 for n in ("leaf", "subroot", "root", "proof")]])
    root = m.root

    def rows(path, sub, lone, children):
        for j, c in enumerate(children):
            yield c["id"], c["leaf"], sub, root, _own(lone, children, j) + path
    return _rows(m, fields, rows)


def audit(docs: DataFrame, tampered: Column, f: Fields = Fields(), arity: int = 16) -> DataFrame:
    """One row per input row, digests as hex text: id, leaf, subroot, root,
    proof_sha256 (over the proof's siblings as hex text), folded_root (from the
    tampered row where ``tampered``: its text with A-Z lower-cased) and
    verified."""
    m = build(docs, f, arity, tampered)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    fields = T.StructType([_id_field(m, f.id), *[T.StructField(n, T.StringType()) for n in names],
                           T.StructField("verified", T.BooleanType())])
    root = m.root

    def rows(path, sub, lone, children):
        upper, roots = siblings(path).hex().encode(), {}
        for j, c in enumerate(children):
            own = _own(lone, children, j)
            node = fold(c["leaf"] if c["bad"] is None else c["bad"], own)
            if node not in roots:  # honest leaves of a run meet in one node
                roots[node] = fold(node, path)
            got = roots[node]
            yield (c["id"], c["leaf"].hex(), sub.hex(), root.hex(),
                   hashlib.sha256(siblings(own).hex().encode() + upper).hexdigest(), got.hex(),
                   got == root)
    return _rows(m, fields, rows)


def every_fifth(doc_id: Column) -> Column:
    """Rows whose unsigned crc32 of the decimal id is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
