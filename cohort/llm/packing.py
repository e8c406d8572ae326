"""Best-fit packing of token sequences, bulk-synchronous.

Documents are tokenised where they lie; from then on only piece descriptions
(id, piece, start, length, checksum) move. They are written range-sorted by
length, and open gaps are a table of (sequence, tokens used). A round

1. takes the pieces of a band (lengths from ``band`` times the longest unplaced
   one up) and the gaps that could hold one, and opens as many sequences as the
   tokens that no gap can hold must have at least;
2. range-sorts pieces and gaps together, by falling size, and sweeps: read as
   brackets, a gap opens a level (several, if it holds several pieces of any
   length in the band) and a piece closes one, so the bracket a piece closes is
   the smallest unused gap that holds it, its successor. Each partition sums up
   its own depth, the sums of the partitions before shift it, and a piece's
   partner is the row before it on its level;
3. settles conflicts by rank: of pieces with the same successor the k-th takes
   the k-th gap above, and of pieces in one gap the longer lies first;
4. writes the placed pieces, the pieces left and the smaller gaps, and repeats.

Sizes: a level, like a sequence, has at most about two rows a length, so no
group grows with the table, also not that of a length which a third of all
pieces share. The driver holds counts by size (at most twice the capacity) and
one number a partition. The band falls geometrically, so the number of rounds
depends on the capacity and hardly on the number of pieces. All rounds are
written tables in the session's shared folder, so a lost executor costs no more
than the running step.

Defined results: null text is empty and packs as its end token alone; empty
table, empty result; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort.llm.common import chunks, map_arrow, stage_dir, text_or_empty

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    vocabulary: str = "byte_bpe_50k"
    end_id: int = 0
    band: float = 0.4               # shortest length of a round to the longest unplaced
    rows_per_task: int = 200_000    # of a sweep; a row is some 60 bytes


class Encoder:
    """Token ids of a vocabulary file. The rank file holds the same vocabulary
    as the tokenizers file and gives the same ids several times faster; the
    tokenizers library takes over for a text that the other refuses."""

    def __init__(self, vocabulary: str):
        import tiktoken
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks,
                                      special_tokens={"<|endoftext|>": len(ranks)})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # noqa: BLE001  its native panics are not Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.exact(text)

    def exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, p: Params = Params()) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.vocabulary)
        for c in chunks(batch):
            out = []
            for doc, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                ids = np.append(enc(text), np.uint32(p.end_id)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), p.capacity)):
                    out.append((doc, k, s, n, zlib.crc32(ids[s:s + n].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(),
                                                            pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(rows, run, PIECES)


# -- rounds ---------------------------------------------------------------------

#: A row of a round: a gap (kind 0; ``length`` null, ``offset`` the tokens used)
#: or a piece (kind 1; unplaced while ``sequence_id`` is null).
STATE = f"kind int, {PIECES}, sequence_id long, offset long"
NAMES = [x.split()[0] for x in STATE.split(", ")]
SWEPT = f"{STATE}, size long, slots long, part int, at long, depth long"


class Store:
    """Written tables of one run, in the session's shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{stage_dir(spark)}/packing-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.get(schema, name)

    def get(self, schema: str, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{n}" for n in names))


def counts(df: DataFrame, size: Column) -> dict[int, int]:
    """Rows by size; there are at most as many sizes as the capacity."""
    return {r["size"]: r["n"] for r in
            df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}


def local_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends a row's place in its sorted partition and the depth before it: the
    slots opened less the pieces met since the partition began."""
    at = depth = 0
    for b in batches:
        slots = b.column(b.schema.get_field_index("slots")).to_numpy()
        after = depth + np.cumsum(np.where(slots > 0, slots, -1))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.arange(at, at + len(slots))),
             pa.array(np.concatenate([[depth], after[:-1]])[:len(slots)])],
            [*b.schema.names, "at", "depth"])
        if len(slots):
            at, depth = at + len(slots), int(after[-1])


def swept(rows: DataFrame, n_parts: int, store: Store, name: str) -> DataFrame:
    """Pieces of ``rows`` with the sequence of their successor gap, or null.
    ``size`` orders the sweep; ``slots`` is 0 for a piece."""
    keys = [F.col("size").desc(), F.col("kind"), F.col("sequence_id"), F.col("doc_id"),
            F.col("piece")]
    ranged = rows.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    # written once: range bounds come from a sample, and both reads need the same
    t = store.put(ranged.withColumn("part", F.spark_partition_id())
                  .mapInArrow(local_depth, SWEPT), name, SWEPT)
    sums = (t.groupBy("part").agg(F.sum(F.when(F.col("slots") > 0, F.col("slots"))
                                        .otherwise(-1)).alias("change"))
            .orderBy("part").collect())            # one row a partition
    before = np.cumsum([0, *(r["change"] for r in sums)])
    shift = store.spark.createDataFrame(
        [(r["part"], int(b)) for r, b in zip(sums, before)], "part int, before long").coalesce(1)
    t = t.join(F.broadcast(shift), "part").withColumn("depth", F.col("depth") + F.col("before"))
    # a gap opens the levels above the depth before it, a piece closes the top one
    level = F.explode(F.when(F.col("kind") == 0, F.sequence(
        F.col("depth") + 1, F.col("depth") + F.col("slots"))).otherwise(F.array("depth")))
    w = Window.partitionBy("level").orderBy("part", "at")
    return (t.withColumn("level", level)
            # on a level gaps and pieces take turns: the row before is the partner
            .withColumn("sequence_id", F.when(F.col("kind") == 1, F.lag("sequence_id").over(w))
                        .otherwise(F.col("sequence_id")))
            .where("kind = 1"))


def settled(found: DataFrame, gaps: DataFrame) -> DataFrame:
    """The state after a round: the pieces that met a gap lie in it one after the
    other, and the gap has their tokens used."""
    rank = F.struct("part", "at")
    rows = (found.select(*NAMES, rank.alias("rank"))
            .unionByName(gaps, allowMissingColumns=True)
            # pieces without a gap are each a group of their own
            .withColumn("tokens", F.when(F.col("kind") == 0, F.col("offset"))
                        .otherwise(F.col("length")))
            .withColumn("lone", F.when(F.col("sequence_id").isNull(), F.col("rank"))))
    group = Window.partitionBy("sequence_id", "lone")
    so_far = group.orderBy("kind", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*NAMES[:-1], F.when(F.col("kind") == 0, F.sum("tokens").over(group))
                       .when(F.col("sequence_id").isNotNull(), F.sum("tokens").over(so_far))
                       .alias("offset"))


def gap_size(p: Params) -> Column:
    return F.lit(p.capacity) - F.col("offset")


def opened(band: dict[int, int], largest: int, p: Params) -> int:
    """Sequences to open for a band: what its pieces longer than every gap need
    at least, by tokens and because no two above half the capacity share one."""
    tokens = sum(n * c for n, c in band.items() if n > largest)
    return max(-(-tokens // p.capacity),
               sum(c for n, c in band.items() if n > max(largest, p.capacity // 2)))


def as_state(df: DataFrame, **given: Column) -> DataFrame:
    """``df`` with the columns of a state; absent ones are null."""
    cols = []
    for x in STATE.split(", "):
        name, kind = x.split()
        col = given.get(name, F.col(name) if name in df.columns else F.lit(None))
        cols.append(col.cast(kind).alias(name))
    return df.select(*cols)


def band_of(waiting: dict[int, int], left: dict[int, int], floor: int, p: Params) -> int:
    """Shortest length of the next band; bands never rise."""
    return min(floor, max(1, math.ceil(p.band * max([*waiting, *left]))))


def place(found: DataFrame, p: Params, store: Store) -> DataFrame:
    """Rows of PIECES with their sequence_id and offset."""
    spark = found.sparkSession
    waiting = counts(found, F.col("length"))       # lengths below every band so far
    # by length, so a band is read from few of the files
    base = store.put(found.repartitionByRange("length", "doc_id", "piece")
                     .sortWithinPartitions("length"), "pieces", PIECES)
    left: dict[int, int] = {}                      # lengths met by a band, unplaced
    gaps: dict[int, int] = {}                      # open gaps by size
    state, floor, total, done = None, p.capacity + 1, 0, 0
    while waiting or left:
        low = band_of(waiting, left, floor, p)
        band = dict(left)
        for n in [n for n in waiting if n >= low]:
            band[n] = band.get(n, 0) + waiting.pop(n)
        longest, shortest, least = max(band), min(band), min([*band, *waiting])
        new = opened(band, max(gaps, default=0), p)
        gaps[p.capacity] = gaps.get(p.capacity, 0) + new

        members = as_state(base.where(F.col("length").between(low, floor - 1)), kind=F.lit(1))
        holders = as_state(spark.range(total, total + new, 1, 1 + new // p.rows_per_task),
                           kind=F.lit(0), sequence_id=F.col("id"), offset=F.lit(0))
        if state is not None:
            members = members.union(state.where("kind = 1 and sequence_id is null"))
            # a gap smaller than every unplaced piece is closed
            holders = holders.union(state.where((F.col("kind") == 0) & (gap_size(p) >= least)))
        slots = F.greatest(F.lit(1), F.floor(gap_size(p) / longest))
        rows = members.select("*", F.col("length").alias("size"),
                              F.lit(0).cast("long").alias("slots")).union(
            holders.where(gap_size(p) >= shortest)
            .select("*", gap_size(p).alias("size"), slots.cast("long").alias("slots")))
        n_rows = sum(band.values()) + sum(c for n, c in gaps.items() if n >= shortest)
        met = swept(rows, 1 + n_rows // p.rows_per_task, store, f"sweep-{done}")
        state = store.put(settled(met, holders), f"state-{done}", STATE)

        # gaps count under minus their size
        both = counts(state.where("kind = 0 or sequence_id is null"),
                      F.when(F.col("kind") == 1, F.col("length")).otherwise(-gap_size(p)))
        left = {n: c for n, c in both.items() if n > 0}
        gaps = {-n: c for n, c in both.items() if n < 0}
        floor, total, done = low, total + new, done + 1
    if not done:
        return as_state(base).drop("kind")
    return (store.get(STATE, *(f"state-{k}" for k in range(done)))
            .where("kind = 1 and sequence_id is not null").drop("kind"))


def pack(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    store = Store(docs.sparkSession)
    # written first: range partitioning reads its input twice (once for a sample
    # of the bounds), and these narrow rows stand for all of the tokenising
    return place(store.put(pieces(docs, p), "found", PIECES), p, store)
