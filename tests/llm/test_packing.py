import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohort.llm import packing as P

SCHEMA = "doc_id long, text string, length int, start string"


def best_fit_decreasing(lengths, capacity):
    """Row-at-a-time best fit over the sorted lengths: number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


class Gaps:
    """Open gaps as runs of consecutive sequences, sorted by size; successor
    search over the sizes that exist."""

    def __init__(self, capacity: int):
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.sizes = 0                       # bit s is set if a gap of size s exists

    def successor(self, size: int) -> int | None:
        above = self.sizes >> size
        return None if not above else size + (above & -above).bit_length() - 1

    def put(self, size: int, first: int, count: int) -> None:
        if size and count:
            self.runs[size].append((first, count))
            self.sizes |= 1 << size

    def take(self, size: int) -> tuple[int, int]:
        run = self.runs[size].pop()
        if not self.runs[size]:
            self.sizes &= ~(1 << size)
        return run


def sweep(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placement runs (length, first rank, count, first sequence, offset) of
    best fit over a histogram of lengths, and the number of sequences: ranks
    first..first+count-1 of a length go to that many consecutive sequences."""
    gaps, placed, opened = Gaps(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            size = gaps.successor(length)
            if size is None:                 # open what the rest needs
                new = -(-left // (capacity // length))
                gaps.put(capacity, opened, new)
                opened += new
                continue
            first, count = gaps.take(size)
            layers = size // length          # best fit fills a gap before the next
            full = min(count, left // layers)
            if full:
                for k in range(layers):
                    placed.append((length, rank + k * full, full, first,
                                   capacity - size + k * length))
                rank, left = rank + layers * full, left - layers * full
                gaps.put(size - layers * length, first, full)
                first, count = first + full, count - full
            if count and left:               # fewer pieces than one gap holds
                for k in range(left):
                    placed.append((length, rank + k, 1, first, capacity - size + k * length))
                gaps.put(size - left * length, first, 1)
                rank, left = rank + left, 0
                first, count = first + 1, count - 1
            gaps.put(size, first, count)
    return np.array(placed, np.int64).reshape(-1, 5), opened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150))
def test_loop_over_runs_equals_row_at_a_time_best_fit(lengths):
    assert sweep(dict(Counter(lengths)), 40)[1] == best_fit_decreasing(lengths, 40)


def as_pieces(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, int(n), 7) for i, n in enumerate(lengths)],
                                 P.PIECES).repartition(5)


def sequences(rows, capacity):
    """Number of sequences, each filled without a hole and not beyond the capacity."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def successor_match(pieces, gaps):
    """Row at a time: pieces by falling length take the smallest gap with a slot
    left; per gap the pieces' lengths, and the lengths without one."""
    left, taken, none = sorted([g, s, k] for k, (g, s) in enumerate(gaps)), defaultdict(list), []
    for n in sorted(pieces, reverse=True):
        fit = next((x for x in left if x[0] >= n and x[1]), None)
        if fit is None:
            none.append(n)
        else:
            fit[1] -= 1
            taken[gaps[fit[2]][0]].append(n)
    return {g: sorted(v) for g, v in taken.items()}, sorted(none)


def test_sweep_meets_successors_across_partitions(spark):
    rng = np.random.default_rng(4)
    for seed, hot in enumerate([0, 60, 200]):
        pieces = [*rng.integers(1, 30, 150).tolist(), *[9] * hot]
        gaps = [(int(g), int(s)) for g, s in zip(rng.integers(1, 40, 70), [1, 3] * 35)]
        slots = {}
        gaps = [(g, slots.setdefault(g, s)) for g, s in gaps]    # by size, as in a round
        rows = [(1, i, 0, 0, n, 7, None, None, n, 0) for i, n in enumerate(pieces)]
        rows += [(0, None, None, None, None, None, k, 40 - g, g, s)
                 for k, (g, s) in enumerate(gaps)]
        df = spark.createDataFrame(rows, f"{P.STATE}, size long, slots long")
        for parts in (1, 6):
            got = P.swept(df, parts, P.Store(spark), "t").collect()
            met = defaultdict(list)
            for r in got:
                if r.sequence_id is not None:
                    met[gaps[r.sequence_id][0]].append(r.length)
            used = Counter(r.sequence_id for r in got if r.sequence_id is not None)
            assert all(c <= gaps[k][1] for k, c in used.items())
            assert ({g: sorted(v) for g, v in met.items()},
                    sorted(r.length for r in got if r.sequence_id is None)) \
                == successor_match(pieces, gaps)


def test_rounds_need_hardly_more_sequences_than_best_fit(spark):
    rng = np.random.default_rng(5)
    cases = [np.full(30, 34), np.concatenate([np.ones(300, int), rng.integers(1, 101, 300)])]
    for lengths in cases:
        got = P.place(as_pieces(spark, lengths), P.Params(capacity=100, rows_per_task=150),
                      P.Store(spark)).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
        assert [r.length for r in sorted(got, key=lambda r: r.doc_id)] == lengths.tolist()
        assert {r.ids_crc32 for r in got} == {7}
        want = sweep(dict(Counter(lengths.tolist())), 100)[1]
        assert sequences(got, 100) <= 1.01 * want + 1


def test_pack_covers_every_token_once(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|> x", "äöü \x00   ½", "a" * 50_000, " " * 9_000]
    texts += [" ".join(rng.choice(["the", "ndthe", "Straße", "12345", "...", "\n"])
                       for _ in range(rng.choice([1, 30, 700, 9000]))) for _ in range(60)]
    texts += ["same text of a hot length"] * 60
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(6)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        bounds = [0, *range(head, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    rows = P.pack(df).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    lengths = Counter(n for _, n, _ in want.values())
    assert sequences(rows, 2048) <= sweep(dict(lengths), 2048)[1] + 1


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.pack(empty).collect() == []
    twice = spark.createDataFrame([(1, "a b", 1, "x")] * 2 + [(None, "c", 1, "x")], SCHEMA)
    got = P.pack(twice).collect()
    assert len(got) == 3 and len({r.offset for r in got}) == 3


def test_both_encoders_agree_on_odd_text():
    enc = P.Encoder("byte_bpe_50k")
    for t in ["", "it's 'S don'T", " 　 x\t\t\ty", "\U0001f600‍", "é", "٣٤ ⅷ",
              "a\r\n\r\n b", "<|endoftext|><|endoftext|>", " \n ", "﻿\x85x"]:
        assert enc(t).tolist() == enc.exact(t).tolist()
