"""Quality rules: counting rules plus distribution divergence.

A document's character-class histogram and its common-word histogram are
compared with the reference histograms of its language by the Jensen-Shannon
distance (square root of the base-2 divergence, 0 to 1). References are exact
counts over the whole corpus:

1. Heavy words. Tasks count words in blocks of bounded size and report those
   that reach a quarter of ``word_share`` in a block. A word with that share of
   its language then misses at most a quarter of it, so all words whose
   reported count reaches three quarters of the share are a superset of the
   common words, at most ``4 / (3 * word_share)`` per language.
2. One more pass counts exactly these, and character classes, per language.
   Only languages with ``lang_share`` of all words get a reference, so the
   driver holds at most ``1 / lang_share`` small histograms.
3. Rows are scored where they lie (no shuffle of texts at any point).

Guards: the character test needs ``min_chars`` code points, the word test
``min_words`` words; shorter documents pass that test. A document whose
language is null or has no reference is compared with every reference and
takes its closest. Without any reference (empty corpus) the tests pass.

Defined results: null text has no words and fails the base rules; empty table,
empty result; repeated rows are scored alike; columns other than id, text and
lang are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import (column_of, chunks, column_bytes, cut_lineage, map_arrow,
                               utf8_buffer)

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Words counted in one block of the heavy-word pass; bounds a task's table.
BLOCK_WORDS = 400_000


@dataclass(frozen=True)
class Params:
    word_share: float = 0.002
    lang_share: float = 0.005
    min_chars: int = 200
    min_words: int = 50
    max_char_distance: float = 0.33
    # the limit of a long text, and what a sample of n words adds: / sqrt(n)
    max_word_distance: float = 0.28
    word_noise: float = 1.35


@dataclass
class Reference:
    chars: np.ndarray                       # counts by CLASSES
    total_words: int
    words: dict[bytes, int] = field(default_factory=dict)  # common word -> exact count


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    t[ord("a"):ord("z") + 1] = CLASSES.index("lower")
    t[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
    t[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    t[list(SPACES)] = CLASSES.index("space")
    t[list(SYMBOLS)] = CLASSES.index("symbol")
    t[0xC0:] = CLASSES.index("wide")        # lead byte: one per code point beyond ASCII
    t[0x80:0xC0] = len(CLASSES)             # continuation byte: not a code point
    return t


CLASS_OF = _class_table()


def char_counts(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    """rows x CLASSES code-point counts."""
    raw, offs = utf8_buffer(column_of(batch, column))
    k = len(CLASSES) + 1
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offs))
    flat = np.bincount(row * k + CLASS_OF[raw], minlength=batch.num_rows * k)
    return flat.reshape(-1, k)[:, :-1]


# -- references ---------------------------------------------------------------

def _heavy(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Counter] = defaultdict(Counter)
        held = 0
        for b in batches:
            for c in chunks(b):
                for lang, t in zip(c.column(0).to_pylist(), column_bytes(c)):
                    words = t.split()
                    blocks[lang].update(words)
                    held += len(words)
                    if held >= BLOCK_WORDS:
                        yield _heavy_rows(blocks, share)
                        blocks, held = defaultdict(Counter), 0
        if held:
            yield _heavy_rows(blocks, share)
    return run


def _heavy_rows(blocks: dict[str, Counter], share: float) -> pa.RecordBatch:
    langs, words, counts = [], [], []
    for lang, c in blocks.items():
        total = sum(c.values())
        langs.append(lang), words.append(None), counts.append(total)
        for w, n in c.items():
            if n >= share / 4 * total:
                langs.append(lang), words.append(w), counts.append(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
        ["lang", "word", "n"])


def _counts_of(candidates: dict[str, set[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = {}
        for b in batches:
            for c in chunks(b):
                per_row = char_counts(c)
                for i, (lang, t) in enumerate(zip(c.column(0).to_pylist(), column_bytes(c))):
                    if lang in candidates:
                        counts[lang].update(filter(candidates[lang].__contains__, t.split()))
                        chars[lang] = chars.get(lang, 0) + per_row[i]
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        # character classes as rows with a null word and the class as a negative key
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows] + [x for x in chars for _ in CLASSES], pa.string()),
             pa.array([r[1] for r in rows] + [None] * (len(chars) * len(CLASSES)), pa.binary()),
             pa.array([-1] * len(rows) + list(range(len(CLASSES))) * len(chars), pa.int32()),
             pa.array([r[2] for r in rows] + [int(n) for x in chars.values() for n in x],
                      pa.int64())], ["lang", "word", "class", "n"])
    return run


def fit_references(docs: DataFrame, params: Params = Params()) -> dict[str, Reference]:
    """Reference histograms per language with enough words, exact counts."""
    source = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string"), "text")
    heavy = cut_lineage(source.mapInArrow(_heavy(params.word_share),
                                          "lang string, word binary, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = heavy.where("word IS NULL").select("lang", F.col("n").alias("total"))
    all_words = totals.agg(F.sum("total")).first()[0]
    if not all_words:
        return {}
    big = totals.where(F.col("total") >= params.lang_share * all_words)
    refs = {r["lang"]: Reference(np.zeros(len(CLASSES), np.int64), r["total"])
            for r in big.collect()}
    found = (heavy.where("word IS NOT NULL").join(F.broadcast(big), "lang")
             .where(F.col("n") >= 0.75 * params.word_share * F.col("total")).collect())
    candidates: dict[str, set[bytes]] = {lang: set() for lang in refs}
    for r in found:
        candidates[r["lang"]].add(bytes(r["word"]))
    exact = (source.mapInArrow(_counts_of(candidates),
                               "lang string, word binary, class int, n long")
             .groupBy("lang", "word", "class").agg(F.sum("n").alias("n")).collect())
    for r in exact:
        ref = refs[r["lang"]]
        if r["word"] is None:
            ref.chars[r["class"]] = r["n"]
        elif r["n"] >= params.word_share * ref.total_words:
            ref.words[bytes(r["word"])] = r["n"]
    return refs


# -- scoring ------------------------------------------------------------------

def js_distance(p_counts: np.ndarray, q_counts: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to one reference."""
    p = p_counts / np.maximum(p_counts.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q_counts / max(q_counts.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0.0, 1.0))


def repeated_words(ids: np.ndarray, n_ids: int) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * n_ids + ids[1:]       # below 2**62: n_ids is at most 2**31
    if n_ids >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * n_ids + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return dup


class Scorer:
    """Scores Arrow batches against fitted references."""

    def __init__(self, refs: dict[str, Reference], params: Params):
        self.params = params
        self.refs = {}
        for lang, r in sorted(refs.items()):
            words = sorted(r.words)
            hist = np.array([*(r.words[w] for w in words),
                             r.total_words - sum(r.words.values())], np.float64)
            self.refs[lang] = ({w: i for i, w in enumerate(words)}, hist, r.chars.astype(float))

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            yield self.score(c)

    def score(self, c: pa.RecordBatch) -> pa.RecordBatch:
        p, n = self.params, c.num_rows
        texts, chars = column_bytes(c), char_counts(c)
        split = [t.split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        ends = np.concatenate([[0], np.cumsum(n_words)])
        index: dict[bytes, int] = {}
        flat = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws),
                           np.int64, int(ends[-1]))
        repeat = np.array([repeated_words(flat[a:b], len(index))
                           for a, b in zip(ends[:-1], ends[1:])], np.int64)
        char_d, word_d = np.ones(n), np.ones(n)
        langs = column_of(c, "lang").to_pylist()
        row_of = np.repeat(np.arange(n), n_words)
        for lang, (common, words_ref, chars_ref) in self.refs.items():
            rows = np.array([i for i, x in enumerate(langs) if x == lang or x not in self.refs],
                            np.int64)
            if not len(rows):
                continue
            k = len(words_ref)
            slot = np.full(max(len(index), 1), k - 1, np.int64)
            for w, i in common.items():
                if w in index:
                    slot[index[w]] = i
            at = np.full(n, -1, np.int64)
            at[rows] = np.arange(len(rows))
            use = at[row_of] >= 0
            hist = np.bincount(at[row_of[use]] * k + slot[flat[use]],
                               minlength=len(rows) * k).reshape(-1, k)
            word_d[rows] = np.minimum(word_d[rows], js_distance(hist, words_ref))
            char_d[rows] = np.minimum(char_d[rows], js_distance(chars[rows], chars_ref))
        if not self.refs:
            char_d[:], word_d[:] = 0.0, 0.0
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        diverges = ((char_d > p.max_char_distance) & (chars.sum(axis=1) >= p.min_chars)) | \
                   ((word_d > p.max_word_distance + p.word_noise / np.sqrt(np.maximum(n_words, 1)))
                    & (n_words >= p.min_words))
        space = CLASSES.index("space")
        return pa.RecordBatch.from_arrays(
            [column_of(c, "doc_id"), pa.array(n_words),
             pa.array(chars.sum(axis=1) - chars[:, space]),
             pa.array(chars[:, CLASSES.index("symbol")]),
             pa.array([dup_lines(t) for t in texts], pa.int64()), pa.array(repeat),
             pa.array(failed), pa.array(~failed & ~diverges), pa.array(char_d), pa.array(word_d)],
            RESULT_NAMES)


RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, char_distance double, "
          "word_distance double")
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def judge(docs: DataFrame, params: Params = Params(),
          refs: dict[str, Reference] | None = None) -> DataFrame:
    """One row per document with the rule counts, distances and verdict."""
    if refs is None:
        refs = fit_references(docs, params)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return map_arrow(rows, Scorer(refs, params), RESULT)


def keep(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents that pass, all their columns. The verdict is computed on
    each row beside its columns, so nothing is joined back."""
    refs = fit_references(docs, params)
    scorer, names = Scorer(refs, params), docs.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            ok = scorer.score(c).column(RESULT_NAMES.index("kept"))
            yield pa.RecordBatch.from_arrays(c.filter(ok).columns, names=names)
    return map_arrow(docs, run, docs.schema)
