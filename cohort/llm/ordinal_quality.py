"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s), one score s with shared weights over
hashed text features and ordered thresholds. It yields a document's expected
grade and, for selection, the probability of reaching a grade.

Features are hashed to 2**``hash_bits`` weights: each word gives itself, its
last three characters and its shape, averaged over the words of the text; the
text as a whole gives the bins of its length, word length, share of distinct
words, of words that repeat the one before, and of repeated lines. As the score
is an average over words, a worker adds up cached word weights.

Grades of the labels table (``grade_of``): 0 low quality, 1 good but toxic, 2
good. Only rows that are not held out are learned from, at most ``per_grade`` of
each grade, lowest id hash first. Scoring reads whole texts where they lie;
nothing is shuffled.

Defined results: a null text is the empty text, which has only its bins; with
ratings of fewer than two grades the score is 0 and the grade the one known (0
without any); repeated rows are scored alike; empty table, empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import chunks, column_bytes, held_out, held_out_id, map_arrow

_SHAPE = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 0x80 else
               ord("9") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


@dataclass(frozen=True)
class Params:
    hash_bits: int = 18
    per_grade: int = 2000
    select_grade: int = 1       # kept if P(grade >= this) reaches select_prob
    select_prob: float = 0.5
    epochs: int = 25
    batch: int = 128
    rate: float = 0.1
    ridge: float = 1e-6
    cache_words: int = 400_000


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grade of a row of labels; null if quality is not rated."""
    return F.when(quality.isNull(), None).when(quality == 0, 0).when(
        F.coalesce(toxic, F.lit(0)) != 0, 1).otherwise(2)


# -- features -----------------------------------------------------------------

def word_features(word: bytes, bits: int) -> tuple[int, int, int]:
    mask = (1 << bits) - 1
    shape = _RUNS.sub(rb"\1", word[:64].translate(_SHAPE))
    return (zlib.crc32(b"w" + word.lower()) & mask, zlib.crc32(b"e" + word[-3:]) & mask,
            zlib.crc32(b"s" + shape) & mask)


def text_bins(text: bytes, words: list[bytes], distinct: int, bits: int) -> list[int]:
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    bins = (f"n{n.bit_length()}", f"l{min(20, sum(map(len, words)) // max(1, n))}",
            f"d{10 * distinct // max(1, n)}", f"r{10 * same // max(1, n)}",
            f"u{10 * (len(lines) - len(set(lines))) // max(1, len(lines))}",
            f"v{min(9, (100 * same // max(1, n)).bit_length())}")
    return [zlib.crc32(b.encode()) & ((1 << bits) - 1) for b in bins]


def sparse(text: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text (training form)."""
    words = text.split()
    counts = Counter(words)
    x: dict[int, float] = {}
    for w, c in counts.items():
        for f in word_features(w, p.hash_bits):
            x[f] = x.get(f, 0.0) + c / len(words)
    for f in text_bins(text, words, len(counts), p.hash_bits):
        x[f] = x.get(f, 0.0) + 1.0
    return np.fromiter(x, np.int64, len(x)), np.fromiter(x.values(), float, len(x))


# -- model --------------------------------------------------------------------

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    grades: list[int]           # rising
    weights: np.ndarray
    cuts: np.ndarray            # rising thresholds, one fewer than grades

    def at_least(self, s: np.ndarray) -> np.ndarray:
        """rows x grades: P(grade >= g)."""
        return np.column_stack([np.ones(len(s)), _sigmoid(s[:, None] - self.cuts[None])])


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first is free, each gap is a softplus."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw[1:]))])


def loss_and_grad(s: np.ndarray, y: np.ndarray, raw: np.ndarray):
    """Mean negative log-likelihood and its gradient in s and raw."""
    cuts = cut_points(raw)
    wide = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = _sigmoid(wide[y + 1] - s), _sigmoid(wide[y] - s)
    hi[y == len(cuts)], lo[y == 0] = 1.0, 0.0
    prob = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
    g_s = (d_hi - d_lo) / len(s)
    g_cut = np.bincount(y + 1, -d_hi, minlength=len(wide)) + np.bincount(y, d_lo, minlength=len(wide))
    g_cut = g_cut[1:-1] / len(s)
    g_raw = np.empty_like(raw)
    g_raw[0] = g_cut.sum()
    for j in range(1, len(raw)):
        g_raw[j] = g_cut[j:].sum() * _sigmoid(raw[j])
    return float(-np.log(prob).mean()), g_s, g_raw


def fit(texts: list[bytes], ratings: list[int], p: Params = Params()) -> Model:
    grades = sorted(set(ratings))
    size = 1 << p.hash_bits
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(size, np.float32), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    rows = [sparse(t, p) for t in texts]
    w, raw = np.zeros(size), np.append(0.0, np.zeros(len(grades) - 2))
    seen_w, seen_r = np.full(size, 1e-8), np.full(len(raw), 1e-8)
    rng = np.random.default_rng(23)
    for _ in range(p.epochs):
        perm = rng.permutation(len(rows))
        for i in range(0, len(perm), p.batch):
            part = perm[i:i + p.batch]
            feat = np.concatenate([rows[r][0] for r in part])
            val = np.concatenate([rows[r][1] for r in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[r][0]) for r in part])
            s = np.bincount(doc, w[feat] * val, minlength=len(part))
            _, g_s, g_raw = loss_and_grad(s, y[part], raw)
            touched, inv = np.unique(feat, return_inverse=True)
            g = np.bincount(inv, g_s[doc] * val) + p.ridge * w[touched]
            seen_w[touched] += g * g
            w[touched] -= p.rate * g / np.sqrt(seen_w[touched])
            seen_r += g_raw * g_raw
            raw -= p.rate * g_raw / np.sqrt(seen_r)
    return Model(grades, w.astype(np.float32), cut_points(raw))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    marks = labels.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(
        "doc_id", grade_of(F.col("quality"), F.col("toxic")).cast("int").alias("grade"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("rank")).where("grade IS NOT NULL")
    parts = [marks.where(F.col("grade") == g).orderBy("rank", "doc_id").limit(p.per_grade)
             for g in (0, 1, 2)]
    # at most 3 * per_grade ids, so the broadcast and the collect are bounded
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .join(F.broadcast(chosen), "doc_id").orderBy("rank", "doc_id", "text")
            .limit(3 * p.per_grade).select("text", "grade").collect())
    return fit([bytes(r["text"] or b"") for r in rows], [r["grade"] for r in rows], p)


# -- scoring ------------------------------------------------------------------

class Scorer:
    def __init__(self, model: Model, p: Params):
        self.model, self.p = model, p
        self.known: dict[bytes, float] = {}

    def word_weights(self, new: list[bytes]) -> list[float]:
        f = np.array([word_features(w, self.p.hash_bits) for w in new], np.int64).reshape(-1, 3)
        return self.model.weights[f].sum(axis=1, dtype=float).tolist()

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        kinds = [set(ws) for ws in split]
        new = list({w for k in kinds for w in k if w not in self.known})
        if len(self.known) + len(new) > self.p.cache_words:
            self.known.clear()
            new = list(set().union(*kinds))
        self.known.update(zip(new, self.word_weights(new)))
        get, out = self.known.__getitem__, np.zeros(len(texts))
        for i, (t, ws, k) in enumerate(zip(texts, split, kinds)):
            bins = text_bins(t, ws, len(k), self.p.hash_bits)
            out[i] = sum(map(get, ws)) / max(1, len(ws)) + float(self.model.weights[bins].sum())
        return out


RESULT = ("doc_id long, held_out boolean, score double, expected_grade double, "
          "tail_prob double, predicted_grade int, kept boolean")
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, latent score, expected grade, P(grade >= select_grade),
    most probable grade, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**hash_bits weights
    scorers: list[Scorer] = []
    grades = np.array(model.grades, float)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not scorers:
            scorers.append(Scorer(sent.value, p))
        for c in chunks(batch):
            s = scorers[0](column_bytes(c))
            at_least = model_tail(s)
            each = at_least - np.column_stack([at_least[:, 1:], np.zeros(len(s))])
            reach = int(np.searchsorted(grades, p.select_grade))
            tail = at_least[:, reach] if reach < len(grades) else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays(
                [c.column(0), pa.array([held_out_id(i) for i in c.column(0).to_pylist()]),
                 pa.array(s), pa.array(each @ grades), pa.array(tail),
                 pa.array(grades[each.argmax(axis=1)].astype(np.int32)),
                 pa.array(tail >= p.select_prob)], RESULT_NAMES)

    def model_tail(s: np.ndarray) -> np.ndarray:
        return sent.value.at_least(s)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(rows, run, RESULT)


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    return score(docs, train(docs, labels, p), p)
