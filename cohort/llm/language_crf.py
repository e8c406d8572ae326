"""Language identification by a linear-chain conditional random field.

Every word gets a label. Its emission scores sum hashed features: the byte
n-grams of the marked word (those at the marks are its affixes) and the word
itself (the lexicon); learned transitions tie neighbouring words, so a short
ambiguous word takes the language of its surroundings while a switch between
two clear stretches stays visible. Word marginals come from forward-backward
over the whole text; a document's prediction is the label with the largest sum
of marginals and its score that sum per word.

Training sequences are made from stretches of labelled documents of different
languages put in a row, so that word labels and switches are known. The sample
is bounded per language, and every language of the rows is learned: ``per_lang``
documents of each, by lowest hash, ``stretches`` of at most ``stretch_words``
words of a document; the number of sequences follows that of languages. Scoring reads whole texts where they lie; nothing is shuffled, and
the model is a table of 2**``hash_bits`` rows.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if there was nothing to learn from; repeated rows are scored alike; empty table,
empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import chunks, held_out, held_out_id, map_arrow

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    hash_bits: int = 16
    ngrams: tuple[int, ...] = (2, 3, 4)
    per_lang: int = 300
    stretches: int = 4
    stretch_words: int = 40
    sequences: int = 3000       # at least
    sequences_per_lang: int = 50
    sequence_words: int = 48
    epochs: int = 8
    rate: float = 0.3
    cache_words: int = 400_000
    chunk_bytes: int = 8 << 20
    full_langs: int = 8         # with more languages chunks and cache shrink in proportion


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


# -- features -----------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words, flat, and the word of each."""
    raw = [b"\x01" + w.encode("utf-8", "surrogatepass") + b"\x02" for w in words]
    lens = np.array([len(b) for b in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(flat))     # bytes to the end of the word
    owner = np.repeat(np.arange(len(raw)), lens)
    shift = np.uint64(64 - p.hash_bits)
    feats, of = [], []
    for n in p.ngrams:
        at = np.nonzero(left >= n)[0]
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key * np.uint64(257)) + flat[at + k]
        feats.append((key * _MIX) >> shift), of.append(owner[at])
    whole = np.zeros(len(raw), np.uint64)                   # polynomial of the whole word
    if len(raw):
        power = _MIX ** (left - 1).astype(np.uint64)
        whole = np.add.reduceat(flat * power, ends - lens)
    feats.append((whole * _MIX) >> shift), of.append(np.arange(len(raw)))
    return np.concatenate(feats).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray           # 2**hash_bits, L
    trans: np.ndarray           # L, L from, to


def emissions(model: Model, words: list[str], p: Params) -> np.ndarray:
    feats, of = word_features(words, p)
    by = np.argsort(of, kind="stable")
    got = model.table[feats[by]]
    starts = np.searchsorted(of[by], np.arange(len(words)))
    return np.add.reduceat(got, starts, axis=0) if len(words) else np.zeros((0, len(model.langs)))


# -- forward-backward ---------------------------------------------------------

def marginals(scores: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label marginals of every word of many chains (flat words x L).

    Both recursions x_t = e_t * (x_before @ M) run in one batched step, over
    the chains that are still running, scaled at each step."""
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    e = np.maximum(e, 1e-30)
    a = np.exp(trans - trans.max())
    m = np.stack([a, a.T])
    first, last = starts[order], starts[order] + lens[order] - 1
    x = np.empty((2, *e.shape))
    live = np.searchsorted(-lens[order], -np.arange(int(lens.max(initial=0))), side="left")
    state = np.zeros((2, len(order), e.shape[1]))
    for t, n in enumerate(live.tolist()):
        at, back = first[:n] + t, last[:n] - t
        now = state[:, :n] @ m if t else np.ones((2, n, e.shape[1]))
        now[0] *= e[at]
        now[1] *= e[back]
        now /= now.sum(axis=2, keepdims=True)
        state[:, :n] = now
        x[0, at], x[1, back] = now[0], now[1]
    both = x[0] * x[1] / e
    return both / both.sum(axis=1, keepdims=True)


def pair_marginals(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Training form: B, T, L scores -> word marginals, summed pair marginals
    and the summed log Z."""
    b, t_max, k = scores.shape
    top = scores.max(axis=2)
    e, a = np.exp(scores - top[:, :, None]), np.exp(trans)
    alpha, scale = np.zeros_like(e), np.zeros((b, t_max))
    for t in range(t_max):
        v = e[:, t] * (alpha[:, t - 1] @ a if t else 1.0)
        scale[:, t] = v.sum(axis=1)
        alpha[:, t] = v / scale[:, t, None]
    beta, marg, pairs = np.ones((b, k)), np.zeros_like(e), np.zeros((k, k))
    for t in range(t_max - 1, -1, -1):
        marg[:, t] = alpha[:, t] * beta
        if t:
            right = e[:, t] * beta / scale[:, t, None]
            pairs += (alpha[:, t - 1].T @ right) * a
            beta = right @ a.T
    return marg, pairs, float(np.log(scale).sum() + top.sum())


# -- training -----------------------------------------------------------------

def make_sequences(stretches: dict[str, list[list[str]]], p: Params):
    """Rows of words and labels: stretches of random languages one after another."""
    rng, langs = random.Random(13), sorted(stretches)
    seqs, labels = [], []
    for _ in range(max(p.sequences, p.sequences_per_lang * len(langs))):
        ws: list[str] = []
        ys: list[int] = []
        while len(ws) < p.sequence_words:
            k = rng.randrange(len(langs))
            part = rng.choice(stretches[langs[k]])
            n = rng.randrange(2, 24)
            at = rng.randrange(max(1, len(part) - n + 1))
            ws += part[at:at + n]
            ys += [k] * len(part[at:at + n])
        seqs.append(ws[:p.sequence_words]), labels.append(ys[:p.sequence_words])
    return seqs, np.array(labels)


def fit(stretches: dict[str, list[list[str]]], p: Params = Params()) -> Model | None:
    """Adagrad on the log-likelihood of the word labels."""
    stretches = {k: [s for s in v if s] for k, v in stretches.items()}
    langs = sorted(k for k, v in stretches.items() if v)
    if not langs:
        return None
    seqs, y = make_sequences({k: stretches[k] for k in langs}, p)
    vocab = sorted({w for s in seqs for w in s})
    number = {w: i for i, w in enumerate(vocab)}
    feats, of = word_features(vocab, p)
    by = np.argsort(of, kind="stable")
    feats, of = feats[by], of[by]
    starts = np.searchsorted(of, np.arange(len(vocab)))
    x = np.array([[number[w] for w in s] for s in seqs])
    k, rng = len(langs), np.random.default_rng(5)
    table, trans = np.zeros((1 << p.hash_bits, k)), np.zeros((k, k))
    seen_t, seen_r = np.full_like(table, 1e-3), np.full_like(trans, 1e-3)
    for _ in range(p.epochs):
        perm = rng.permutation(len(x))
        for s in range(0, len(perm), 500):
            rows = perm[s:s + 500]
            word_scores = np.add.reduceat(table[feats], starts, axis=0)
            marg, pairs, _ = pair_marginals(word_scores[x[rows]], trans)
            hot = np.eye(k)[y[rows]]
            g_word = np.zeros((len(vocab), k))
            for j in range(k):
                g_word[:, j] = np.bincount(x[rows].ravel(), (marg - hot)[:, :, j].ravel(),
                                           minlength=len(vocab))
            g_word /= len(rows)
            g = np.stack([np.bincount(feats, g_word[of, j], minlength=1 << p.hash_bits)
                          for j in range(k)], axis=1) + 1e-6 * table
            gold = np.zeros((k, k))
            np.add.at(gold, (y[rows][:, :-1], y[rows][:, 1:]), 1.0)
            g_tr = (pairs - gold) / len(rows)
            seen_t += g * g
            seen_r += g_tr * g_tr
            table -= p.rate * g / np.sqrt(seen_t)
            trans -= p.rate * g_tr / np.sqrt(seen_r)
    return Model(langs, table.astype(np.float32), trans)


def train(docs: DataFrame, p: Params = Params()) -> Model | None:
    """Model from documents with a language that are not held out."""
    source = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL") \
        .where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string"), "doc_id", "text")
    counts = (source.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy("lang").collect())
    if not counts:
        return None
    # a bound on a uniform hash per language keeps what is collected bounded
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    bounds = []
    for r in counts:
        share = min(1.0, 1.5 * p.per_lang / r["n"])
        bounds.append((r["lang"], min(2 ** 63 - 1, int(-2 ** 63 + share * 2 ** 64))))
    limits = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for lang, rk, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ws, rng = words_of(text), random.Random(doc)
            n = p.stretch_words
            starts = [rng.randrange(max(1, len(ws) - n + 1)) for _ in range(p.stretches)]
            out.append((lang, rk, [" ".join(ws[a:a + n]) for a in sorted(set(starts))]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.list_(pa.string()))], ["lang", "rank", "parts"])
    few = (source.join(F.broadcast(limits), "lang").withColumn("rank", rank)
           .where("rank <= bound").select("lang", "rank", "doc_id", "text"))
    rows = map_arrow(few, cut, "lang string, rank long, parts array<string>") \
        .limit(4 * p.per_lang * len(counts)).collect()
    found: dict[str, list[list[str]]] = {}
    taken: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["parts"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= p.per_lang:
            found.setdefault(r["lang"], []).extend(s.split() for s in r["parts"])
    return fit(found, p)


# -- scoring ------------------------------------------------------------------

def _room(model: Model | None, p: Params) -> float:
    """Share of the words held at once that as many languages leave room for."""
    return min(1.0, p.full_langs / len(model.langs)) if model is not None else 1.0


class Labeller:
    """Word marginals of texts; keeps the emissions of at most ``cache_words``
    words (fewer with many languages)."""

    def __init__(self, model: Model, p: Params):
        self.model, self.p = model, p
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.used = 0
        self.cache_words = int(p.cache_words * _room(model, p))

    def look_up(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.number})
        if self.used + len(new) > self.cache_words:
            self.number.clear()
            self.used = 0
            new = list(set(words))
        if self.used + len(new) > len(self.scores):
            grown = np.zeros((max(2 * len(self.scores), self.used + len(new)),
                              len(self.model.langs)), np.float32)
            grown[:self.used] = self.scores[:self.used]
            self.scores = grown
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            self.scores[self.used:self.used + len(part)] = emissions(self.model, part, self.p)
            self.number.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.scores[at].astype(np.float64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words x L marginals, words per text)."""
        split = [words_of(t) for t in texts]
        lens = np.array([len(w) for w in split], np.int64)
        return marginals(self.look_up([w for ws in split for w in ws]), lens,
                         self.model.trans), lens

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        marg, lens = self(texts)
        total = np.zeros((len(lens), len(self.model.langs)))
        some = lens > 0
        if some.any():
            total[some] = np.add.reduceat(marg, (np.cumsum(lens) - lens)[some], axis=0)
        best = total.argmax(axis=1)
        share = total[np.arange(len(lens)), best] / np.maximum(lens, 1)
        return [self.model.langs[b] if s else UNKNOWN for b, s in zip(best, some)], \
            np.clip(share, 0.0, 1.0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Stretches of one language as (first word, end word, language)."""
        marg, _ = self([text])
        y = marg.argmax(axis=1)
        edges = [0, *(np.nonzero(np.diff(y))[0] + 1).tolist(), len(y)]
        return [(a, b, self.model.langs[y[a]]) for a, b in zip(edges, edges[1:]) if b > a]


def identify(docs: DataFrame, p: Params = Params(), model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document."""
    model = train(docs, p) if model is None else model
    labellers: list[Labeller] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if model is not None and not labellers:
            labellers.append(Labeller(model, p))
        for c in chunks(batch, limit=int(p.chunk_bytes * _room(model, p))):
            texts = c.column(1).to_pylist()
            langs, s = labellers[0].predict(texts) if labellers else \
                ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays(
                [c.column(0), pa.array([held_out_id(i) for i in c.column(0).to_pylist()]),
                 pa.array(langs, pa.string()), pa.array(s)],
                ["doc_id", "held_out", "lang_pred", "score"])
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
