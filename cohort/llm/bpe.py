"""BPE encoding and decoding by batched numpy merge rounds.

The words of many texts lie as symbols in one flat array. A round looks up the
rank of each adjacent pair by binary search over the sorted pair keys of the
vocabulary, takes each word's lowest-rank leftmost pair and merges all words'
pairs at once; afterwards only the two pairs beside a merge are looked up
again. One merge per word and round is what makes the result the sequential
one: a merge may give rise to a pair of lower rank than its twin further right.
Words of more than ``long_word`` symbols would need as many rounds, so those
few are merged one by one over a heap of (rank, position), with the same result.

Splitting into words follows the vocabulary file: NFC, lower case, and its
pattern; texts beyond Latin script go through the library's own normaliser and
splitter, so that both agree on every character. Strings of the file's special
tokens stand for themselves.

Rows are handled where they lie, no shuffle. A worker keeps the results of at
most ``cache_words`` words and starts over when they are full.

Defined results: null or word-free text has no tokens and decodes to the empty
text; repeated rows are encoded alike; empty table, empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import chunks, map_arrow, text_or_empty

NONE = np.iinfo(np.int32).max               # no such pair
#: First code point that the fast splitter leaves to the library.
BEYOND_LATIN = re.compile("[^\x00-ɏ]")


@dataclass(frozen=True)
class Params:
    vocabulary: str = "word_bpe_49k"
    long_word: int = 64
    cache_words: int = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the file: printable
    Latin-1 as it is, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    spare = iter(range(256))
    return [out.get(b) or chr(256 + next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, p: Params):
        with open(public_tokenizers.path(f"{p.vocabulary}.json"), encoding="utf-8") as f:
            self.spec = json.load(f)
        self.p = p
        model = self.spec["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") \
            if special else None
        self.tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in {**vocab, **special}.items():
            self.tokens[i] = t
        self.suffix = model["end_of_word_suffix"] or ""
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        self.base = len(self.tokens)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        by = np.argsort(key, kind="stable")
        self.keys, self.key_rank = key[by], by.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        split = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(split).findall
        self.library = None
        self.ids_text: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    # -- words ----------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text):
            if self.library is None:
                from tokenizers import Tokenizer
                lib = Tokenizer.from_file(public_tokenizers.path(f"{self.p.vocabulary}.json"))
                self.library = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
                back = {c: b for b, c in enumerate(byte_symbols())}
                self.raw = lambda w: bytes(back[c] for c in w).decode("utf-8")
            normal, pre = self.library
            return [self.raw(w) for w, _ in pre(normal(text))]
        return self.words_of(unicodedata.normalize("NFC", text).lower())

    # -- merges ---------------------------------------------------------------

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        lens = np.array([len(w) for w in words], np.int64)
        sym = self.inner[raw]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.final[raw[ends]]
        return sym, lens

    def merge_rounds(self, sym: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Token ids per word (every word has a symbol)."""
        out: list[np.ndarray] = [sym[:0]] * len(lens)
        word = np.arange(len(lens))
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(word):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():                   # finished words leave the arrays
                for w, a, n in zip(word[done].tolist(), starts[done].tolist(),
                                   lens[done].tolist()):
                    out[w] = sym[a:a + n]
                stay = np.repeat(~done, lens)
                sym, rank = sym[stay], rank[stay]
                word, lens, low = word[~done], lens[~done], low[~done]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), lens)
            hits = np.nonzero(rank == low[owner])[0]
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]      # leftmost per word
            sym[hits] = self.merged[low]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym, rank = sym[keep], rank[keep]
            lens = lens - 1
            ends = np.cumsum(lens) - 1
            at = hits - np.arange(len(hits))                        # where they are now
            rank[at] = NONE
            inside = at[at < ends]
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            after = at[at > ends - lens + 1] - 1
            rank[after] = self.ranks(sym[after], sym[after + 1])
        return out

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One word by a heap of (rank, position)."""
        s, n = sym.tolist(), len(sym)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        start = self.ranks(sym[:-1], sym[1:]).tolist()
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(start) if r != NONE]
        heapq.heapify(heap)
        rank_of = {}

        def push(i):
            j = nxt[i]
            pair = s[i], s[j]
            if pair not in rank_of:
                rank_of[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if rank_of[pair] != NONE:
                heapq.heappush(heap, (rank_of[pair], i, *pair))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue                    # one side has been merged since
            s[i], s[j] = int(self.merged[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                push(i)
            if prv[i] >= 0:
                push(prv[i])
        return np.array([x for x in s if x >= 0], np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        short = [i for i, b in enumerate(raw) if len(b) <= self.p.long_word]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        if short:
            for i, ids in zip(short, self.merge_rounds(*self.symbols([raw[i] for i in short]))):
                out[i] = ids
        for i, b in enumerate(raw):
            if len(b) > self.p.long_word:
                out[i] = self.merge_long(self.symbols([b])[0])
        return out

    # -- texts ----------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not in the cache yet."""
        new = [w for w in words if w not in self.ids_text]
        if not new:
            return
        if len(self.ids_text) + len(new) > self.p.cache_words:
            self.ids_text.clear(), self.decoded.clear()
            new = list(words)
        for w, ids in zip(new, self.encode_words(new)):
            ids = ids.tolist()
            self.ids_text[w] = " ".join(map(str, ids))
            self.decoded[w] = self.decode(ids)

    def segments(self, text: str) -> list[tuple[list[str], int | None]]:
        """Words of each stretch and the special token after it."""
        if self.split_special is None or not self.split_special.search(text):
            return [(self.words(text), None)]
        parts = self.split_special.split(text)
        after = [self.special[t] for t in parts[1::2]] + [None]
        return [(self.words(t), s) for t, s in zip(parts[::2], after)]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text its ids as decimal text and its decoding."""
        split = [self.segments(t) for t in texts]
        self.learn({w for segs in split for words, _ in segs for w in words})
        out = []
        for segs in split:
            ids: list[str] = []
            text: list[str] = []
            for words, special in segs:
                ids += map(self.ids_text.__getitem__, words)
                text += map(self.decoded.__getitem__, words)
                if special is not None:
                    ids.append(str(special)), text.append(self.tokens[special])
            out.append((" ".join(ids), " ".join(text)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_texts([text])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[Params, Bpe] = {}


def loaded(p: Params) -> Bpe:
    if p not in _LOADED:
        _LOADED[p] = Bpe(p)
    return _LOADED[p]


def encode_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id and its token ids."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = loaded(p)
        for c in chunks(batch):
            got = bpe.encode_texts(c.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [c.column(0), pa.array([[int(x) for x in i.split()] for i, _ in got],
                                       pa.list_(pa.int32()))], ["doc_id", "ids"])
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id and the text that its ids decode to."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = loaded(p)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()],
                                       pa.string())], ["doc_id", "text"])
    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens and the digests of its ids and of their decoding."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = loaded(p)
        for c in chunks(batch):
            got = bpe.encode_texts(c.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [c.column(0),
                 pa.array([i.count(" ") + 1 if i else 0 for i, _ in got], pa.int64()),
                 pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in got], pa.string()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string")
