"""Personal data: rule spans plus a character BiLSTM-CRF.

The tagger is trained in numpy on labelled spans of a bounded sample
(``sample_docs`` documents that have any, lowest id hash first); the labels are
the checked rule spans, so the network learns the shape and surroundings of
personal data and adds what the rules drop or cut. Every text is tagged
whole, in windows that overlap by ``overlap`` characters: all windows of a
chunk run through the network together, windows that could hold a span are
decoded by Viterbi and scored by their label marginals, and the spans of all
windows of a document are reconciled in text positions: pieces cut by a window
edge are united with what the neighbour saw, and of overlapping claims the
surest stays. An added span holds a digit or an "@", so windows that have neither,
nor any bearing on one that does, are not run (``form_spans``). Rule spans always stay; an added span never overlaps one.

Nothing is shuffled; the driver holds the sample (``sample_docs`` windows) and
about 10 kB of weights.

Defined results: null text is empty, without spans; repeated rows are scored
alike; an empty table trains nothing and gives an empty result; other columns
are ignored (``redact`` passes them through).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm import bilstm_crf as net
from cohort.llm.common import chunks, map_arrow, text_or_empty
from cohort.llm.pii_rules import FINDERS, KINDS, rule_spans

LABELS = 1 + len(KINDS)                     # 0: outside


@dataclass(frozen=True)
class Params:
    hidden: int = 12
    window: int = 512
    overlap: int = 64
    sample_docs: int = 800
    train_window: int = 96
    epochs: int = 24
    min_posterior: float = 0.9
    min_length: int = 7


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(cp, net.OTHER).astype(np.int16)


def tags(text: str) -> np.ndarray:
    """Labels per character from the rule spans."""
    y = np.zeros(len(text), np.int8)
    for a, k, b in rule_spans(text):
        y[a:b] = k + 1
    return y


# -- training -----------------------------------------------------------------

def training_windows(texts: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``train_window`` characters: one about each labelled span at
    a random place, one about digits that carry no label, one at random."""
    rng, n = np.random.default_rng(11), p.train_window
    xs, ys = [], []

    def cut(c, y, at):
        at = int(np.clip(at, 0, max(0, len(c) - n)))
        x, t = np.full(n, ord("\n"), np.int16), np.zeros(n, np.int8)
        part = c[at:at + n]
        x[:len(part)], t[:len(part)] = part, y[at:at + n]
        xs.append(x), ys.append(t)
    for text in texts:
        c, y = codes(text), tags(text)
        edges = np.nonzero(np.diff(y, prepend=0, append=0))[0]
        for a, b in zip(edges[::2], edges[1::2]):
            cut(c, y, a - rng.integers(0, max(1, n - (b - a)) + 1))
        odd = np.nonzero((c >= 48) & (c <= 57) & (y == 0))[0]
        if len(odd):
            cut(c, y, odd[rng.integers(len(odd))] - rng.integers(0, n))
        if len(c):
            cut(c, y, rng.integers(0, len(c)))
    return np.array(xs, np.int64).reshape(-1, n), np.array(ys, np.int64).reshape(-1, n)


def train(docs: DataFrame, p: Params = Params()) -> net.Weights | None:
    """Weights from the sample, or None if no document in it has a rule span."""
    def spanned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = pa.array([any(f(t) for f in FINDERS) for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays(batch.filter(ok).columns, ["rank", "text"])
    candidates = docs.where(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("rank"),
        # a training text is a stretch about its first digit; scoring reads all
        F.expr("substring(text, greatest(1, regexp_instr(text, '[0-9@]') - 200), 2000)")
        .alias("text"))
    spans = map_arrow(candidates, spanned, "rank long, text string")
    # the hash is uniform, so a bound on it bounds what any number of tasks send
    n = spans.count()
    share = min(1.0, 2.0 * p.sample_docs / max(n, 1))
    bound = min(2 ** 63 - 1, int(-2 ** 63 + share * 2 ** 64))
    near = map_arrow(candidates.where(F.col("rank") <= bound), spanned, "rank long, text string")
    sample = sorted(near.limit(4 * p.sample_docs).collect(),
                    key=lambda r: (r["rank"], r["text"]))[:p.sample_docs]
    if not sample:
        return None
    x, y = training_windows([r["text"] for r in sample], p)
    return net.fit(x, y, p.hidden, LABELS, p.epochs)


# -- tagging ------------------------------------------------------------------

def window_starts(n: int, p: Params) -> list[int]:
    stride = p.window - p.overlap
    return [0] if n <= p.window else list(range(0, n - p.overlap, stride))


def window_spans(w: net.Weights, texts: list[np.ndarray], p: Params, at_once: int = 1024,
                 starts: list[list[int]] | None = None) -> list[list[tuple]]:
    """Per text the decoded spans (start, end, kind, posterior, cut): cut if the
    span touches a window edge inside the text. ``starts``: only these windows."""
    where = [(i, s, min(len(c), s + p.window)) for i, c in enumerate(texts) if len(c)
             for s in (window_starts(len(c), p) if starts is None else starts[i])]
    where.sort(key=lambda x: x[1] - x[2])
    out: list[list[tuple]] = [[] for _ in texts]
    for k in range(0, len(where), at_once):
        part = where[k:k + at_once]
        lengths = np.array([b - a for _, a, b in part])
        chars = np.full((len(part), lengths[0]), ord("\n"), np.int16)
        for r, (i, a, b) in enumerate(part):
            chars[r, :b - a] = texts[i][a:b]
        em = net.emissions(w, chars, lengths)
        ranges = net.open_ranges(em, w.trans, lengths)
        if not ranges:
            continue
        trans = w.trans.astype(np.float64)
        ranges.sort(key=lambda x: x[1] - x[2])
        for g in range(0, len(ranges), 256):
            cuts, sizes, place = net.cut_ranges(em, lengths, ranges[g:g + 256])
            path = net.viterbi(cuts, trans, sizes)
            hit = np.nonzero(path.any(axis=1))[0]
            if not len(hit):
                continue
            marg = net.forward_backward(cuts[:, hit], trans, sizes[hit])[0]
            for r, m in zip(hit.tolist(), marg.transpose(1, 0, 2)):
                h, at = place[r]
                i, a, b = part[h]
                y = path[r, :sizes[r]]
                edges = np.nonzero(np.diff(y, prepend=0, append=0))[0].tolist()
                for s, e in zip(edges[:-1], edges[1:]):
                    if y[s]:
                        first, last = a + at + s, a + at + e
                        out[i].append((first, last, int(y[s]) - 1,
                                       float(m[s:e, y[s]].mean()),
                                       bool((first == a and a > 0)
                                            or (last == b and b < len(texts[i])))))
    return out


def form_spans(w: net.Weights, texts: list[np.ndarray], p: Params) -> list[list[tuple]]:
    """``window_spans`` without the windows that have no part in a span of the
    right form: those without a digit or "@", unless beside one that has any, or
    touched by a span found so far (which theirs might overlap or join)."""
    every = [window_starts(len(c), p) if len(c) else [] for c in texts]
    left, now = [], []
    for c, own in zip(texts, every):
        form = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
        s = np.array(own, np.int64)
        on = np.searchsorted(form, s + p.window) > np.searchsorted(form, s)
        own_form = on.copy()
        on[1:] |= own_form[:-1]
        on[:-1] |= own_form[1:]
        now.append(s[on].tolist())
        left.append(s[~on].tolist())
    out: list[list[tuple]] = [[] for _ in texts]
    while any(now):
        for all_, got in zip(out, window_spans(w, texts, p, starts=now)):
            all_.extend(got)
        now = [[s for s in rest if any(a <= s + p.window and b >= s for a, b, *_ in spans)]
               if spans and rest else [] for rest, spans in zip(left, out)]
        left = [[s for s in rest if s not in set(more)] if more else rest for rest, more in zip(left, now)]
    return out


def reconcile(found: list[tuple]) -> list[tuple[int, int, int, float]]:
    """One set of disjoint spans (start, kind, end, posterior) of a document."""
    whole = []
    for s, e, k, q, cut in sorted(found):
        if whole and whole[-1][2] == k and s <= whole[-1][1] and (cut or whole[-1][4]):
            last = whole[-1]                # two views of one span
            joined = cut and last[4] and e > last[1]
            best = last if not last[4] else (s, e, k, q, cut)
            whole[-1] = (last[0], max(e, last[1]), k, max(q, last[3]), False) if joined \
                else best
        else:
            whole.append((s, e, k, q, cut))
    taken: list[tuple[int, int, int, float]] = []
    for s, e, k, q, _ in sorted(whole, key=lambda x: (-x[3], x[0], x[2])):
        if all(e <= a or b <= s for a, _, b, _ in taken):
            taken.append((s, k, e, q))
    return sorted(taken)


def has_form(kind: int, span: str) -> bool:
    """An email has its sign, every other kind a digit."""
    return "@" in span if KINDS[kind] == "email" else any("0" <= ch <= "9" for ch in span)


def added_spans(w: net.Weights | None, texts: list[str], base: list[list[tuple]],
                p: Params) -> list[list[tuple[int, int, int]]]:
    """Per text the tagger's sure spans that overlap no rule span."""
    if w is None:
        return [[] for _ in texts]
    found = form_spans(w, [codes(t) for t in texts], p)
    return [[(s, k, e) for s, k, e, q in reconcile(f)
             if q >= p.min_posterior and e - s >= p.min_length and has_form(k, t[s:e])
             and all(e <= a or b <= s for a, _, b in rules)]
            for t, f, rules in zip(texts, found, base)]


def digest_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
          "base_sha256 string, spans string, n_added long")
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def find(docs: DataFrame, p: Params = Params(), weights: net.Weights | None = None) -> DataFrame:
    """One row per document: rule counts by kind, digest of the rule spans, all
    spans as kind:start:end, and how many the tagger added."""
    w = train(docs, p) if weights is None else weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            texts = c.column(1).to_pylist()
            base = [rule_spans(t) for t in texts]
            more = added_spans(w, texts, base, p)
            counts = np.array([[sum(k == j for _, k, _ in b) for j in range(len(KINDS))]
                               for b in base], np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [c.column(0), *(pa.array(counts[:, j]) for j in range(len(KINDS))),
                 pa.array([hashlib.sha256(digest_form(b).encode()).hexdigest() for b in base]),
                 pa.array([digest_form([*b, *m]) for b, m in zip(base, more)]),
                 pa.array([len(m) for m in more], pa.int64())], RESULT_NAMES)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return map_arrow(rows, run, RESULT)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, overlapping ones as one, becomes its kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, p: Params = Params(), weights: net.Weights | None = None) -> DataFrame:
    """All rows and columns, with the spans in ``text`` masked and ``n_chars``,
    where there is one, counted anew. Texts without spans are left as they are."""
    w = train(docs, p) if weights is None else weights
    names = docs.columns
    at = [n.lower() for n in names].index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch, names[at]):
            texts = c.column(at).to_pylist()
            full = [t or "" for t in texts]
            base = [rule_spans(t) for t in full]
            more = added_spans(w, full, base, p)
            cols = c.columns
            changed = [bool(b or m) for b, m in zip(base, more)]
            clean = [mask(f, [*b, *m]) if x else t
                     for t, f, b, m, x in zip(texts, full, base, more, changed)]
            cols[at] = pa.array(clean, cols[at].type)
            if "n_chars" in names:
                j = names.index("n_chars")
                cols[j] = pa.array([len(t) if x else n for t, n, x in
                                    zip(clean, c.column(j).to_pylist(), changed)], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, names)
    return map_arrow(docs, run, docs.schema)
