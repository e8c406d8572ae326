import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohort.llm import bilstm_crf as net
from cohort.llm import pii
from cohort.llm.pii_rules import FINDERS, KINDS, rule_spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id long, text string, spans string, n_chars long"


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10))
               for i, x in enumerate(reversed(digits(s)))) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 12 <= len(digits(m.group())) <= 19 and luhn(m.group())]
    out += [("phone", *m.span()) for m in PHONE.finditer(text)
            if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()é%_\n", max_size=60))
def test_rules_equal_the_patterns(text):
    assert [(KINDS[k], a, b) for a, k, b in rule_spans(text)] == brute(text)


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.001.1.1", "4111 1111-1111 1111",
    "+1 (269) 555-1234.", "++12345678901", "a.b@c.d.e@f.g", "9" * 60, "1.1.1." + "9" * 4000])
def test_rules_on_edges(text):
    assert [(KINDS[k], a, b) for a, k, b in rule_spans(text)] == brute(text)


def test_rules_are_linear_on_long_runs():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000,
                 "1 " * 200_000):
        for find in FINDERS:
            find(text)


def brute_crf(em, trans):
    from itertools import product
    t, k = em.shape
    paths = list(product(range(k), repeat=t))
    scores = np.array([sum(em[i, y] for i, y in enumerate(p)) +
                       sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
    z = np.log(np.exp(scores).sum())
    marg = np.zeros((t, k))
    for p, s in zip(paths, scores):
        for i, y in enumerate(p):
            marg[i, y] += np.exp(s - z)
    return marg, z, paths[int(scores.argmax())]


def test_crf_matches_enumeration():
    r = np.random.default_rng(0)
    em, trans = r.standard_normal((5, 3, 4)), r.standard_normal((4, 4))
    lengths = np.array([5, 3, 1])
    marg, _, log_z = net.forward_backward(em, trans, lengths)
    path = net.viterbi(em, trans, lengths)
    for b, n in enumerate(lengths):
        m, z, best = brute_crf(em[:n, b], trans)
        assert np.allclose(marg[:n, b], m) and np.isclose(log_z[b], z)
        assert tuple(path[b, :n]) == best


def test_gradient_matches_differences():
    w = net.init(3, 4, 1)
    for name in net.PARTS:
        setattr(w, name, getattr(w, name).astype(np.float64))
    r = np.random.default_rng(0)
    w.trans = r.standard_normal((4, 4))
    x, y = r.integers(0, 129, (5, 9)), r.integers(0, 4, (5, 9))
    _, g = net.loss_and_grad(w, x, y)
    for name in net.PARTS:
        p, gp = getattr(w, name), getattr(g, name)
        for i in [tuple(r.integers(0, s) for s in p.shape) for _ in range(4)] + \
                ([(0, x[2, 3], 5), (1, x[1, 1], 2)] if name == "x" else []):
            old = p[i]
            p[i] = old + 1e-4
            up = net.loss_and_grad(w, x, y)[0]
            p[i] = old - 1e-4
            down = net.loss_and_grad(w, x, y)[0]
            p[i] = old
            assert abs((up - down) / 2e-4 - gp[i]) < 1e-3


def test_batched_emissions_and_open_ranges_are_exact():
    w = net.init(5, 5, 3)
    r = np.random.default_rng(2)
    w.trans = r.standard_normal((5, 5)).astype(np.float32)
    w.bias[0] = 1.0
    lengths = np.array([60, 41, 41, 7, 1])
    chars = r.integers(0, 129, (5, 60))
    em = net.emissions(w, chars, lengths)
    for b, n in enumerate(lengths):          # alone as in the batch
        one = net.emissions(w, chars[b:b + 1, :n], np.array([n]))
        assert np.allclose(one[:, 0], em[:n, b], atol=1e-5)
    want = net.viterbi(em, w.trans, lengths)
    got = np.zeros_like(want)
    ranges = net.open_ranges(em, w.trans, lengths)
    cuts, sizes, place = net.cut_ranges(em, lengths, ranges)
    path = net.viterbi(cuts, w.trans, sizes)
    for p, n, (b, a) in zip(path, sizes, place):
        got[b, a:a + n] = np.maximum(got[b, a:a + n], p[:n])
    for b, n in enumerate(lengths):
        assert (want[b, :n] == got[b, :n]).all()


def sentence(rng):
    return " ".join(rng.choice(["the", "house", "stands", "on", "a", "hill,", "und", "Öl.",
                                "12", "1999", "3.5"]) for _ in range(rng.randrange(5, 40)))


def planted(rng):
    card = [rng.randrange(10) for _ in range(15)]
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(card)))
    return rng.choice([
        f"u{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        ".".join(str(rng.randrange(256)) for _ in range(4)),
        "".join(map(str, card)) + str(-total % 10),
        f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    rows = [(i, f"{sentence(rng)} {planted(rng)} {sentence(rng)}", "", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    p = pii.Params()
    return pii.train(df, p), p


def test_tagger_finds_planted_data_and_leaves_text_alone(fitted):
    w, p = fitted
    rng = random.Random(9)
    texts, want = [], []
    for _ in range(200):
        a, x, b = sentence(rng), planted(rng), sentence(rng)
        texts.append(f"{a} {x} {b}")
        want.append((len(a) + 1, len(a) + 1 + len(x)))
    found = pii.added_spans(w, texts, [[] for _ in texts], p)
    hits = sum(any(s < b and a < e for s, _, e in f) for f, (a, b) in zip(found, want))
    assert hits >= 180
    clean = [sentence(rng) for _ in range(200)]
    assert sum(map(len, pii.added_spans(w, clean, [[] for _ in clean], p))) <= 4


def test_long_text_is_tagged_whole(fitted):
    w, p = fitted
    rng = random.Random(1)
    filler = " ".join(sentence(rng) for _ in range(4000))
    x = "u7@mail3.example.com"
    at = [0, 448, 500, 512, len(filler) // 2, len(filler)]
    for a in at:
        text = f"{filler[:a]} {x} {filler[a:]}"
        (found,) = pii.added_spans(w, [text], [[]], p)
        assert any(s < a + 1 + len(x) and a + 1 < e for s, _, e in found)
        assert sum(e - s for s, _, e in found) < 200


def test_reconcile_unites_cut_views_and_prefers_the_sure():
    assert pii.reconcile([(10, 30, 0, .9, True), (25, 40, 0, .95, True)]) == [(10, 0, 40, .95)]
    assert pii.reconcile([(10, 30, 0, .9, True), (12, 34, 0, .95, False)]) == [(12, 0, 34, .95)]
    assert pii.reconcile([(5, 9, 1, .9, False), (7, 12, 2, .99, False)]) == [(7, 2, 12, .99)]


def test_query_columns_nulls_repeats_empty(spark, fitted):
    w, p = fitted
    rng = random.Random(3)
    texts = [None, "", " ", "mail u1@mail2.example.com now", "10.2.3.4", "x, " * 100_000,
             "ä 4111 1111 1111 1111 é", "ä 4111 1111 1111 1111 é"] + \
            [f"{sentence(rng)} {planted(rng)}" for _ in range(20)]
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)], SCHEMA)
    for r in pii.find(df, p, w).collect():
        base = brute(texts[r.doc_id])
        form = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(form.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == x for k, *_ in base) for x in KINDS)
        spans = [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert len(spans) == len(base) + r.n_added
    clean = {r.doc_id: r for r in pii.redact(df, p, w).collect()}
    assert clean[0].text is None and clean[0].n_chars == 3
    assert clean[3].text == "mail [EMAIL] now" and clean[3].n_chars == 16
    assert clean[4].text == "[IP]" and clean[6].text == "ä [CARD] é"
    assert clean[5].text == texts[5]
    empty = df.where("false")
    assert pii.train(empty, p) is None
    assert pii.find(empty, p).collect() == [] and pii.redact(empty, p).collect() == []


def test_without_labelled_spans_only_rules(spark):
    df = spark.createDataFrame([(1, "plain words", "", 0)], SCHEMA)
    assert [r.spans for r in pii.find(df).collect()] == [""]


def test_mask_joins_overlaps():
    assert pii.mask("abcdefgh", [(1, 0, 4), (3, 1, 6)]) == "a[EMAIL]gh"


def test_windows_without_a_form_change_nothing(monkeypatch):
    """Random weights give many spans in every window; the spans that stay are
    those of all windows, though few windows are run."""
    p = pii.Params(window=32, overlap=12, min_posterior=0.0, min_length=1)
    rng = np.random.default_rng(5)
    chars = list("abcdefgh ., ") * 8 + list("7@")
    texts = ["".join(rng.choice(chars, n)) for n in rng.integers(0, 600, 60)] + ["x" * 400]
    body, ran = pii.window_spans, []
    monkeypatch.setattr(pii, "window_spans", lambda w, t, p, at_once=1024, starts=None: (
        ran.append(sum(map(len, starts))), body(w, t, p, at_once, starts))[1])
    kept = some = 0
    for seed in range(6):
        w = pii.net.init(6, pii.LABELS, seed)
        w.bias[0] += 0.3 * seed
        got = pii.added_spans(w, texts, [[] for _ in texts], p)
        whole = [[(s, k, e) for s, k, e, q in pii.reconcile(f) if pii.has_form(k, t[s:e])]
                 for t, f in zip(texts, body(w, [pii.codes(t) for t in texts], p))]
        assert got == whole
        kept, some = kept + sum(map(len, got)), some + sum(map(len, whole))
    assert kept == some > 0
    assert sum(ran) < 6 * sum(len(pii.window_starts(len(t), p)) for t in texts if t)
