import html
import random
import re
from itertools import product

import numpy as np
import pytest

from cohort.llm import html_extract as H
from cohort.llm.dom import parse

SCHEMA = "page_id long, url string, html string, text string"


def page(rng, n):
    word = lambda: "".join(rng.choice("aeioulnrstäé") for _ in range(rng.randrange(2, 9)))
    sent = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    title, paras = sent(5), [sent(rng.choice([3, 30, 200])) for _ in range(rng.randrange(1, 9))]
    menu = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(5))
    body = "".join(f"<p>{html.escape(p)} &amp; &#233;&nbsp;x</p>" for p in paras)
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='
            f'"</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- c --><div class="ad">{sent(8)}'
            f'</div><article><h1>{title}</h1><p><b>{sent(9)}<br>{body}</article><footer>&copy; {sent(6)}'
            f'</footer>{"</body></html>" if n % 2 else ""}')


def brute(h):
    a = re.search(r"<article>(.*?)</article>", h, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())
              for x in re.split(r"</?(?:p|h1)>", a)]
    return "\n\n".join(x for x in blocks if x)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    return [page(rng, i) for i in range(120)]


@pytest.fixture(scope="module")
def model(pages):
    return H.fit(pages[:80])


def test_query_extracts_articles_exactly(spark, pages):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(pages)], SCHEMA)
    for r in H.extract(df.repartition(3)).collect():
        assert r.text == brute(pages[r.page_id]) and r.n_chars == len(r.text)
        assert r.url == f"u{r.page_id}"


def test_other_markup_is_told_apart(model):
    story = ["A title of the story", "The first paragraph of it goes on for a while, and ends.",
             "a point in a list", "Another paragraph, with more words than the first had, follows."]
    h = f"""<html><body><div id="top"><div class="site-header"><a href="/">Site</a></div>
      <ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul></div>
      <div class="cookie-notice">We use cookies to improve your visit.</div>
      <div class="content"><h1>{story[0]}</h1><p>{story[1]}<ul><li>{story[2]}</ul>
      <form><input><button>Subscribe</button></form><p>{story[3]}</div>
      <div id="sidebar"><p>Related stories you may like to read.</p></div>
      <div class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a great
      article, thanks for writing it.</p></div></div>
      <div class="footer">&copy; 2020 Company. All rights reserved.</div></body></html>"""
    assert H.Reader(model, H.Params()).texts([h]) == ["\n\n".join(story)]


def test_held_out_rebuilt_pages(model, pages):
    rng = random.Random(99)
    own = [parse(h) for h in pages[80:]]
    pool = [x for t in own for x in t.text if x]
    reader, right, total = H.Reader(model, H.Params()), 0, 0
    for t in own:
        made = parse(H.rebuilt(t, H.labels_of(t), pool, rng))
        _, prob = reader.marginals([made])
        seg = np.array([not g for g in made.tag])
        right += ((prob >= .5) == H.labels_of(made))[seg].sum()
        total += seg.sum()
    assert right / total > 0.95


def test_messages_match_enumeration():
    rng = np.random.default_rng(3)
    t = parse("<div><p>one<p>two<b>x</b></div><ul><li>a<li>b</ul>tail")
    u = parse("text")
    forest = H.Forest([t, u])
    n = len(forest.parent)
    unary, edge = rng.standard_normal((n, 2)), rng.standard_normal((2, 2, 2))
    kind = forest.segment.astype(int)
    marg, z, scores = np.zeros(n), 0.0, []
    for y in product((0, 1), repeat=n):
        s = sum(unary[i, y[i]] for i in range(n))
        s += sum(edge[kind[i], y[p], y[i]] for i, p in enumerate(forest.parent)
                 if i not in forest.levels[0])
        w = np.exp(s)
        z += w
        marg += w * np.array(y)
    belief = forest.infer(unary, edge)[0]
    assert np.allclose(H.soft(belief)[:, 1], marg / z)
    assert np.isclose(forest.log_z(belief), np.log(z))
    # the gradient is that of log Z minus the score of the observed labels
    y = rng.integers(0, 2, n)
    child = np.setdiff1d(np.arange(n), forest.levels[0])
    g_node, g_edge = H.gradients(forest, unary, edge, y, child, kind)
    for i in range(n):
        d = unary.copy()
        d[i, 1] += 1e-5
        up = forest.log_z(forest.infer(d, edge)[0])
        assert abs((up - np.log(z)) / 1e-5 - y[i] - g_node[i]) < 1e-3
    for at in product((0, 1), repeat=3):
        d = edge.copy()
        d[at] += 1e-5
        seen = sum(kind[i] == at[0] and y[forest.parent[i]] == at[1] and y[i] == at[2]
                   for i in child)
        up = forest.log_z(forest.infer(unary, d)[0])
        assert abs((up - np.log(z)) / 1e-5 - seen - g_edge[at]) < 1e-3


@pytest.mark.parametrize("h", [
    "", " ", "plain words", "<", "<p", "<p class='x", "&am", "</p></div>", "<!--", "<script>x",
    "<div>" * 3000 + "deep", "<p>" * 20_000, "<li>" * 20_000 + "x", "</div>" * 50_000,
    "<a href=\"" * 5_000, "<b>" * 20_000 + "t", "&#x110000; &nbsp;", "<title>t", "<p>\x00</p>"])
def test_broken_markup_never_fails(model, h):
    (text,) = H.Reader(model, H.Params()).texts([h])
    assert isinstance(text, str)


def test_parse_details():
    t = parse("<p>a &lt;b&gt;\n <i>c</i>d<br>e<p>f<table><tr><td>g<td>h</table><pre> i  j </pre>")
    assert [x for x in t.text if x] == ["a <b> cd e", "f", "g", "h", "i j"]
    t = parse("<head><title>no</title><meta x></head>yes<noscript>no</noscript><style>no</style>")
    assert [x for x in t.text if x] == ["yes"]


def test_nulls_repeats_empty(spark, pages, model):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", pages[0], "x"), (3, "u", pages[0], "x"),
            (4, "u", "<article>" + "<p>long words here, and more.</p>" * 20_000 + "</article>", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df, model=model).collect()),
                 key=lambda r: r[0])
    assert got[:2] == [(1, None, "", 0), (2, "u", "", 0)] and got[2] == got[3]
    assert got[4][2].count("\n\n") == 19_999
    empty = df.where("false")
    assert H.extract(empty).collect() == []


LINKED = ['<p>See <a href="x">this link which is the whole of the paragraph text</a></p>',
          '<p><a href="x">A source</a></p>', "<p>Word</p>",
          '<p>A formula <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here</p>']
LINKED_TEXT = ["See this link which is the whole of the paragraph text", "A source", "Word",
               "A formula x=2 here"]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="content">%s</div>'])
@pytest.mark.parametrize("i", range(4))
def test_links_words_and_formulas_of_the_text_stay(model, wrap, i):
    first, last = "A plain sentence goes on for a while, and it ends here.", "The last one of them ends here."
    h = ('<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
         + wrap % f"<h1>The title of it</h1><p>{first}</p>{LINKED[i]}<p>{last}</p>"
         + '<div id="disqus_thread"><p>I agree with the writer of this text.</p></div><hr>'
           "<small>Copyright 2001</small></body></html>")
    text = H.Reader(model, H.Params()).texts([h])[0].split("\n\n")
    assert text == ["The title of it", first, LINKED_TEXT[i], last]
