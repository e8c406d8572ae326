"""Page markup to a tree of block elements and text segments, in one pass.

Inline elements belong to the text of their block. A segment is the text
between two block boundaries. Markup is read as found: unclosed, unmatched and
cut-off tags never fail, and the pass is linear in the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML elements that start a block, that have no end tag, and
# whose inside is not page text.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details
dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header
hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track wbr""".split())
SKIPPED = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "head",
           "annotation", "annotation-xml")
#: Of these, the ones that an absent end tag does not carry to the end of the page.
OPEN = ("noscript", "head", "svg", "annotation", "annotation-xml")
BREAKS = frozenset("br hr wbr img input".split())
#: Elements that end an open paragraph of their own kind.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"),
            "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "p": ()}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*+>?", re.I) for name in SKIPPED}
#: A head without an end tag ends where the body begins.
_END["head"] = re.compile(r"</head(?=[\s/>]|\Z)[^>]*+>?|(?=<body[\s/>])", re.I)


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page. ``tag`` is '' for a segment."""
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    link: list[int] = field(default_factory=lambda: [0])    # characters inside links


def parse(page: str) -> Tree:
    t = Tree()
    parent, depth, tags, attrs, texts, links = (t.parent, t.depth, t.tag, t.attrs, t.text, t.link)
    stack, open_count = [0], {}
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush():
        nonlocal linked, in_link
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                parent.append(stack[-1]), depth.append(depth[stack[-1]] + 1)
                tags.append(""), attrs.append(""), texts.append(text), links.append(linked)
            parts.clear()
        linked, in_link = 0, False

    def pop():
        open_count[tags[stack.pop()]] -= 1
    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        stop = m.start() if m else n
        if stop > pos:
            parts.append(page[pos:stop])
            if in_link:
                linked += stop - pos
        if not m:
            break
        pos = m.end()
        name = m.group(2)
        if name is not None:
            name = name.lower()
            if name in _END:
                e = _END[name].search(page, pos)
                if e:
                    pos = e.end()
                elif name not in OPEN:
                    pos = n
                parts.append(" ")
            elif name in BLOCKS:
                flush()
                while tags[stack[-1]] == "p":
                    pop()
                ends = SIBLINGS.get(name, ())
                while tags[stack[-1]] in ends:
                    pop()
                if name not in VOID:
                    at = len(tags)
                    parent.append(stack[-1]), depth.append(depth[stack[-1]] + 1)
                    tags.append(name), attrs.append(m.group(3)), texts.append(""), links.append(0)
                    stack.append(at)
                    open_count[name] = open_count.get(name, 0) + 1
            elif name == "a":
                in_link = True
            elif name in BREAKS:
                parts.append(" ")
        else:
            name = m.group(1)
            if name is None:
                continue
            name = name.lower()
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                flush()
                if open_count.get(name):
                    while tags[stack[-1]] != name:
                        pop()
                    pop()
    flush()
    return t
