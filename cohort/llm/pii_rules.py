"""Rule spans of personal data: email, ip, card, phone.

Per kind the leftmost non-overlapping matches are taken; a match that fails
its check (part range, digit count, checksum) is dropped and not retried. Each
finder is linear in the text, whatever the text.
"""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The text is walked from one '@' to the next: the local part is the run
    before it, no further back than the previous match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # a later '@' cannot reach back over this one: it is not a local character
        floor = m.end() if m else at + 1
        if m:
            out.append((start, m.end()))
        at = text.find("@", max(floor, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A run of dotted numbers is read four by four; a rest has no match."""
    out = []
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            d = _only_digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]


FINDERS = (emails, ips, cards, phones)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))
