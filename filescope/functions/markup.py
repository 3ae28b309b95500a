"""Reading tags of XML and HTML that may be broken, or hostile: every function is linear in its text."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = re.compile(r"/?([^\s/>]*)")


def pieces(text: str) -> Iterator[tuple[str, str, int]]:
    """(text before, tag, where the tag starts) of each tag, from < to the next > with something between; then the rest."""
    at = start = 0
    while (start := text.find("<", start)) >= 0:
        if text[start + 1 : start + 2] == ">":
            start += 1
            continue
        end = text.find(">", start)
        if end < 0:
            break
        yield text[at:start], text[start : end + 1], start
        at = start = end + 1
    yield text[at:], "", len(text)


def name(tag: str) -> str:
    """The element's name; with / before it for an end tag."""
    m = _NAME.match(tag, 1)
    return m[0] if m and tag else ""


def without_tags(text: str) -> str:
    """A blank for each tag."""
    return "".join(before + " " if tag else before for before, tag, _ in pieces(text))


def without_element(text: str, element: str) -> str:
    """A blank for each start tag of `element` with all up to its end tag."""
    start, end = (re.compile(p + element + q, re.I | re.A) for p, q in (("<", ""), ("</", ">")))
    out, at = [], 0
    while (a := start.search(text, at)) and (b := end.search(text, a.end())):
        out += [text[at : a.start()], " "]
        at = b.end()
    return "".join([*out, text[at:]])


def texts_of(text: str, wanted: dict[str, int]) -> dict[str, str]:
    """Of the elements named, each with its longest length, the first that holds nothing but text of such a length."""
    found: dict[str, str] = {}
    opened = ""
    for before, tag, _ in pieces(text):
        own = name(tag)
        if opened and own == "/" + opened and opened not in found and 0 < len(before) <= wanted[opened] and "<" not in before:
            found[opened] = before
        opened = own if own in wanted else ""
    return found
