"""HTML as a sequence of leaf blocks: text, tag path, share of link text.

A block is the text between two boundaries of block-level elements.  Its path lists the open
block-level elements with the words of their ``class``, ``id`` and ``role``.  Broken markup is read
on: a missing end tag is implied by the next sibling or by the end of an outer element, an end tag
without a start is ignored, an open comment or script runs to the end.  Every pattern takes time
proportional to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# content that is never text of a page
HIDDEN = "script style noscript template svg math iframe object canvas title textarea select button".split()
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(["hr"])
# an element that a start tag of the same family ends, and the elements that it cannot leave
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(HIDDEN)})\b{_ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*+)(?P<attrs>{_ATTRS})>"
    r"|<(?:[!?]|/[^a-z])[^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|data-kept)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    path: list[str]  # tags and words of attributes, outermost first, the last tag marked
    link: float  # share of characters in links
    kept: str | None = None  # the mark of a made page


def _words(attrs: str) -> tuple[list[str], str | None]:
    found, kept = [], None
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-kept":
            kept = value
        elif name == "hidden":
            found.append("hidden")
        else:
            found += _WORD.findall(_HUMP.sub(" ", html.unescape(value)).lower())
    return found, kept


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page that hold text, in page order."""
    stack: list[tuple[str, list[str], str | None]] = []
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> Iterator[Block]:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            path = [f"{name}." if i == len(stack) - 1 else name for i, (name, _, _) in enumerate(stack)]
            path += [w for _, words, _ in stack for w in words]
            yield Block(text, path, min(1.0, linked / len(text)), next((k for _, _, k in reversed(stack) if k), None))
        held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if in_link:
                linked += len(text.strip())

    def close(names: set[str], inside: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in inside:
                return

    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name, ends = name.lower(), bool(token["end"])
        if name == "a":
            in_link = not ends
        elif name == "br":
            held.append(" ")
        elif name in BLOCK or "-" in name:
            yield from flush()
            in_link = False
            if ends:
                close({name}, set())
                continue
            if name in SIBLINGS:
                close(*SIBLINGS[name])
            # a paragraph holds no block
            close({"p"}, BLOCK - {"p"})
            if name not in VOID:
                stack.append((name, *_words(token["attrs"])))
    add(page[at:])
    yield from flush()
