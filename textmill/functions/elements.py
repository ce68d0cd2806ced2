"""One scanner of markup for all readers of HTML and XML: tags with their attributes, and a forgiving tree.

A scan goes through a document once, from mark to mark. What is no mark is
text; what closes nothing is ignored; what is never closed ends with its parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

_MARK = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>[^>]*)>|<[^>]+>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


@dataclass(frozen=True)
class Mark:
    """A piece of markup: a tag (``name`` in lower case), raw text, or neither (comment, declaration)."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    more: str = ""
    raw: str | None = None

    @property
    def attributes(self) -> dict[str, str]:
        """By lower-cased name, the first of each; values as written."""
        found: dict[str, str] = {}
        for key, *values in _ATTRIBUTE.findall(self.more):
            found.setdefault(key.lower(), next((v for v in values if v), ""))
        return found


def next_mark(text: str, at: int) -> Mark | None:
    m = _MARK.search(text, at)
    if m is None:
        return None
    if m["name"]:
        return Mark(m.start(), m.end(), m["name"].lower(), m["end"] == "/", m["more"])
    return Mark(m.start(), m.end(), raw=m["raw"])


def marks(text: str) -> Iterator[Mark]:
    at = 0
    while (mark := next_mark(text, at)) is not None:
        yield mark
        at = mark.end


def tags(text: str, name: str) -> Iterator[dict[str, str]]:
    """The attributes of every opening tag of that name."""
    return (m.attributes for m in marks(text) if m.name == name and not m.closing)


@lru_cache(maxsize=64)
def _closer(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def closed(text: str, mark: Mark) -> re.Match | None:
    """The next closing tag of the element that ``mark`` opens, nested ones of its name not counted."""
    return _closer(mark.name).search(text, mark.end)


@dataclass
class Node:
    """An element with its attributes and, in order, the text and the elements inside."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    inside: list[str | Node] = field(default_factory=list)

    def walk(self, but: frozenset[str] = frozenset()) -> Iterator[Node]:
        """All elements below, in document order; those named in ``but`` are left out with all they hold."""
        ahead = [iter(self.inside)]
        while ahead:
            step = next(ahead[-1], None)
            if step is None:
                ahead.pop()
            elif isinstance(step, Node) and step.name not in but:
                yield step
                ahead.append(iter(step.inside))

    def text(self) -> str:
        """All text inside, elements set off by blanks."""
        parts: list[str] = []
        ahead: list = [iter(self.inside)]
        while ahead:
            step = next(ahead[-1], None)
            if step is None:
                ahead.pop()
                parts.append(" ")
            elif isinstance(step, Node):
                parts.append(" ")
                ahead.append(iter(step.inside))
            else:
                parts.append(step)
        return "".join(parts)


def tree(text: str) -> Node:
    """The document as elements below a nameless root."""
    root = Node("")
    path, at = [root], 0
    for mark in marks(text):
        if mark.start > at:
            path[-1].inside.append(text[at : mark.start])
        at = mark.end
        if mark.raw is not None:
            path[-1].inside.append(mark.raw)
        elif mark.closing:
            depth = next((d for d in range(len(path) - 1, 0, -1) if path[d].name == mark.name), None)
            if depth is not None:
                del path[depth:]
        elif mark.name:
            node = Node(mark.name, mark.attributes)
            path[-1].inside.append(node)
            if not mark.more.endswith("/"):
                path.append(node)
    if at < len(text):
        path[-1].inside.append(text[at:])
    return root
