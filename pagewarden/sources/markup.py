"""Elements of a page by one pass over its tags, with a stack of what is open.

An element ends at its own end tag, at the end of what encloses it, at a second
start of a kind that cannot hold itself (button, link, select), or with the page.
Every tag is pushed and popped once, and names and barriers know their places on
the stack, so the time is linear in the page, however many tags stay open.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element kinds in capture order, with the tag of each.
ELEMENT_KINDS = (
    ("button", "button"), ("input", "input"), ("textarea", "textarea"),
    ("select", "select"), ("link", "a"),
)
# Tags without content, tags whose content is text, tags that end tags inside them do not reach beyond.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("textarea title".split())
BARRIERS = frozenset("caption html table td template th".split())
NOT_IN_ITSELF = frozenset("a button select".split())
ENDS_SELECT = frozenset("input textarea".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)""")
_ATTRIBUTE = re.compile(r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?""")
_KIND_OF = {tag: kind for kind, tag in ELEMENT_KINDS}

SPANS = "array<struct<type:string,tag:string,start:string,inner:string,labels:array<string>>>"


def _attribute(attributes: str, wanted: str) -> str:
    """Value of the first attribute of this name in a start tag, empty without one."""
    for attribute in _ATTRIBUTE.findall(attributes):
        name, _, value = attribute.partition("=")
        if name.strip().lower() == wanted:
            value = value.strip()
            return unescape(value[1:-1] if value[:1] in ("'", '"') else value)
    return ""


class _Open:
    """The tags that are open, and where each name and the last barrier stand."""

    def __init__(self, html: str):
        self.html = html
        self.stack: list[tuple[str, dict | None]] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def push(self, name: str, entry: dict | None) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append((name, entry))

    def holds(self, name: str) -> bool:
        """Whether an end tag of this name reaches an open tag."""
        places = self.places.get(name)
        return bool(places) and (not self.barriers or places[-1] >= self.barriers[-1] or name in BARRIERS)

    def close(self, depth: int, at: int) -> None:
        """Everything from ``depth`` up ends here."""
        while len(self.stack) > depth:
            name, entry = self.stack.pop()
            self.places[name].pop()
            if self.barriers and self.barriers[-1] == len(self.stack):
                self.barriers.pop()
            if entry is not None:
                entry["inner"] = self.html[entry.pop("at") : at]

    def close_name(self, name: str, at: int) -> None:
        if self.holds(name):
            self.close(self.places[name][-1], at)


def element_spans(html: str | None) -> list[dict]:
    """Elements by kind and position: start tag, inner markup, and inner markup of their labels.

    A label that names an id belongs to the controls of that id, any other to the
    controls inside it.
    """
    html = html or ""
    found: dict[str, list[dict]] = {kind: [] for kind, _ in ELEMENT_KINDS}
    labels: list[dict] = []
    within: list[int] = []
    open_ = _Open(html)
    at = 0
    while (tag := _TAG.search(html, at)) is not None:
        at = tag.end()
        name = tag[2].lower()
        if not tag[4]:
            break  # the page ends inside a tag, which is no tag then
        if tag[1]:
            open_.close_name(name, tag.start())
            within = [n for n in within if "at" in labels[n]]
            continue
        if name in ENDS_SELECT:
            open_.close_name("select", tag.start())
        if name in NOT_IN_ITSELF and open_.holds(name):
            open_.close_name(name, tag.start())
            within = [n for n in within if "at" in labels[n]]
            if name == "select":
                continue
        kind = _KIND_OF.get(name)
        entry = None
        if kind is not None:
            own = [] if name == "a" else [n for n in within if not labels[n]["target"]]
            entry = {"type": kind, "tag": name, "start": tag[0], "labels": own}
            found[kind].append(entry)
        elif name == "label":
            entry = {"target": _attribute(tag[3], "for")}
            within = [*within, len(labels)]
            labels.append(entry)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            if entry is not None:
                entry["inner"] = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
        elif name in VOID:
            if entry is not None:
                entry["inner"] = ""
        else:
            if entry is not None:
                entry["at"] = at
            open_.push(name, entry)
    open_.close(0, len(html))
    elements = [e for kind, _ in ELEMENT_KINDS for e in found[kind]]
    named: dict[str, list[int]] = {}
    for n, label in enumerate(labels):
        named.setdefault(label["target"], []).append(n)
    for e in elements if labels else ():
        if e["tag"] != "a" and (name := _attribute(_TAG.match(e["start"])[3], "id")):
            e["labels"] += named.get(name, [])
        e["labels"] = [labels[n]["inner"] for n in sorted(e["labels"])]
    return elements


def element_spans_of(html: Column) -> Column:
    """``element_spans`` of a column."""
    return F.udf(element_spans, SPANS, useArrow=True)(html)
