"""A small element tree on the standard parser, with the searches that posting extraction needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS_ITEM = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def strings(self) -> Iterator[str]:
        """Text below, without that of scripts and styles inside, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in _SILENT:
                stack.extend(reversed(x.children))

    def text(self, separator: str = "") -> str:
        """Trimmed pieces of text, joined."""
        return separator.join(s for s in map(str.strip, self.strings()) if s)

    def matches(self, tags=None, **attributes) -> bool:
        """Whether tag and attributes fit. A string must equal a class or the attribute, a pattern is searched in it,
        True asks for its presence."""
        if tags is not None and self.tag not in ((tags,) if isinstance(tags, str) else tags):
            return False
        for name, want in attributes.items():
            name = name.rstrip("_").replace("_", "-")
            own = self.attributes.get(name)
            if own is None:
                return False
            if want is True:
                continue
            if isinstance(want, re.Pattern):
                if not want.search(own):
                    return False
            elif own != want and not (name == "class" and want in self.classes):
                return False
        return True

    def all(self, tags=None, **attributes) -> Iterator[Node]:
        return (x for x in self.walk() if x.matches(tags, **attributes))

    def first(self, tags=None, **attributes) -> Node | None:
        return next(self.all(tags, **attributes), None)

    def above(self, tags=None, **attributes) -> Node | None:
        """The nearest ancestor that fits."""
        x = self.parent
        while x is not None and not x.matches(tags, **attributes):
            x = x.parent
        return x

    def before(self, **attributes) -> Node | None:
        """The nearest element before it, of the same parent, that fits."""
        own = [x for x in (self.parent.children if self.parent else []) if isinstance(x, Node)]
        return next((x for x in reversed(own[: next(i for i, x in enumerate(own) if x is self)]) if x.matches(**attributes)), None) if own else None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def _close(self, tags: set[str], until: set[str]) -> None:
        x = self.at
        while x is not self.root and x.tag not in until:
            if x.tag in tags:
                self.at = x.parent
                return
            x = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, {"td", "th", "div", "li", "section", "article", "table", "body", "form", "main", "blockquote"})
        if tag in _ENDS_ITEM:
            self._close(*_ENDS_ITEM[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root:
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; never fails."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
