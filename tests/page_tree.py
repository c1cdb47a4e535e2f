"""A model of pages as trees, over the standard library's parser: what the tag table is held against."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain

from rosterlens.functions import lexicons as L

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order, without recursion."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    stack.append(iter(child.children))
                    break
                out.append(child)
            else:
                stack.pop()
        return "".join(out)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    """Elements end at their own end tag; an end tag closes what is still open inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def prune(node: Node, tags: set[str]) -> None:
    todo = [node]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.tag in tags)]
        todo.extend(n.elements())


def main_text(html: str, most: int = 4000) -> str:
    """Meta descriptions, headings and small blocks of the main part; a nested block repeats its text."""
    import re

    root = tree(html)
    prune(root, {"script", "style", "noscript", "nav", "footer", "svg", "iframe"})
    out = []
    for key, value in (("name", "description"), ("property", "og:description")):
        meta = next((n for n in root.walk() if n.tag == "meta" and n.attrs.get(key) == value), None)
        if meta is not None and meta.attrs.get("content", "").strip():
            out.append(meta.attrs["content"].strip())
    body = next((n for n in root.walk() if n.tag == "body"), root)
    part = next((n for n in root.walk() if n.tag in ("article", "main", "section")), body)
    out += [t for n in part.walk() if n.tag in ("h1", "h2", "h3") and 10 < len(t := n.text().strip()) < 200]
    out += [t for n in part.walk() if n.tag in ("p", "li", "span", "div") and len(n.elements()) <= 5 and 20 < len(t := n.text().strip()) < 800]
    joined = re.sub(r"\s+", " ", " ".join(out))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.,;:!?()'\"/-]", " ", joined)).strip()[:most]


def section_text(root: Node, words: tuple[str, ...], most: int = 5) -> str:
    """Texts of elements whose class or id holds a word, word by word, class before id."""
    out = []
    for word in words:
        for attr in ("class", "id"):
            out += [t for n in root.walk() if word in n.attrs.get(attr, "") and 15 < len(t := n.text().strip()) < 1000]
    return " ".join(out[:most])


def only(node: Node, *tags: str) -> list[Node]:
    return [n for n in node.walk() if n.tag in tags]


def listed(root: Node) -> str:
    rows = (" | ".join(c.text().strip() for c in only(row, "td", "th")) for t in only(root, "table") for row in only(t, "tr")[:10])
    items = (li.text().strip() for u in only(root, "ul", "ol") for li in only(u, "li")[:10])
    return " ".join([t for t in chain(rows, items) if 15 < len(t) < 500][:10])


def heading_text(html: str) -> str:
    """The meta description and up to ten distinct headings."""
    root = tree(html)
    meta = next((n.attrs.get("content", "").strip() for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "description"), "")
    heads = [t for n in root.walk() if n.tag in ("h1", "h2", "h3") and 15 < len(t := n.text().strip()) < 120 and not any(b in t.lower() for b in L.HEADING_BLACKLIST)]
    return (meta + " " + " ".join(list(dict.fromkeys(heads))[:10])).strip()
