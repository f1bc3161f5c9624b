"""A tolerant tree of an HTML page and the few selections needed from it."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.texts = tag, attrs, parent, [], []

    def walk(self):
        """The nodes below, in document order, without recursion, so that depth is no limit."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                yield node
                stack.extend(reversed(node.children))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                if node.tag not in ("script", "style"):
                    stack.extend(reversed(node.children))
            else:
                out.append(node)
        return " ".join(" ".join(out).split())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def find(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Node | None:
        return next(self.find_all(tag, cls, **attrs), None)

    def find_all(self, tag: str | None = None, cls: str | None = None, **attrs: str):
        for n in self.walk():
            if (tag is None or n.tag == tag) and (cls is None or n.has_class(cls)) and all(n.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield n


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The page's tree; unclosed elements end with what holds them, stray end tags are ignored."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
