"""A small tolerant HTML parser: what the extractor's expressions are tested against.

It builds an element tree; end tags close the nearest open element of their
name and all inside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from reelhouse.sources.html_cards import CARD_RULES, CardRules

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr"}


class Node:
    """An element.  ``doc`` lists every element of the document in order;
    the descendants of a node are ``doc[index + 1:end]``."""
    __slots__ = ("tag", "attrs", "classes", "children", "parent", "doc", "index", "end")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None", doc: list):
        self.tag = tag
        self.attrs = attrs
        self.classes = set((attrs.get("class") or "").split())
        self.children: list = []          # Node or str, in document order
        self.parent = parent
        self.doc = doc
        self.index = len(doc) - 1         # the root is not in doc
        self.end = len(doc)

    def get(self, name: str, default=None):
        v = self.attrs.get(name, default)
        return default if v is None and default is not None else v

    def iter(self) -> list["Node"]:
        """Descendant elements in document order (not self)."""
        return self.doc[self.index + 1:self.end]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self) -> str:
        """Text nodes stripped one by one and joined with no separator."""
        return "".join(s.strip() for s in self.strings() if s.strip())


# Markup is read in one forward pass: from every "<" to the ">" that ends it.
# Where no ">" is left, the rest of the page is an unfinished tag and is
# dropped, as HTML5 does at the end of a file, so no text is scanned twice.
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />]*+")
# Up to the ">" of a start tag; quotes only count right after "=".
_TAG_END = re.compile(r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
# One attribute: a name, and the value after "=" (quoted, or up to a space).
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/=>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
# Elements whose content is raw text up to the matching end tag.
RAW_TEXT = {"script", "style"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW_TEXT}


def _attributes(text: str) -> tuple[dict[str, str], bool]:
    """Attributes of a start tag's text after its name, and whether the tag closes itself.

    A repeated attribute keeps its last value; one without a value is ``''``.
    A slash at the end that belongs to an unquoted value closes nothing.
    """
    out, end = {}, 0
    for m in _ATTRIBUTE.finditer(text):
        value, end = m[2] or "", m.end()
        if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out[m[1].lower()] = unescape(value)
    return out, text[end:].strip() == "/"


def parse(html: str) -> Node:
    """Element tree of ``html``; end tags close the nearest open element of
    their name (unmatched end tags are ignored)."""
    html = html or ""
    doc: list[Node] = []
    root = Node("#root", {}, None, doc)
    stack = [root]
    opened: Counter[str] = Counter()  # names on the stack

    def close(k: int) -> None:
        for node in stack[k:]:
            node.end = len(doc)
            opened[node.tag] -= 1
        del stack[k:]

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(unescape(html[a:b]))

    pos, n = 0, len(html)
    while pos < n:
        start = html.find("<", pos)
        if start < 0:
            text(pos, n)
            break
        text(pos, start)
        mark = html[start + 1:start + 2]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            pos = n if end < 0 else end + 3
        elif mark in ("!", "?", "/"):
            end = html.find(">", start)
            if end < 0:
                break
            name = _NAME.match(html, start + 2) if mark == "/" else None
            if name and opened[name[0].lower()]:
                tag = name[0].lower()
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            pos = end + 1
        elif name := _NAME.match(html, start + 1):
            end = _TAG_END.match(html, name.end())
            if end is None:
                break
            tag, inside = name[0].lower(), html[name.end():end.end() - 1]
            attributes, closed = _attributes(inside) if inside else ({}, False)
            doc.append(None)
            node = doc[-1] = Node(tag, attributes, stack[-1], doc)
            stack[-1].children.append(node)
            pos = end.end()
            if closed or tag in VOID:
                continue
            stack.append(node)
            opened[tag] += 1
            if tag in RAW_TEXT:
                stop = _RAW_END[tag].search(html, pos)
                raw = html[pos:stop.start() if stop else n]
                if raw:
                    node.children.append(raw)
                close(len(stack) - 1)
                pos = stop.end() if stop else n
        else:
            stack[-1].children.append("<")
            pos = start + 1
    close(1)
    root.end = len(doc)
    return root


def _simple(node: Node, sel) -> bool:
    tag, cls, ident = sel
    return (tag is None or node.tag == tag) and (cls is None or cls in node.classes) and \
        (ident is None or node.attrs.get("id") == ident)


def matches(node: Node, chain, scope: Node) -> bool:
    """``node`` matches the last selector and has ancestors (below ``scope``)
    matching the earlier ones in order."""
    if not _simple(node, chain[-1]):
        return False
    want = len(chain) - 2
    anc = node.parent
    while want >= 0 and anc is not None and anc is not scope:
        if _simple(anc, chain[want]):
            want -= 1
        anc = anc.parent
    return want < 0


def select(scope: Node, chain) -> list[Node]:
    return [n for n in scope.iter() if matches(n, chain, scope)]


def select_one(scope: Node, chain) -> Node | None:
    for n in scope.iter():
        if matches(n, chain, scope):
            return n
    return None


def cards_of_page(page_id: int, html: str, rules: CardRules = CARD_RULES) -> list[dict]:
    """Raw card fields of one page, one dict per card element, in order.

    A card inside another is a card of its own as well.
    """
    root = parse(html)
    out = []
    cards = [n for n in root.iter() if n.tag == rules.card]
    for pos, card in enumerate(cards):
        link_el = next((el for chain in rules.links if (el := select_one(card, chain)) is not None), None)
        title_el = select_one(card, rules.title)
        channel_el = select_one(card, rules.channel)
        thumb_el = select_one(card, rules.thumbnail)
        length_el = select_one(card, rules.length)
        progress_el = select_one(card, rules.progress)
        rows = select(card, rules.row)
        spans = [s.text() for s in select(rows[1], rules.span)] if len(rows) >= 2 else None
        out.append({
            "page_id": page_id, "pos": pos,
            "href": None if link_el is None else link_el.attrs.get("href", ""),
            "title_attr": None if title_el is None else title_el.attrs.get("title"),
            "title_text": None if title_el is None else title_el.text(),
            "channel": None if channel_el is None else channel_el.text(),
            "thumb_src": None if thumb_el is None else thumb_el.attrs.get("src"),
            "length_text": None if length_el is None else length_el.text(),
            "progress_style": None if progress_el is None else progress_el.attrs.get("style", ""),
            "meta_spans": spans,
            "is_ad": any(n.tag == rules.ad for n in card.iter()),
            "is_sponsored": any(s == rules.sponsored for s in card.strings()),
            "is_collection": any(rules.collection in n.classes for n in card.iter()),
        })
    return out
