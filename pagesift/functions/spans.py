"""Gold text of annotated HTML: the text of ``<span class="x-nc-sel2">``
elements (per-page helper used inside an Arrow UDF)."""

from __future__ import annotations

from html.parser import HTMLParser

from pagesift.functions.html_blocks import VOID_TAGS, normalize

# ---- fixed values: the annotation markup the gold spans use ----
GOLD_SPAN_CLASS = "x-nc-sel2"
DENSITY_ATTRIBUTE = "x-text-density"
# ---- end of fixed values ----


class _Node:
    __slots__ = ("tag", "attrs", "text", "children", "closed_text")

    def __init__(self, tag, attrs):
        self.tag = tag
        self.attrs = attrs
        self.text = []          # direct text before the first child element
        self.children = []      # child element nodes (only tracked under gold spans)
        self.closed_text = False


class SpanReader(HTMLParser):
    """Collects, in document order, for each gold span: its stripped direct
    text when it has any; otherwise, when its only child is a span carrying
    the density attribute and text, that child's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def run(self, html: str) -> str:
        self.reset()
        self._stack: list[_Node] = []
        self._pieces: list[tuple[int, str | None]] = []
        self._open_gold: list[tuple[_Node, int]] = []
        self.feed(html or "")
        self.close()
        while self._stack:
            self._pop()
        return normalize(" ".join(p for _, p in sorted(self._pieces) if p is not None))

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v)
        node = _Node(tag, first)
        if self._stack:
            parent = self._stack[-1]
            parent.closed_text = True
            parent.children.append(node)
        if tag == "span" and first.get("class") == GOLD_SPAN_CLASS:
            self._open_gold.append((node, len(self._pieces)))
            self._pieces.append((len(self._pieces), None))
        if tag in VOID_TAGS:
            return
        self._stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag == tag:
                while len(self._stack) > i:
                    self._pop()
                return

    def _pop(self):
        node = self._stack.pop()
        if self._open_gold and self._open_gold[-1][0] is node:
            _, slot = self._open_gold.pop()
            self._pieces[slot] = (slot, _gold_piece(node))

    def handle_data(self, data):
        if self._stack and not self._stack[-1].closed_text:
            self._stack[-1].text.append(data)


def _gold_piece(node: _Node):
    own = "".join(node.text)
    if own:
        return own.strip()
    if len(node.children) == 1:
        child = node.children[0]
        text = "".join(child.text)
        if child.tag == "span" and DENSITY_ATTRIBUTE in child.attrs and text:
            return text
    return None


def read_gold_spans(html: str) -> str:
    return SpanReader().run(html)
