"""Event walk over one HTML page that yields its ordered text blocks.

This is the per-row helper behind ``operators.segment.segment_blocks``; it
runs inside an Arrow batch UDF, one call per page.  It only decides block
boundaries, the text of each block and which class/id attribute texts form
its css context; tokenizing those attributes, labels, features and
everything else is done by Spark column expressions.

Rules (walk starts at ``<body>``):

* pre-clean: ``script``/``applet``/``link``, comments and processing
  instructions vanish with their content, their trailing text is kept and
  glued to the text before them; ``iframe``/``embed``/``object``/``param``/
  ``layer``/``blink``/``marquee`` lose the tag but keep their content;
* an ignored element is skipped together with its trailing text;
* an element's class/id bag is pushed before its opening flush and popped
  after its trailing text was queued;
* a non-inline element flushes the queued text on open and on close;
* the direct text of ``<a>`` is stripped and wrapped in link markers;
* a flush joins queued pieces with one space and normalizes whitespace;
  an empty result emits nothing;
* the css context of a block is the last ``CSS_DEPTH`` pushed bags.

The body opens at its tag, at the first element that can't be in a head, or at
the first text outside of the head's elements.  Its end tag and that of the page
are taken back: what follows them still belongs to the body, and a further
body tag changes nothing.

Unclosed tags are repaired with a small subset of HTML's implied-end rules
(``<p>``, ``<li>``, ``<dt>/<dd>``, ``<option>``, table rows and cells); an
end tag closes every element opened after its matching start tag.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# ---- fixed values: must equal the reference's segmentation constants ----
# Elements skipped together with their tail text.
IGNORED_TAGS = frozenset(
    "style,script,option,object,embed,applet,link,noscript".split(","))
# Elements that neither start nor end a block (br deliberately is not inline).
INLINE_TAG_LIST = (
    "a,b,big,i,small,tt,abbr,acronym,cite,code,dfn,em,kbd,strong,samp,var,"
    "bdo,img,map,object,q,span,sub,sup,button,input,label,select,textarea"
    .split(","))
INLINE_TAGS = frozenset(INLINE_TAG_LIST)
# Number of innermost class/id-bearing elements forming a block's css context.
CSS_DEPTH = 5
# Markers wrapped around the direct text of an anchor.
LINK_BEGIN = "<<LINK<<"
LINK_END = ">>LINK>>"
# ---- end of fixed values ----

# HTML cleaner defaults applied before the walk (forms, style, meta, page
# structure, unknown tags and all attributes are kept).
KILLED_TAGS = frozenset({"script", "applet", "link"})
UNWRAPPED_TAGS = frozenset(
    {"iframe", "embed", "object", "param", "layer", "blink", "marquee"})

VOID_TAGS = frozenset(
    "area,base,basefont,br,col,embed,frame,hr,img,input,isindex,keygen,link,"
    "meta,param,source,track,wbr".split(","))
# Content of a head: it opens no body.
_HEAD_TAGS = frozenset(
    "html,head,title,meta,link,style,script,base,noscript,template,bgsound,basefont".split(","))
# Head elements whose text is no page text.
_HEAD_TEXT_TAGS = frozenset({"title", "style", "script", "noscript", "template"})

# Implied ends: a start tag closes an open element of the listed kinds when
# no element of the boundary kinds lies between.
_CLOSES_P = frozenset(
    "address,article,aside,blockquote,center,details,dialog,dir,div,dl,"
    "fieldset,figcaption,figure,footer,form,h1,h2,h3,h4,h5,h6,header,hgroup,"
    "hr,li,dd,dt,main,menu,nav,ol,p,pre,section,table,ul".split(","))
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_P_SCOPE = frozenset({"body", "table", "td", "th", "caption", "button", "html"})

_BLANK = re.compile(r"\s+", re.ASCII)
# What a text without longer runs of white space has none of.
_ODD_BLANKS = ("\n", "  ", "\t", "\r", "\x0b", "\x0c")
_CSS_CONTENT = re.compile(r"[^\s_:\-]", re.ASCII)


def normalize(text: str) -> str:
    """Collapse ASCII whitespace runs to one space and strip both ends."""
    if any(blank in text for blank in _ODD_BLANKS):
        text = _BLANK.sub(" ", text)
    return text.strip()


class _Frame:
    __slots__ = ("tag", "inline", "has_css", "ignored")

    def __init__(self, tag, inline, has_css, ignored):
        self.tag = tag
        self.inline = inline
        self.has_css = has_css
        self.ignored = ignored


class BlockWalker(HTMLParser):
    """Streaming walk; ``run(html)`` returns ``(blocks, body_text)``.

    ``blocks`` is a list of ``(text, css_sources)`` where ``css_sources`` are
    the class+id attribute texts of the innermost ``CSS_DEPTH`` bag-bearing
    elements, outermost first.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def run(self, html: str):
        self.reset()
        self._in_body = False
        self._head_text = 0      # depth inside head elements that hold text
        self._kill = 0           # depth inside removed elements
        self._ignore = 0         # depth inside ignored elements
        self._stack: list[_Frame] = []
        self._css: list[str] = []
        self._frags: list[str] = []
        self._mode = "drop"      # how the current text node is used
        self._pieces: list[str] = []
        self._blocks: list[tuple[str, list[str]]] = []
        self._body: list[str] = []
        self.feed(html or "")
        self.close()
        if self._in_body:
            self._finish_node()
            self._pop_to(0)
            self._in_body = False
        return self._blocks, normalize("".join(self._body))

    # -- text nodes and blocks --------------------------------------------
    def _finish_node(self):
        text = "".join(self._frags)
        self._frags = []
        if not text:
            return
        if self._mode == "plain":
            self._pieces.append(text)
        elif self._mode == "anchor":
            self._pieces.append(LINK_BEGIN + text.strip() + LINK_END)

    def _flush(self):
        if not self._pieces:
            return
        text = normalize(" ".join(self._pieces))
        self._pieces = []
        if text:
            self._blocks.append((text, self._css[-CSS_DEPTH:]))

    # -- element frames ---------------------------------------------------
    def _open(self, tag, attrs):
        if self._ignore or tag in IGNORED_TAGS:
            self._stack.append(_Frame(tag, True, False, True))
            self._ignore += 1
            self._mode = "drop"
        else:
            first = {}
            for k, v in attrs:
                first.setdefault(k, v)
            src = (first.get("class") or "") + " " + (first.get("id") or "")
            has_css = _CSS_CONTENT.search(src) is not None
            if has_css:
                self._css.append(src)
            inline = tag in INLINE_TAGS
            self._stack.append(_Frame(tag, inline, has_css, False))
            if not inline:
                self._flush()
            self._mode = "anchor" if tag == "a" else "plain"
        if tag in VOID_TAGS:
            self._pop_to(len(self._stack) - 1)

    def _close(self, frame: _Frame):
        if frame.ignored:
            self._ignore -= 1
            self._mode = "drop"
            return
        if not frame.inline:
            self._flush()
        self._mode = "drop" if self._ignore else "plain"
        if frame.has_css:
            self._css.pop()

    def _pop_to(self, index: int):
        while len(self._stack) > index:
            self._close(self._stack.pop())

    def _find(self, tags, boundary):
        for i in range(len(self._stack) - 1, -1, -1):
            t = self._stack[i].tag
            if t in tags:
                return i
            if t in boundary:
                return -1
        return -1

    def _implied_ends(self, tag):
        if tag in _CLOSES_P:
            i = self._find({"p"}, _P_SCOPE)
            if i >= 0:
                self._pop_to(i)
        rule = _IMPLIED.get(tag)
        if rule:
            i = self._find(rule[0], rule[1])
            if i >= 0:
                self._pop_to(i)

    # -- parser callbacks -------------------------------------------------
    def handle_starttag(self, tag, attrs):
        if not self._in_body:
            if tag in _HEAD_TAGS:
                self._head_text += tag in _HEAD_TEXT_TAGS
                return
            self._open_body(attrs if tag == "body" else [])
            if tag == "body":
                return
        elif tag in ("body", "html", "head"):
            return
        if self._kill:
            if tag in KILLED_TAGS and tag not in VOID_TAGS:
                self._kill += 1
            return
        if tag in KILLED_TAGS:
            if tag not in VOID_TAGS:
                self._kill += 1
            return
        if tag in UNWRAPPED_TAGS:
            return
        self._finish_node()
        if not self._ignore:
            self._implied_ends(tag)
        self._open(tag, attrs)

    def _open_body(self, attrs):
        self._in_body = True
        self._mode = "drop"
        self._open("body", attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self._in_body:
            if tag in _HEAD_TEXT_TAGS and self._head_text:
                self._head_text -= 1
            return
        if self._kill:
            if tag in KILLED_TAGS:
                self._kill -= 1
            return
        if tag in UNWRAPPED_TAGS:
            return
        if tag in ("body", "html"):
            return
        i = self._find({tag}, ())
        if i < 0:
            return
        self._finish_node()
        self._pop_to(i)

    def handle_data(self, data):
        if not self._in_body:
            if self._head_text or not data.strip():
                return
            self._open_body([])
        if self._kill:
            return
        self._body.append(data)
        self._frags.append(data)


def segment_page(html: str):
    """Blocks and whole-body text of one page (convenience for tests)."""
    return BlockWalker().run(html)
