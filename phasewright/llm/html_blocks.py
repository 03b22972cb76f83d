"""Leaf blocks of a page: their text and what stands above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "audio", "button in line", "canvas", "object", "picture", "video", "meter", "progress", "output", "slot",
    # formulas and drawings within a line
    "math", "annotation", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace",
    "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
    "svg", "circle", "defs", "ellipse", "g", "image", "line", "path", "polygon", "polyline", "rect", "text", "textpath", "tspan", "use",
}
#: Elements of running text: a button within it is part of the line.
_LINES = {"p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}
#: Scripts, styles, form controls and what no browser shows; they end only at their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "select", "template"}
#: Text without markup up to the element's own end tag.
PLAIN = {"xmp", "listing"}
#: An open element that a new one of the same family ends, unless one of the third set stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=)*+)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tags: tuple[str, ...]  # outermost first, block elements only
    names: tuple[str, ...]  # words of class, id and role of all of them
    parent: int  # equal for blocks of one parent


@dataclass
class _Element:
    tag: str
    names: tuple[str, ...]
    key: int


@dataclass
class _Builder:
    stack: list[_Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    made: int = 0

    def words(self, chunk: str) -> None:
        if chunk:
            self.text.append(chunk)
            if self.links:
                self.linked += len(chunk.strip())

    def close_block(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                above = [e for e in self.stack if e.tag not in INLINE]
                parent = above[-2].key if len(above) > 1 else 0
                self.blocks.append(Block(text, self.linked, tuple(e.tag for e in above), tuple(n for e in above for n in e.names), parent))
        self.text, self.linked = [], 0

    def pop(self, at: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.stack[at:])
        del self.stack[at:]

    def start(self, tag: str, rest: str) -> None:
        if tag == "button" and self.text and next((e.tag for e in reversed(self.stack) if e.tag not in INLINE), "") in _LINES:
            tag = "button in line"
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr"):
                if tag in ("hr", "input"):
                    self.close_block()
                elif tag == "br":
                    self.text.append(" ")
            elif tag not in VOID and not rest.endswith("/"):
                if tag == "a":
                    self.end("a")
                    self.links += 1
                self.stack.append(_Element(tag, (), 0))
            return
        self.close_block()
        kinds, walls = _ENDS.get(tag, (set(), set()))
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at].tag
            if name == "p" or name in kinds:
                self.pop(at)
                if name == "p" and kinds:
                    continue
                if name == "p":
                    break
            elif name in walls or (not kinds and name not in INLINE):
                break
        self.made += 1
        found = []
        if "=" in rest:
            for m in _NAMES.finditer(rest):
                found += _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())
        self.stack.append(_Element(tag, tuple(found), self.made))

    def end(self, tag: str) -> None:
        if tag == "button" and any(e.tag == "button in line" for e in self.stack):
            tag = "button in line"
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                if tag not in INLINE:
                    self.close_block()
                self.pop(at)
                return
            if tag in INLINE and self.stack[at].tag not in INLINE:
                return
        if tag not in INLINE:
            self.close_block()


def leaf_blocks(page: str | None) -> list[Block]:
    """Every run of text between two block boundaries, in page order.

    Inline elements don't end a block, nor do formulas, drawings and embedded
    media, whose text is the block's; a line break in one is white space.
    Character references are decoded, white space turns into one space. Broken
    markup never fails: unknown end tags are ignored, open elements end with
    the element that holds them.
    """
    page, b, at = page or "", _Builder(), 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            b.words(page[at:])
            break
        b.words(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            b.end(tag)
        elif tag in RAW or tag in PLAIN:
            if not m["rest"].endswith("/"):
                if tag != "title" or not any(e.tag == "svg" for e in b.stack):
                    b.close_block()
                close = re.compile(rf"</{tag}\s*(?:>|/|\s)", re.I).search(page, at)
                if tag in PLAIN:
                    # "&" as a reference, so that decoding gives the text as it stands
                    b.start(tag, "")
                    b.words(page[at : close.start() if close else len(page)].replace("&", "&amp;"))
                    b.end(tag)
                at = page.find(">", close.end() - 1) + 1 or len(page) if close else len(page)
        else:
            b.start(tag, m["rest"])
    b.close_block()
    return b.blocks
