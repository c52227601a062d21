"""A small HTML reader: block elements with what is needed to classify them, and the text in them.

Markup is read as browsers do in the cases that matter for text: comments, raw-text elements, unquoted attributes,
missing end tags of paragraphs, list items and table parts, stray end tags, and misnested inline elements.  Inline elements
belong to the block around them.  Attributes of ``html`` and ``body`` name the page's template, not a part of the page, and
are not kept.  The places of open elements are kept by name, so a page costs about its length, however unbalanced it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; of these, browsers read the first ones as raw text to the end of the page if they have no end tag.
RAW_TO_END = frozenset("script style title textarea iframe noembed noframes xmp".split())
RAW = RAW_TO_END | frozenset("noscript template object svg math canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Tags that the classifier tells apart; all others share one number.
TAGS = ("html", "body", "div", "p", "article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "button", "label", "select", "option", "fieldset", "dialog", "menu", "address", "details", "summary", "tbody", "thead", "center")
NUMBER = {t: i for i, t in enumerate(TAGS)}
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
#: Start tag -> open elements that it ends, and where the search for them stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*))>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of class, id, role and the like, by what they hint at.
FAMILIES = (
    frozenset("article post entry story content body main text copy blog news prose".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager toc tabs skip".split()),
    frozenset("header masthead topbar logo branding banner hero head".split()),
    frozenset("footer foot copyright legal colophon imprint contentinfo bottom".split()),
    frozenset("sidebar side aside widget widgets rail complementary secondary".split()),
    frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense commercial".split()),
    frozenset("comment comments commentlist reply replies respond disqus discussion feedback reviews".split()),
    frozenset("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription announcement warning toast".split()),
    frozenset("share sharing social follow related recommended recommendations trending popular more similar tags tag".split()),
    frozenset("form search login signup signin register contact dialog button".split()),
    frozenset("title headline heading subtitle lead intro summary caption figure quote paragraph".split()),
    frozenset("meta byline author date time info hidden none print".split()),
)
_masks: dict[str, int] = {}


def mask_of(attributes: str) -> int:
    """A bit for each family that the attributes name."""
    out = _masks.get(attributes)
    if out is None:
        found: set[str] = set()
        for name, value in _ATTR.findall(attributes):
            name = name.lower()
            if name == "style":
                found |= {"hidden"} if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else set()
            elif name in ("hidden", "aria-hidden"):
                found |= {"hidden"} if value.strip("\"'").lower() != "false" else set()
            else:
                found |= {t.lower() for t in _TOKEN.findall(value)}
        out = sum(1 << i for i, family in enumerate(FAMILIES) if found & family)
        if len(_masks) > 50_000:
            _masks.clear()
        _masks[attributes] = out
    return out


class Page:
    """Blocks in page order: parallel lists over nodes, and segments (node, text) in page order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.depth, self.end = [NUMBER["html"]], [0], [0], [0]
        self.mask, self.above, self.index, self.children = [0], [0], [0], [0]
        self.above_tags, self.tags_in = [0], [0]
        self.own, self.link, self.segments = [0], [0], []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._open: defaultdict[str, list[int]] = defaultdict(list)  # places of each name in the stack
        self._open["html"].append(0)
        self._blocks: list[int] = [0]  # places of blocks in the stack
        self._run: list[str] = []
        self._links = 0
        self._open_links = 0
        self._read(html)
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self) -> None:
        if self._run:
            text = "".join(self._run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                node = self._block()
                self.segments.append((node, text))
                self.own[node] += len(text)
                self.link[node] += min(self._links, len(text))
            self._run, self._links = [], 0

    def _block(self) -> int:
        return self._stack[-1][1]

    def _pop(self) -> str:
        name, node = self._stack.pop()
        self._open[name].pop()
        if name in INLINE:
            self._open_links -= name == "a"
        else:
            self._blocks.pop()
            self.end[node] = len(self.tag)
        return name

    def _push(self, name: str, node: int) -> None:
        if name not in INLINE:
            self._blocks.append(len(self._stack))
        self._open[name].append(len(self._stack))
        self._stack.append((name, node))

    def _text(self, text: str) -> None:
        self._run.append(text)
        if self._open_links:
            self._links += len(text)

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self._run.append(" ")
                if name == "hr":
                    self._flush()
            self.tags_in[self._block()] += 1
            return
        if name in INLINE:
            if name == "a" and self._open_links:
                self._close("a")
            self._push(name, self._block())
            self._open_links += name == "a"
            self.tags_in[self._block()] += 1
            return
        self._flush()
        if name in ("html", "body", "head"):
            return
        if name in _CLOSES_P and self._stack[self._blocks[-1]][0] == "p":
            self._close_to(self._blocks[-1])
        if name in _ENDS:
            ends, stop = _ENDS[name]
            least = max((self._open[x][-1] for x in stop if self._open[x]), default=0)
            # a row ends all cells and rows up to its table, others the innermost element only
            far = name in ("tr", "tbody")
            hits = [places[bisect_right(places, least)] if far else places[-1] for places in map(self._open.__getitem__, ends) if places and places[-1] > least]
            if hits:
                self._close_to(min(hits) if far else max(hits))
        up = self._block()
        node = len(self.tag)
        self.tag.append(NUMBER.get(name, len(TAGS)))
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.end.append(node + 1)
        self.mask.append(mask_of(attributes) if attributes else 0)
        self.above.append(self.above[up] | self.mask[up])
        self.above_tags.append(self.above_tags[up] | 1 << self.tag[up])
        self.index.append(self.children[up])
        self.children[up] += 1
        self.children.append(0)
        self.own.append(0)
        self.link.append(0)
        self.tags_in.append(1)
        self._push(name, node)

    def _close_to(self, k: int) -> None:
        while len(self._stack) > k:
            self._pop()

    def _close(self, name: str) -> None:
        """Ends the innermost open element of this name; a name that isn't open costs nothing."""
        places = self._open[name]
        if not places or name == "html":
            return
        if name not in INLINE:
            self._flush()
        elif places[-1] < self._blocks[-1]:
            return  # misnested: the inline element was opened outside this block
        self._close_to(places[-1])

    def _read(self, html: str) -> None:
        at, n, lower, endless = 0, len(html), None, set()
        while at < n:
            left = html.find("<", at)
            if left < 0:
                self._text(html[at:])
                return
            if left > at:
                self._text(html[at:left])
            m = _TAG.match(html, left)
            if not m:
                if re.match(r"</?[A-Za-z!?]", html[left : left + 3]):
                    return  # a tag that never ends
                self._text("<")
                at = left + 1
                continue
            at = m.end()
            end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if end:
                if name == "p" and not self._open["p"]:
                    self._flush()
                self._close(name)
                continue
            if name in RAW:
                if attributes.endswith("/") and name in ("svg", "math") or name in endless:
                    continue
                lower = lower if lower is not None else html.lower()
                if len(lower) != n:  # lower-casing may change the length of some letters
                    found = re.compile(rf"</{name}\b", re.I).search(html, at)
                    stop = found.start() if found else -1
                else:
                    stop = lower.find(f"</{name}", at)
                if stop < 0 and name in RAW_TO_END:
                    return
                if stop < 0:
                    endless.add(name)  # what follows is read as if the start tag weren't there
                    continue
                right = html.find(">", stop)
                at = n if right < 0 else right + 1
                continue
            self._start(name, attributes)
