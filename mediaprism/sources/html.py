"""Media items in HTML: one Python table function reads the markup, everything else is native.

The reader lists candidates in the order of eight passes (images with their srcset, picture sources, inline SVG, inline
backgrounds, videos, audio, links, own selectors); types, names, keys and duplicates are expressions on these rows.
Static markup only: computed styles, visibility and shadow roots need a browser and are not covered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions.detect import with_detection
from ..functions.filenames import extension, filename
from ..functions.urls import Url, barrier, normalize, with_url
from ..functions.whatwg import resolve

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "a": {"a"}}
#: expect: a type to take if none is detected, or ``=type`` to set it; wanted: the row counts only with this type or, for
#: ``*``, with any known one.
COLUMNS = "pass int, pos int, url string, expect string, wanted string, hint string, width double, height double, alt string, title string, srcset string, link_url string"


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    up: Element | None
    start: int = 0
    end: int = 0
    #: nearest of this element and those around it that are a link with a target, or a player
    link: Element | None = None
    player: Element | None = None
    in_picture: bool = False


class _Reader(HTMLParser):
    """Elements in document order; unclosed elements end where their parent does."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.all = html, []
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.stack: list[Element] = []
        self.open: defaultdict[str, int] = defaultdict(int)
        self.feed(html)
        self.close()
        while self.stack:
            self._pop(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _pop(self, at: int) -> None:
        element = self.stack.pop()
        element.end = at
        self.open[element.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = _CLOSES.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1) if any(self.open[x] for x in ends) else ():
            if self.stack[k].tag in ends:
                while len(self.stack) > k:
                    self._pop(self._at())
                break
            if tag != "a" and self.stack[k].tag in ("ul", "ol", "table", "select", "dl", "div", "section", "article", "body"):
                break
        up = self.stack[-1] if self.stack else None
        seen: dict[str, str] = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        element = Element(tag, seen, up, self._at(), self._at() + len(self.get_starttag_text() or ""))
        element.link = element if tag == "a" and seen.get("href") else up.link if up else None
        element.player = element if tag in ("video", "audio") else up.player if up else None
        element.in_picture = bool(up) and (up.tag == "picture" or up.in_picture)
        self.all.append(element)
        if tag not in VOID and not (self.get_starttag_text() or "").endswith("/>"):
            self.stack.append(element)
            self.open[tag] += 1

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[k].tag == tag:
                end = self.text.find(">", self._at()) + 1 or len(self.text)
                while len(self.stack) > k:
                    self._pop(end)
                return


def _ancestors(e: Element) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.up


_SIMPLE = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")


def matches(e: Element, selector: str) -> bool:
    """Tag, .class, #id, [attr], [attr=value] and descendants, alternatives with commas."""

    def one(e: Element, part: str) -> bool:
        m = _SIMPLE.match(part)
        if not m or (m[1] not in (None, "*") and e.tag != m[1].lower()):
            return False
        for token in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
            if token[0] == ".":
                ok = token[1:] in e.attrs.get("class", "").split()
            elif token[0] == "#":
                ok = e.attrs.get("id") == token[1:]
            else:
                name, _, value = token[1:-1].partition("=")
                ok = name in e.attrs and (not value or e.attrs[name] == value.strip("\"'"))
            if not ok:
                return False
        return True

    def chain(e: Element | None, parts: list[str]) -> bool:
        if e is None or not one(e, parts[-1]):
            return False
        return len(parts) == 1 or any(chain(a, parts[:-1]) for a in _ancestors(e.up))

    return any(chain(e, s.split()) for s in selector.split(",") if s.strip())


def parse_srcset(srcset: str, base: str | None) -> list[str]:
    """The first word of each comma-separated entry, resolved."""
    found = (resolve(entry.split()[0], base) for entry in srcset.split(",") if entry.strip())
    return [u for u in found if u]


def background_url(style: str, base: str | None) -> str | None:
    """The first url(...) of a style."""
    m = re.search(r"""url\(\s{0,20}["']?([^"'()]+)["']?\s{0,20}\)""", style, re.I)
    return resolve(m[1].strip(), base) if m else None


def _side(text: str | None) -> float | None:
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return float(m[1]) or None if m else None


def _link_of(e: Element, base: str | None) -> str | None:
    return resolve(e.link.attrs["href"], base) if e.link else None


def sources_by_player(elements: list[Element]) -> dict[int, list[Element]]:
    """The source elements in each player, by the player's identity."""
    out: dict[int, list[Element]] = defaultdict(list)
    for e in elements:
        player = e.up.player if e.tag == "source" and e.up else None
        while player:
            out[id(player)].append(e)
            player = player.up.player if player.up else None
    return out


def candidates(html: str, base: str | None, types: tuple[str, ...], selectors: tuple[str, ...] = (), ignored: tuple[str, ...] = (), srcset: bool = True, backgrounds: bool = True, links: bool = True) -> list[tuple]:
    """Rows of ``COLUMNS`` in the order of the passes."""
    reader = _Reader(html)
    elements = [e for e in reader.all if not any(matches(e, s) for s in ignored)] if ignored else reader.all
    out: list[tuple] = []

    def add(step: int, url: str | None, expect: str = "", wanted: str = "", hint: str = "unknown", **more) -> None:
        if url:
            out.append((step, len(out), url, expect, wanted, hint, *(more.get(k) for k in ("width", "height", "alt", "title", "srcset", "link_url"))))

    def hint_of(e: Element, k: int) -> str:
        sides = [_side(e.attrs.get(n)) or 0 for n in ("width", "height")]
        named = any(w in e.attrs.get("class", "").lower() for w in ("icon", "btn", "logo", "avatar"))
        return "primary" if k == 0 else "ui-element" if all(0 < s <= 32 for s in sides) or named else "unknown"

    if "image" in types:
        k = 0
        for e in elements:
            if e.tag != "img":
                continue
            a = e.attrs
            if url := resolve(a.get("src", ""), base):
                add(1, url, hint=hint_of(e, k), width=_side(a.get("width")), height=_side(a.get("height")), alt=a.get("alt") or None, title=a.get("title") or None, srcset=a.get("srcset") or None, link_url=_link_of(e, base))
                k += 1
            for url in parse_srcset(a.get("srcset", ""), base) if srcset else ():
                add(1, url, hint="secondary")
        for e in elements:
            if e.tag == "source" and e.in_picture:
                for url in parse_srcset(e.attrs.get("srcset", ""), base):
                    add(2, url, hint="secondary")
        for e in elements:
            if e.tag == "svg":
                box = e.attrs.get("viewbox", "").split()
                number = lambda x: float(m[0]) or None if (m := re.match(r"[+-]?(\d+\.?\d*|\.\d+)", x)) else None
                size = {"width": number(box[2]), "height": number(box[3])} if len(box) >= 4 else {}
                add(3, "data:image/svg+xml," + quote(html[e.start : e.end], safe="!'()*-._~"), "=image", **size)
        for e in elements if backgrounds else ():
            add(4, background_url(e.attrs.get("style", ""), base), wanted="image", hint="secondary", link_url=_link_of(e, base))
    kept, sources = {id(e) for e in elements}, sources_by_player(reader.all)
    for step, kind in ((5, "video"), (6, "audio")):
        if kind not in types:
            continue
        for k, e in enumerate(e for e in reader.all if e.tag == kind):
            if id(e) not in kept:
                continue
            size = {"width": _side(e.attrs.get("width")), "height": _side(e.attrs.get("height"))} if kind == "video" else {}
            add(step, resolve(e.attrs.get("src", ""), base), kind, hint="primary" if k == 0 else "unknown", **size)
            for s in sources[id(e)]:
                add(step, resolve(s.attrs.get("src", ""), base), kind, hint="secondary")
            if kind == "video" and "image" in types:
                add(step, resolve(e.attrs.get("poster", ""), base), "=image", hint="secondary")
    if links:
        for e in elements:
            if e.tag == "a" and "href" in e.attrs:
                add(7, resolve(e.attrs["href"], base), wanted="*", title=e.attrs.get("title") or None)
    for s in selectors:
        for e in elements:
            if matches(e, s):
                for name in ("src", "href", "data-src", "data-url", "data-image"):
                    add(8, resolve(e.attrs.get(name, ""), base), wanted="*")
    return out


def html_items(df: DataFrame, html: str = "html", base_url: str | None = None, key: str = "page_id", media_types: tuple[str, ...] = T.MEDIA_TYPES, mode: str = "html", **options) -> DataFrame:
    """One row for each item of each page: key, ord, and the item's columns; first seen wins within a page.

    ``mode="dom"`` walks the elements in document order instead of pass by pass (see ``dom``).

    Items without a wanted type are dropped where a pass asks for one; images keep ``unknown``, video and audio fall back
    to their element's type.
    """
    kind = df.schema[key].dataType.simpleString()
    base = F.col(base_url) if base_url else F.lit(None).cast("string")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .dom import dom_candidates

        find = dom_candidates if mode == "dom" else candidates
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for x in frames:
            rows = [(k, *r) for k, h, b in zip(x["key"], x["html"], x["base"], strict=True) for r in find(h or "", b, media_types, **options)]
            yield pd.DataFrame(rows, columns=["key", *names])

    raw = df.select(F.col(key).alias("key"), F.col(html).alias("html"), base.alias("base")).mapInPandas(read, f"key {kind}, {COLUMNS}")
    items = with_url(raw, "url")
    url = Url("url")
    items = items.withColumn("format", barrier(extension(url))).withColumn("filename", filename(url)).withColumn("dedupe_key", F.when(F.col("pass") == 3, F.col("url")).otherwise(normalize(url)))
    items = with_detection(items, url, ext="format")
    found = F.col("detection.type")
    fixed = F.col("expect").startswith("=")
    items = items.withColumn("media_type", F.when(fixed, F.substring("expect", 2, 20)).when((found == "unknown") & (F.col("expect") != ""), F.col("expect")).otherwise(found))
    items = items.withColumn("confidence", F.when(F.col("pass") == 3, 1.0).when(fixed, 0.9).otherwise(F.col("detection.confidence")))
    items = items.withColumn("format", F.when(F.col("pass") == 3, "svg").otherwise(F.col("format"))).withColumn("filename", F.when(F.col("pass") == 3, "inline-svg").otherwise(F.col("filename")))
    wanted = (F.col("wanted") == "") | ((F.col("wanted") == "*") & found.isin(*media_types)) | (F.col("wanted") == found)
    first = F.row_number().over(Window.partitionBy("key", "dedupe_key").orderBy("pos"))
    items = items.filter(wanted).withColumn("__first", first).filter("__first = 1")
    return items.select(F.col("key").alias(key), F.col("pos").cast("long").alias("ord"), "url", F.lit(f"{mode}-element").alias("source"), "media_type", "format", "filename", "hint", "confidence", "dedupe_key", "width", "height", "alt", "title", "srcset", "link_url")
