"""Media items in document order, as a walk over a page's elements finds them.

One walk stands for the live document: sources are resolved against the page, sizes come from attributes, and only inline
styles can hide an element.  Computed styles, layout boxes, shadow roots and frames need a browser and are not covered.
"""

from __future__ import annotations

import re

from ..functions.whatwg import resolve
from .html import Element, _link_of, _Reader, _side, background_url, matches, sources_by_player

_UI_WORDS = ("icon", "btn", "button", "logo", "avatar", "thumbnail")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)


def is_visible(e: Element) -> bool:
    """By the element's own inline style."""
    return not _HIDDEN.search(e.attrs.get("style", ""))


def hint_of(e: Element, width: float | None, height: float | None) -> str:
    small = bool(width and height and width <= 32 and height <= 32)
    named = any(w in e.attrs.get("class", "").lower() for w in _UI_WORDS)
    return "ui-element" if small or named or e.attrs.get("role") in ("button", "icon") else "unknown"


def dom_candidates(html: str, base: str | None, types: tuple[str, ...], selectors: tuple[str, ...] = (), ignored: tuple[str, ...] = (), backgrounds: bool = True, include_hidden: bool = False, min_width: float = 1, min_height: float = 1) -> list[tuple]:
    """Rows shaped as those of the HTML reader."""
    elements = _Reader(html).all
    sources = sources_by_player(elements)
    out: list[tuple] = []

    def add(step: int, url: str | None, expect: str = "", wanted: str = "", hint: str = "unknown", **more) -> None:
        if url:
            out.append((step, len(out), url, expect, wanted, hint, *(more.get(k) for k in ("width", "height", "alt", "title", "srcset", "link_url"))))

    for e in elements:
        if (not include_hidden and not is_visible(e)) or any(matches(e, s) for s in ignored):
            continue
        a = e.attrs
        size = {"width": _side(a.get("width")), "height": _side(a.get("height"))}
        large = size["width"] is None or size["height"] is None or (size["width"] >= min_width and size["height"] >= min_height)
        source = resolve(a.get("src", ""), base)
        if e.tag == "img" and "image" in types and large:
            add(1, source, "image", hint=hint_of(e, **size), alt=a.get("alt") or None, title=a.get("title") or None, link_url=_link_of(e, base), **size)
        elif e.tag in ("video", "audio") and e.tag in types:
            add(5, source, e.tag, title=(a.get("title") or None) if e.tag == "video" else None, **(size if e.tag == "video" else {}))
            for s in sources[id(e)]:
                add(5, resolve(s.attrs.get("src", ""), base), e.tag, hint="secondary")
            if e.tag == "video" and "image" in types:
                add(5, resolve(a.get("poster", ""), base), "=image", hint="secondary")
        if backgrounds and "image" in types and large:
            add(4, background_url(a.get("style", ""), base), wanted="image", hint="secondary", link_url=_link_of(e, base), **size)
    for selector in selectors:
        for e in elements:
            if matches(e, selector):
                for name in ("src", "href", "data-src", "data-url", "data-image"):
                    add(8, resolve(e.attrs.get(name, ""), None), wanted="*")
    return out
