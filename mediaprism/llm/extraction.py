"""Main-text extraction: boosted trees over DOM-node features and a decision for the whole tree.

Every block element gets features: tag, hints in its class, id and role and in those of its ancestors, ancestor tags,
depth, place among its siblings, and statistics of its subtree (text, links, tags, paragraphs, and densities).  The trees'
log-odds, weighed by the element's own text, are decided together: a dropped element drops everything below it, and an
element stays only if it and its descendants gain by that; so no kept text lies in a dropped ancestor.

The classifier is fitted on ``PAGES`` made-up pages, a bounded sample that this module draws from a fixed seed: articles
in many kinds of markup between menus, headers, footers, sidebars, notices, adverts, forms and comments, whose labels are
known because they were made.  It is fitted once a driver and broadcast (a few thousand numbers).

Null and empty pages give an empty text.  Repeated rows give repeated results; an empty table an empty result; pages of
any length are read whole; other columns are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting
from .common import table
from .dom import FAMILIES, NUMBER, TAGS, Page

PAGES, SEED, NODES = 1200, 7, 20_000
_SHOWN = [NUMBER[t] for t in ("div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "table", "td", "blockquote", "pre", "figure", "button", "label", "body")]
_HEADINGS = [NUMBER[t] for t in ("h1", "h2", "h3", "h4", "h5", "h6")]
_ABOVE = [NUMBER[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table")]
_P = NUMBER["p"]
#: Bounds of an element's log-odds, and what its parent's count beside its own.
_CLIP, _COUPLING = 5.0, 0.4


def features(page: Page) -> np.ndarray:
    """(nodes, features) of a page."""
    tag, parent, end = (np.array(x, dtype=np.int64) for x in (page.tag, page.parent, page.end))
    n = len(tag)
    at = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[at]

    own, link = np.array(page.own, dtype=np.float64), np.array(page.link, dtype=np.float64)
    text, links, tags, paragraphs = below(own), below(link), below(np.array(page.tags_in, dtype=np.float64)), below((tag == _P).astype(np.float64))
    depth, index, children = (np.array(x, dtype=np.float64) for x in (page.depth, page.index, page.children))
    siblings = children[parent]
    pair = parent * 1000 + tag
    _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
    mask, above, above_tags = (np.array(x, dtype=np.int64) for x in (page.mask, page.above, page.above_tags))
    bits = np.arange(len(FAMILIES))
    cols = [
        *(tag == t for t in _SHOWN), np.isin(tag, _HEADINGS),
        *((mask[:, None] >> bits & 1).T), *((above[:, None] >> bits & 1).T), *((above_tags >> t & 1) for t in _ABOVE),
        depth, index, siblings, index / np.maximum(siblings, 1), count[place] / np.maximum(siblings, 1),
        np.log1p(own), np.log1p(text), links / np.maximum(text, 1), link / np.maximum(own, 1), np.log1p(tags), text / np.maximum(tags, 1), np.log1p(paragraphs),
        text / max(text[0], 1), text / np.maximum(text[parent], 1), at / n, own / np.maximum(text, 1), np.bincount(tag)[tag], np.full(n, np.log1p(text[0])),
    ]
    return np.stack(cols, axis=1).astype(np.float32)


def decide(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes stay; the root always does."""
    own, parent = np.array(page.own, dtype=np.float64), page.parent
    odds = np.clip(log_odds, -_CLIP, _CLIP)
    up = np.where(np.array(parent) > 0, odds[parent], 0)
    gain = ((odds + _COUPLING * up) * (1 + np.log1p(own))).tolist()
    for v in range(len(gain) - 1, 0, -1):
        if gain[v] > 0:
            gain[parent[v]] += gain[v]
    keep = [True] * len(gain)
    for v in range(1, len(gain)):
        keep[v] = keep[parent[v]] and gain[v] > 0
    return keep


# ---- made-up pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "ba ne ri to lu sa me di ko fa er an in on st th ou le re ve qui tion ment der sch ein que des".split()


class _Maker:
    """Draws pages; texts of articles are written between two marks, which ``example`` reads as labels."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(least, most))]
        for k in range(len(out)):
            if r.random() < 0.08:
                out[k] += r.choice([",", ".", ".", "###", "***", "!"])
        return " ".join(out).capitalize() + r.choice([".", ".", "", "!", "?"])

    def tag(self, names: str, classes: str = "", chance: float = 0.8) -> tuple[str, str]:
        r, name = self.r, self.r.choice(names.split())
        token = r.choice(classes.split()) if classes and (name in ("div", "section", "ul", "span") or r.random() < 0.3) else ""
        token = token if not token or r.random() < 0.7 else token + r.choice(["-main", "_box", "-wrap", " clearfix", "-1", " block"])
        attribute = f' {r.choice(["class", "class", "id"])}="{token}"' if token else ""
        return f"<{name}{attribute}>", f"</{name}>"

    def wrap(self, names: str, classes: str, inner: str) -> str:
        a, b = self.tag(names, classes)
        return a + inner + b

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.words(1, 1)}">{text or self.words(1, 4)}</a>'

    def links(self, least: int, most: int) -> str:
        items = [self.link() for _ in range(self.r.randint(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def mark(self, text: str) -> str:
        return f"\x01{text}\x02"

    def block(self) -> str:
        """One block of an article."""
        r, kind = self.r, self.r.random()
        text = self.words(*r.choice([(1, 3), (2, 12), (8, 40), (30, 90), (60, 300)]))
        if r.random() < 0.15:
            text += " " + self.link() + " " + self.words(2, 12)
        if r.random() < 0.1:
            text = "<b>" + text + "<br>"
        text = self.mark(text)
        if kind < 0.72:
            return f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}"
        if kind < 0.8:
            return f"<h{k}>{self.mark(self.words(2, 9))}</h{k}>" if (k := r.randint(2, 4)) else ""
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{self.mark(self.words(3, 25))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.89:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.mark(self.words(1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.95:
            return f"<pre>{text}</pre>"
        if kind < 0.97:
            return f'<figure><img src="x.jpg"><figcaption>{text}</figcaption></figure>'
        return f"<div>{text}</div>"

    def advert(self) -> str:
        return self.wrap("div div aside section", "ad ads advert advertisement sponsored promo ad-slot banner-ad", self.words(2, 40) if self.r.random() < 0.7 else f"<p>{self.words(3, 30)}</p>" + self.link())

    def inside(self) -> str:
        """What stands between an article's blocks and is no part of it."""
        return self.r.choice([
            self.advert, lambda: self.wrap("div ul", "share social sharing share-buttons", self.links(3, 6)),
            lambda: self.wrap("div aside section", "related recommended related-posts more", f"<h3>{self.words(1, 4)}</h3>" + self.links(3, 8)),
            lambda: self.wrap("div form", "newsletter subscribe signup", f"<p>{self.words(4, 20)}</p><form><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form>"),
            lambda: self.wrap("aside", "", f"<h4>{self.words(1, 4)}</h4><p>{self.words(5, 60)}</p>"),
        ])()

    def comments(self) -> str:
        r = self.r
        one = lambda: self.wrap("div li article", "comment comment-body reply comment-item", (f"<h4>{self.words(1, 2)}</h4>" if r.random() < 0.4 else "") + "".join(f"<p>{self.words(3, 90)}</p>" for _ in range(r.randint(1, 3))) + (self.link("Reply") if r.random() < 0.5 else ""))
        body = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.7) + "".join(one() for _ in range(r.randint(1, 7) if r.random() < 0.75 else r.randint(8, 25)))
        if r.random() < 0.4:
            body += f"<form><label>{self.words(1, 3)}</label><textarea></textarea><button>{self.words(1, 1)}</button></form>"
        return self.wrap("div section ol aside", "comments comment-list commentlist disqus respond discussion", body)

    def plain(self) -> str:
        """Text of a menu, header, footer, sidebar or notice: from a word to some sentences."""
        r = self.r
        return r.choice([lambda: self.words(1, 8), lambda: f"<p>{self.words(2, 40)}</p>", lambda: self.links(2, 9), lambda: f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}"])()

    def bare(self, story: str) -> str:
        """An article right in the body, alone or between a menu, a footer and comments."""
        chance = self.r.random
        before = self.wrap("nav div ul", "nav menu navigation", self.links(3, 9)) * (chance() < 0.4)
        after = (self.comments() if chance() < 0.3 else "") + self.wrap("footer div", "footer copyright", self.plain()) * (chance() < 0.4)
        return before + story + after if chance() < 0.5 else f"<html><body>{before}{story}{after}</body></html>"

    def page(self) -> str:
        r, chance = self.r, self.r.random
        some = lambda names, classes, inner: self.wrap(names, classes, inner)
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 6, 9, 14, 25]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.inside())
        head = f"<h1>{self.mark(self.words(2, 12))}</h1>" if chance() < 0.85 else ""
        if head and chance() < 0.15:
            head = f"<header>{head}</header>"
        if chance() < 0.25:
            head += self.wrap("div p span", "byline meta author post-meta date", self.words(2, 8))
        if chance() < 0.06:
            return self.bare(head * (chance() < 0.5) + "".join(blocks))
        body = head + "".join(blocks)
        if chance() < 0.2:
            body = self.wrap("div", "article-body entry-content post-content content text story-body", body)
        story = self.wrap("article article main div section", "article post entry content story main-content post-content entry-content", body)
        if chance() < 0.2:
            story = self.wrap("main div", "main content page-main", story)
        before, after = [], []
        if chance() < 0.8:
            before.append(some("nav nav div ul", "nav menu navbar navigation main-menu breadcrumb", self.links(3, 12)))
        if chance() < 0.6:
            before.append(some("header header div", "header masthead top-bar site-header", self.plain() + (f"<h1>{self.words(1, 4)}</h1>" if chance() < 0.2 else "")))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            (before if chance() < 0.6 else after).append(self.advert())
        for _ in range(r.choice([0, 1, 1])):
            (before if chance() < 0.5 else after).append(some("aside aside div", "sidebar widget side-bar rail", "".join(f"<h3>{self.words(1, 3)}</h3>{self.plain()}" for _ in range(r.randint(1, 4)))))
        if chance() < 0.4:
            (before if chance() < 0.5 else after).append(some("div section dialog", "cookie-notice cookie consent gdpr notice alert popup newsletter-popup", self.plain() + f"<p>{self.words(4, 50)}</p>" + "<button>OK</button>" * (chance() < 0.6)))
        if chance() < 0.35:
            (before if chance() < 0.6 else after).append(some("form div", "search-form login form contact-form", f"<form><label>{self.words(1, 4)}</label><input><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button><p>{self.words(3, 30)}</p></form>"))
        if chance() < 0.45:
            after.append(self.comments())
        r.shuffle(before)
        r.shuffle(after)
        if chance() < 0.85:
            after.append(some("footer footer div", "footer site-footer legal copyright", self.plain() + self.plain() * (chance() < 0.4)))
        inner = "".join(before) + story + "".join(after)
        if chance() < 0.3:
            inner = self.wrap("div", "wrapper page container site layout", inner)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{inner}</body></html>"


def example(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a made-up page: 1 for nodes with marked text in them."""
    marked, page = Page(html), Page(html.replace("\x01", "").replace("\x02", ""))
    hit = np.zeros(len(marked.tag) + 1)
    for node, text in marked.segments:
        hit[node] += "\x01" in text or "\x02" in text
    total = np.concatenate([[0], np.cumsum(hit)])
    label = (total[np.array(marked.end)] - total[: len(marked.tag)]) > 0
    return features(page), label.astype(np.float64)


@cache
def model(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    """The classifier; the same for the same arguments."""
    maker = _Maker(seed)
    x, y = (np.concatenate(a) for a in zip(*(example(maker.page()) for _ in range(pages)), strict=True))
    return boosting.fit(x, y)


def main_texts(htmls: list[str | None], trees: boosting.Trees) -> list[str]:
    """The main text of each page.  Pages are classified together up to ``NODES`` nodes, and dropped then."""
    out: list[str] = []
    pages: list[Page | None] = []
    nodes = 0
    for h in htmls:
        pages.append(Page(h) if h else None)
        nodes += len(pages[-1].tag) if h else 0
        if nodes >= NODES:
            out += _texts(pages, trees)
            pages, nodes = [], 0
    return out + _texts(pages, trees)


def _texts(pages: list[Page | None], trees: boosting.Trees) -> list[str]:
    x = [features(p) for p in pages if p]
    odds = iter(np.split(trees.log_odds(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])) if x else iter(())
    out = []
    for page in pages:
        if page is None:
            out.append("")
            continue
        keep = decide(page, next(odds))
        out.append("\n".join(text for node, text in page.segments if keep[node]))
    return out


def extract(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(made, f"page_id {kind}, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
