"""Labelled pages for the trees of ``html``: the table's own, and their texts laid out anew.

Pages that mark their article up (``article`` or ``main``) give labels by themselves. So
that the trees also learn pages that do not, the texts of such pages are put into
other layouts, drawn from a seeded generator: with and without telling names, with
menus, notices, adverts, side columns, forms and reader comments.
"""

from __future__ import annotations

import html
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowline.llm.html import Page, Trees, features, text_of

_KEEP, _DROP = "zzkeep", "zzdrop"
_DROPPED_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_DROPPED_NAMES = {"ad", "ads", "advert", "sidebar", "comments", "comment", "cookie", "promo", "share", "related"}


def labels(page: Page) -> np.ndarray | None:
    """1 for elements that hold or lie in the main text, by marks or by markup; None if there is none."""
    n = len(page.tags)
    state = np.zeros(n, int)
    marked = any(_KEEP in tokens for tokens in page.tokens)
    for i in range(n):
        above = state[page.parents[i]] if page.parents[i] >= 0 else 0
        tokens = set(page.tokens[i])
        if marked:
            keep, drop = _KEEP in tokens, _DROP in tokens
        else:
            keep = page.tags[i] in ("article", "main")
            drop = above == 1 and (page.tags[i] in _DROPPED_TAGS or bool(tokens & _DROPPED_NAMES))
        state[i] = -1 if above == -1 or drop else 1 if keep or above == 1 else 0
    if not (state == 1).any():
        return None
    sums = np.append(0, np.cumsum(state == 1))
    holds = sums[np.array(page.ends)] > sums[np.arange(n)]
    return np.where(state == -1, 0, (state == 1) | holds).astype(float)


class Layouts:
    """Draws pages around given paragraphs."""

    def __init__(self, paragraphs: list[str], links: list[str], seed: int):
        self.random = random.Random(seed)
        self.paragraphs, self.links = paragraphs, links

    def _element(self, tag: str, inner: str, names: str = "", mark: str = "", told: bool = True) -> str:
        names = f"{names if told else ''} {mark}".strip()
        return f'<{tag} class="{names}">{inner}</{tag}>' if names else f"<{tag}>{inner}</{tag}>"

    def some_of(self, lines: list[str]) -> list[str]:
        """Up to a dozen of the lines; now and then only a few words."""
        if self.random.random() < 0.2:
            return [" ".join(lines[0].split()[: self.random.randint(1, 8)])]
        return lines[: self.random.randint(1, 12)]

    def _pick(self, *values):
        return self.random.choice(values)

    def _some(self, low: int, high: int, kind: str = "p", of: list[str] | None = None) -> str:
        chosen = [self._pick(*(of or self.paragraphs)) for _ in range(self.random.randint(low, high))]
        return "".join(f"<{kind}>{html.escape(text)}</{kind}>" for text in chosen)

    def _link_list(self, low: int, high: int) -> str:
        names = [html.escape(self._pick(*self.links)) for _ in range(self.random.randint(low, high))]
        anchors = [f'<a href="/{i}">{name}</a>' for i, name in enumerate(names)]
        if self.random.random() < 0.3:
            return self._pick(" | ", " ", " &middot; ").join(anchors)
        return "<ul>" + "".join(f"<li>{a}</li>" for a in anchors) + "</ul>"

    def _short(self, words: int = 12) -> str:
        return html.escape(" ".join(self._pick(*self.paragraphs).split()[: self.random.randint(1, words)]))

    def _form(self, told: bool, mark: str) -> str:
        fields = f'<label>{self._short(4)}</label><input name="q"><button>{self._short(2)}</button>'
        return self._element("form", fields, self._pick("search", "newsletter subscribe", "signup form", "login"), mark, told)

    def _advert(self, told: bool) -> str:
        inner = self._pick(self._short(25), f'<a href="/x">{self._short(15)}</a>', f"<p>{self._short(25)}</p>")
        return self._element(self._pick("div", "aside", "ins"), inner, self._pick("ad", "advert", "ad banner", "sponsored", "promo box"), _DROP, True)

    def _comments(self, mark: str) -> str:
        tag = self._pick("div", "li", "article", "section")
        one = lambda: self._element(tag, f"<b>{self._short(2)}</b>{self._some(1, 2)}", self._pick("comment", "reply", "comment-body"))
        inner = self._pick("", f"<h3>{self._short(3)}</h3>") + "".join(one() for _ in range(self.random.randint(1, 6)))
        if self.random.random() < 0.4:
            inner += self._form(True, "")
        return self._element(self._pick("div", "section", "ol", "aside"), inner, self._pick("comments", "comment-list", "discussion", "responses comments"), mark)

    def _article(self, title: str, paragraphs: list[str], told: bool) -> str:
        kind = self.random.random()
        inner = [f"<h1>{html.escape(title)}</h1>"] if self.random.random() < 0.8 else []
        for i, text in enumerate(paragraphs):
            safe = html.escape(text)
            if self.random.random() < 0.1:
                words = safe.split()
                safe = " ".join([*words[:2], f'<a href="/l">{" ".join(words[2:4])}</a>', *words[4:]])
            draw = self.random.random()
            if draw < 0.06:
                inner.append(f"<h2>{self._short(6)}</h2>")
            elif draw < 0.1:
                inner.append(f"<blockquote><p>{safe}</p></blockquote>")
                continue
            elif draw < 0.18:
                inner.append("<ul>" + "".join(f"<li>{self._short(8)}</li>" for _ in range(self.random.randint(2, 5))) + "</ul>")
            elif draw < 0.24 and i:
                inner.append(self._advert(told))
            elif draw < 0.27 and i:
                inner.append(self._element(self._pick("div", "aside", "section"), self._link_list(2, 5), self._pick("related", "share social", "more"), _DROP))
            elif draw < 0.29 and i:
                inner.append(self._form(told, _DROP))
            inner.append(f"<div>{safe}</div>" if kind < 0.1 else f"<p>{safe}" if kind < 0.2 else f"<p>{safe}</p>")
        tag = self._pick("article", "article", "div", "div", "section", "main", "td")
        names = self._pick("content", "post", "entry-content", "article-body", "story", "main text", "post-content", "page")
        body = self._element("div" if tag == "td" else tag, "".join(inner), names, _KEEP, told)
        if tag == "td":
            body = f"<table><tr><td>{body}</td></tr></table>"
        return self._pick(body, body, self._element("main", body), self._element("div", body, self._pick("wrapper", "container", "row")))

    def page(self, title: str, paragraphs: list[str]) -> str:
        told = self.random.random() < 0.75
        named = self.random.random() < 0.5
        parts = []
        if self.random.random() < 0.3:
            text = self._pick(f"<p>{self._short(30)}</p><button>{self._short(1)}</button>", self._short(30))
            parts.append(self._element(self._pick("div", "section", "aside"), text, self._pick("cookie-notice", "notice", "consent banner", "alert", "gdpr"), _DROP))
        if self.random.random() < 0.8:
            inner = self._pick(f'<a href="/">{self._short(3)}</a>', f"<h2>{self._short(3)}</h2><p>{self._short(8)}</p>", f"<p>{self._short(12)}</p>")
            parts.append(self._element("header" if named else "div", inner, self._pick("header", "masthead", "site-header", "top"), _DROP, told))
        if self.random.random() < 0.85:
            parts.append(self._element("nav" if named else self._pick("div", "ul"), self._link_list(3, 9), self._pick("menu", "nav", "navbar", "main-menu"), _DROP, told))
        if self.random.random() < 0.4:
            parts.append(self._advert(told))
        body = [self._article(title, paragraphs, told)]
        if self.random.random() < 0.5:
            side = self._pick(self._link_list(3, 8), f"<h3>{self._short(3)}</h3>{self._link_list(2, 6)}", f"<h3>{self._short(3)}</h3><p>{self._short(20)}</p>")
            side = self._element("aside" if named else "div", side, self._pick("sidebar", "side", "widget", "rail"), _DROP, told)
            body.insert(self._pick(0, 1), side)
        if self.random.random() < 0.45:
            body.append(self._comments(_DROP))
        inner = "".join(body)
        parts.append(self._pick(inner, self._element("div", inner, self._pick("wrapper", "container", "page"), "", told)))
        if self.random.random() < 0.3:
            parts.append(self._form(told, _DROP))
        if self.random.random() < 0.9:
            inner = self._pick(f"&copy; {self._short(8)}", f"<p>{self._short(15)}</p>", self._link_list(2, 6), f"<p>&copy; {self._short(6)}</p>{self._link_list(2, 4)}")
            parts.append(self._element("footer" if named else "div", inner, self._pick("footer", "site-footer", "bottom", "copyright"), _DROP, told))
        head = f"<head><title>{html.escape(title)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(parts)}</body></html>"


def examples(sources: list[str], layouts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of given pages and of ``layouts`` new ones for each."""
    own, texts, links = [], [], ["home", "about", "contact", "news"]
    for source in sources:
        page = Page(source)
        known = labels(page) if page.tags else None
        if known is None:
            continue
        own.append((page, known))
        texts.append(text_of(page, (known > 0) & np.array([t not in ("html", "body") for t in page.tags])).split("\n"))
        links += [text for element, _, text in page.pieces if page.tags[element] == "a"]
    paragraphs = [p for lines in texts for p in lines if len(p.split()) > 3]
    rows = list(own)
    if paragraphs:
        maker = Layouts(paragraphs, links, seed)
        for lines in texts:
            for _ in range(layouts):
                page = Page(maker.page(lines[0][:80], maker.some_of(lines[1:] or lines)))
                known = labels(page)
                if known is not None:
                    rows.append((page, known))
    if not rows:
        return np.zeros((0, 1)), np.zeros(0)
    return np.concatenate([features(page) for page, _ in rows]), np.concatenate([known for _, known in rows])


def labelled(source: str) -> bool:
    """Whether a page gives labels."""
    page = Page(source)
    return bool(page.tags) and labels(page) is not None


def fit(
    pages: DataFrame, *, source: str = "html", key: str = "page_id", sample: int = 300, longest: int = 100_000, layouts: int = 2,
    seed: int = 11,
) -> Trees:
    """Trees fitted on the ``sample`` labelled pages that come first in the order of a hash of ``key``.

    Pages of more than ``longest`` characters are not sampled, nor are those without an
    ``article`` or ``main`` element, which give no labels. The sample is the only part of the
    table that reaches the driver. If no page gives labels, everything is kept.
    """
    marked = F.col(source).rlike(r"(?i)<(article|main)")
    able = pages.filter((F.char_length(source) <= longest) & marked)
    able = able.select(F.xxhash64(key).alias("_order"), F.col(source).alias("_page"))
    first = lambda rows: [row["_page"] for row in rows.orderBy("_order", "_page").limit(sample).collect()]
    chosen = first(able)
    if not all(map(labelled, chosen)):
        # A comment or a script may hold the tag as well: only then every such page is parsed.
        chosen = first(able.filter(F.udf(labelled, "boolean")("_page")))
    x, y = examples(chosen, layouts, seed)
    trees = Trees()
    if not len(y):
        trees.base = 1.0
        return trees
    return trees.fit(x, y)
