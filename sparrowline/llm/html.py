"""Main text of HTML pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes arrays: one entry per element in document order, one per piece of
text. Trees score every element by what it is called, holds and stands between; the
decoder then takes the best labelling in which no kept element lies in a dropped one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
HIDDEN = RAW | frozenset("head template svg canvas object select option button datalist audio video map math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
_ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption optgroup option".split())
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Pages whose elements are scored in one go.
_TOGETHER = 128

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORDS = re.compile(r"[a-z]+")

# Words of class, id and role values, by what they tell; the trees weigh them.
TOKEN_KINDS = {
    "main": "article articles body content contents entry main post posts story text page prose reader",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs tabs toolbar links skip pagination pager toc",
    "edge": "header head masthead top footer foot bottom copyright legal banner contentinfo logo site brand",
    "side": "sidebar side aside rail complementary widget widgets related recommended popular trending more tags share social",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion outbrain taboola",
    "notice": "cookie cookies consent notice notices alert popup modal overlay gdpr warning message subscribe newsletter signup paywall",
    "talk": "comment comments commentlist reply replies discussion disqus respond thread feedback review reviews",
}
_KIND_OF = {word: kind for kind, (name, words) in enumerate(TOKEN_KINDS.items()) for word in words.split()}
TAG_KINDS = (
    ("article",), ("main",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",),
    ("form", "fieldset", "label", "dialog"), ("section",), ("div", "center"), ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "tr", "td", "th"),
    ("a",), ("b", "i", "em", "strong", "span", "u", "small", "code", "font", "mark", "sub", "sup", "q", "cite", "abbr"),
    ("figure", "figcaption"), ("body", "html"),
)
_TAG_KIND = {tag: kind for kind, tags in enumerate(TAG_KINDS) for tag in tags}


class Page:
    """Elements in document order (``tags``, ``parents``, ``tokens``, ``ends``) and pieces of text.

    A piece is (element, block, text); ``ends`` is one past an element's last descendant.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.tokens, self.ends, self.depths = [], [], [], [], []
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self._open: list[int] = []
        self._read(source)
        self._close(0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._leave({"p"}, {"table", "body", "div", "article", "section", "li", "td"})
        if tag in _CLOSED_BY:
            self._leave(*_CLOSED_BY[tag])
        if tag in BLOCK or tag == "br":
            self.block += tag in BLOCK
        if tag == "br" and self._open:
            self.pieces.append((self._open[-1], self.block, " "))
        self.tags.append(tag)
        self.parents.append(self._open[-1] if self._open else -1)
        self.depths.append(len(self._open))
        told = [v for n, v in _ATTRIBUTE.findall(attributes) if n.lower() in ("class", "id", "role")] if attributes else ()
        self.tokens.append(tuple(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(told)).lower())))
        self.ends.append(len(self.tags))
        if tag not in VOID:
            self._open.append(len(self.tags) - 1)

    def _close(self, height: int) -> None:
        while len(self._open) > height:
            self.ends[self._open.pop()] = len(self.tags)

    def _leave(self, closed: set[str], until: set[str]) -> None:
        """Close the innermost open element of ``closed``, unless one of ``until`` lies deeper."""
        for height in range(len(self._open) - 1, -1, -1):
            tag = self.tags[self._open[height]]
            if tag in closed:
                self._close(height)
                return
            if tag in until:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        for height in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[height]] == tag:
                self._close(height)
                return

    def _text(self, text: str) -> None:
        if text:
            if not self._open:
                self._start("body", "")
            self.pieces.append((self._open[-1], self.block, text))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            mark = source.find("<", at)
            if mark < 0:
                self._text(source[at:])
                return
            self._text(source[at:mark])
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 2)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), mark):
                end = source.find(">", mark)
                at = n if end < 0 else end + 1
                continue
            name = _NAME.match(source, mark + 1)
            if not name:
                self._text("<")
                at = mark + 1
                continue
            end = self._tag_end(source, name.end())
            if end < 0:
                return
            tag = name[1].lower()
            at = end + 1
            if name[0][0] == "/":
                self._end(tag)
                continue
            self._start(tag, source[name.end() : end])
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                at = stop.start() if stop else n

    @staticmethod
    def _tag_end(source: str, at: int) -> int:
        """Place of the tag's ``>``, not looking into quoted values; -1 if the page ends first."""
        end = source.find(">", at)
        part = source[at:end] if end >= 0 else ""
        if end < 0 or ('"' not in part and "'" not in part):
            return end
        while True:
            found = _ATTRIBUTE.match(source, at)
            if not found or found.end() == at:
                return source.find(">", at)
            at = found.end()
            if source.startswith((">", "/>"), at) or not source[at : at + 1]:
                return source.find(">", at)


_SENTENCE = str.maketrans("", "", ".,;:!?")


def features(page: Page) -> np.ndarray:
    """One row per element: size, density and links of its subtree, place, names, parent, siblings."""
    n = len(page.tags)
    chars, words, linked, marks, pieces = (np.zeros(n) for _ in range(5))
    for element, _, text in page.pieces:
        found = len(text.split())
        chars[element] += len(text)
        words[element] += found
        marks[element] += len(text) - len(text.translate(_SENTENCE))
        pieces[element] += found > 0
    parents = np.array(page.parents)
    hidden = np.array([t in HIDDEN for t in page.tags])
    is_link = np.array([t == "a" for t in page.tags])
    kinds = np.zeros((n, len(TOKEN_KINDS)))
    tags = np.zeros((n, len(TAG_KINDS)))
    for i, (tag, tokens) in enumerate(zip(page.tags, page.tokens, strict=True)):
        for token in tokens:
            if token in _KIND_OF:
                kinds[i, _KIND_OF[token]] = 1
        if tag in _TAG_KIND:
            tags[i, _TAG_KIND[tag]] = 1
        if tag == "a" or (parents[i] >= 0 and is_link[parents[i]]):
            is_link[i] = True
        if parents[i] >= 0 and hidden[parents[i]]:
            hidden[i] = True
    for values in (chars, words, marks, pieces):
        values[hidden] = 0
    linked = np.where(is_link, chars, 0)
    ends = np.array(page.ends)
    place = np.arange(n)

    def whole(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[ends] - sums[place]

    all_chars, all_words, all_linked, all_marks = (whole(v) for v in (chars, words, linked, marks))
    blocks = whole(np.array([t in BLOCK for t in page.tags], float))
    controls = whole(np.array([t in ("input", "select", "button", "textarea") for t in page.tags], float))
    paragraphs = whole(np.array([t == "p" for t in page.tags], float))
    size = ends - place
    total = max(all_chars[0] if n else 0, 1)
    before = np.append(0, np.cumsum(chars))[place]
    up = np.maximum(parents, 0)
    children = np.bincount(up[parents >= 0], minlength=n).astype(float)
    order = np.zeros(n)
    met = np.zeros(n)
    for i in range(n):
        if parents[i] >= 0:
            order[i] = met[parents[i]]
            met[parents[i]] += 1
    above_kinds, above_tags = np.zeros_like(kinds), np.zeros_like(tags)
    for i in range(n):
        if parents[i] >= 0:
            above_kinds[i] = np.maximum(above_kinds[parents[i]], kinds[parents[i]])
            above_tags[i] = np.maximum(above_tags[parents[i]], tags[parents[i]])
    density = all_words / np.maximum(blocks, 1)
    links = all_linked / np.maximum(all_chars, 1)
    siblings = np.maximum(children[up], 1)
    base = np.column_stack(
        [
            np.array(page.depths, float), np.log1p(all_chars), links, density, all_marks / np.maximum(all_words, 1),
            all_chars / total, children, order / siblings, siblings, before / total, paragraphs, controls,
            np.log1p(all_chars[up]), links[up], density[up], all_chars[up] / siblings, paragraphs[up], all_chars / size,
        ]
    )
    # Where the page names its main part: is this element in it, around it, or elsewhere?
    placed = []
    for at, above in ((tags[:, :2].max(axis=1), above_tags[:, :2].max(axis=1)), (kinds[:, 0], above_kinds[:, 0])):
        around, inside = whole(at) > 0, np.maximum(at, above) > 0
        placed += [around, inside, (at.max() > 0) & ~around & ~inside]
    return np.column_stack([base, *placed, kinds, above_kinds, tags, above_tags])


class Trees:
    """Gradient-boosted regression trees for log loss, on binned features; each tree sees every ``shares``-th row."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 10, shares: int = 3):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shares = rounds, depth, rate, bins, least, shares
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        score = np.full(len(y), self.base)
        for turn in range(self.rounds):
            chance = 1 / (1 + np.exp(-score))
            some = slice(turn % self.shares, None, self.shares)
            tree = self._grow(binned[some], cuts, (y - chance)[some], (chance * (1 - chance))[some])
            self.trees.append(tree)
            score += self._leaves(tree, x)
        return self

    def _grow(self, binned, cuts, slope, curve):
        """Arrays (feature, cut, value) of a complete tree; feature -1 passes to the left."""
        nodes = 2 ** (self.depth + 1) - 1
        many = np.array([len(c) for c in cuts])
        flags, wide = np.flatnonzero(many == 1), np.flatnonzero(many > 1)
        raised = binned[:, flags].astype(np.float32)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(slope), int)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            g, h = slope[rows], curve[rows]
            value[node] = self.rate * g.sum() / (h.sum() + 1)
            if node >= nodes // 2 or len(rows) < 2 * self.least:
                at[rows] = 2 * node + 1 if node < nodes // 2 else node
                if node < nodes // 2:
                    value[2 * node + 1 : 2 * node + 2] = value[node]
                continue
            best = (1e-6, -1, 0)
            weights = np.column_stack([g, h, np.ones(len(rows))])
            whole = g.sum() ** 2 / (h.sum() + 1)

            def gain(low: np.ndarray) -> np.ndarray:
                """Gain of cuts whose lower sides have these sums of slope, curve and rows."""
                fits = (low[..., 2] >= self.least) & (len(rows) - low[..., 2] >= self.least)
                parts = low[..., 0] ** 2 / (low[..., 1] + 1) + (g.sum() - low[..., 0]) ** 2 / (h.sum() - low[..., 1] + 1)
                return np.where(fits, parts, -1) - whole

            if len(flags):
                gains = gain(weights.sum(axis=0) - (raised[rows].T @ weights.astype(np.float32)).astype(float))
                best = max(best, (gains.max(), int(flags[gains.argmax()]), 0))
            for f in wide:
                b = binned[rows, f]
                low = [np.cumsum(np.bincount(b, w, len(cuts[f]) + 1))[:-1] for w in weights.T]
                gains = gain(np.column_stack(low))
                best = max(best, (gains.max(), int(f), int(gains.argmax())))
            if best[1] < 0:
                at[rows] = 2 * node + 1
                continue
            feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
            at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        return feature, cut, value

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
            at = 2 * at + 1 + right
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        return self.base + sum((self._leaves(tree, x) for tree in self.trees), np.zeros(len(x)))


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Which elements are kept: the most likely labelling without a kept element in a dropped one.

    Bottom up, an element is worth keeping if its log odds and what its children are
    then worth add up to more than nothing; top down, what is dropped takes all it holds.
    """
    worth = score.copy()
    for i in range(len(worth) - 1, 0, -1):
        if page.parents[i] >= 0 and worth[i] > 0:
            worth[page.parents[i]] += worth[i]
    kept = worth > 0
    for i, parent in enumerate(page.parents):
        if page.tags[i] in HIDDEN or (parent >= 0 and not kept[parent]):
            kept[i] = False
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    """Kept text: a line per block, white space made single, character references decoded."""
    lines, block, parts = [], None, []
    for element, number, text in [*page.pieces, (-1, None, "")]:
        if number != block:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                lines.append(line)
            block, parts = number, []
        if element >= 0 and kept[element]:
            parts.append(text)
    return "\n".join(lines)


def extract_all(sources: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page; empty for null. All elements are scored together."""
    pages = [Page(source or "") for source in sources]
    rows = [features(page) for page in pages if page.tags]
    scores = trees.score(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page in pages:
        score = scores[at : at + len(page.tags)]
        out.append(text_of(page, decode(page, score)) if page.tags else "")
        at += len(page.tags)
    return out


def extract(source: str | None, trees: Trees) -> str:
    return extract_all([source], trees)[0]


def main_text(source: Column, trees: Trees) -> Column:
    """``extract`` of every row: whole pages, however long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            texts = []
            for at in range(0, len(pages), _TOGETHER):
                texts += extract_all(pages.slice(at, _TOGETHER).to_pylist(), trees)
            yield pa.array(texts, pa.string())

    return F.arrow_udf(run, "string")(source)


def extract_pages(pages: DataFrame, trees: Trees, *, source: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; the column ``source`` is dropped.

    A null or empty page has an empty text, every row is read by itself, and pages cut
    off anywhere are read to their end. Columns named like an output column are replaced.
    """
    passed = [name for name in pages.columns if name not in (source, "text", "n_chars")]
    read = pages.select(*passed, main_text(F.col(source), trees).alias("text"))
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
