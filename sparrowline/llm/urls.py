"""URL filter: rules for hosts and paths, and a classifier for what no rule fits.

Host names run words together. A unigram model, counted over all documents, splits
them (Viterbi); multinomial naive Bayes, fitted on labelled documents and a list of
telling names, then scores the words of host and path.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowline.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONGEST = 24
_OUT = 1 << 16

# Names that tell of pages to block; each counts like a hundredth of all words of blocked text.
BLOCK_WORDS = (
    "adult", "ads", "adserver", "bets", "betting", "casino", "cheap", "escort", "farm", "free", "gambling",
    "jackpot", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "track", "tracker",
    "viagra", "warez", "win", "xxx",
)
# Parts of names that say nothing about a page.
PLAIN_WORDS = ("www", "blog", "m", "com", "net", "org", "html", "example")


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits, or null; of equals, block wins."""
    best = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in reversed(best):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


@dataclass
class Model:
    """Word counts: of all text (``words``), and of labelled text by class.

    The words this module names count ``least`` times at least, so that names are split
    at them. Where ``counts`` (word, n) is given, ``words`` is only what the driver holds of it:
    ``judge_urls`` splits names by all of it, and ``total`` is its sum.
    """

    words: dict[str, int]
    blocked: dict[str, int]
    allowed: dict[str, int]
    least: int = 200
    threshold: float = 3.0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    total: int = 0
    counts: DataFrame | None = None

    def __post_init__(self):
        self.words = {**self.words}
        for word in BLOCK_WORDS + PLAIN_WORDS:
            self.words[word] = max(self.words.get(word, 0), self.least)
        self.total = self.total or sum(self.words.values()) or 1
        blocked = {**self.blocked}
        telling = max(3, sum(blocked.values()) // 100)
        for word in BLOCK_WORDS:
            blocked[word] = blocked.get(word, 0) + telling
        vocabulary = blocked.keys() | self.allowed.keys()
        n_blocked = sum(blocked.values()) + len(vocabulary)
        n_allowed = sum(self.allowed.values()) + len(vocabulary)
        self.odds = {
            w: math.log((blocked.get(w, 0) + 1) / n_blocked) - math.log((self.allowed.get(w, 0) + 1) / n_allowed)
            for w in vocabulary
        }

    def cost(self, word: str) -> float:
        count = self.words.get(word)
        # Unknown stretches cost more the longer they are, but less than their letters one by one.
        return math.log(self.total / count) if count else math.log(self.total) + 2.3 * len(word)

    def segment(self, name: str) -> tuple[str, ...]:
        """The cheapest split of a name into words of up to ``_LONGEST`` letters (ties: the longest last word)."""
        if name not in self.known:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            best, last = [0.0], [0]
            for end in range(1, len(name) + 1):
                cost, at = min((best[a] + self.cost(name[a:end]), a) for a in range(max(0, end - _LONGEST), end))
                best.append(cost)
                last.append(at)
            out, end = [], len(name)
            while end:
                out.append(name[last[end] : end])
                end = last[end]
            self.known[name] = tuple(reversed(out))
        return self.known[name]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host's names, and of the path's without its numbers."""
        return [word for name in names(host, path) for word in self.segment(name)]

    def score(self, host: str, path: str) -> float:
        """Log odds that a page is to be blocked, without the classes' shares."""
        return sum(self.weight(self.segment(name)) for name in names(host, path))

    def weight(self, split: tuple[str, ...]) -> float:
        """Log odds that the words of a name add."""
        return sum(self.odds.get(word, 0.0) for word in split if word not in PLAIN_WORDS)


def names(host: str, path: str) -> list[str]:
    """The host's names, and the path's without its numbers."""
    return re.findall(r"[^\W_]+", host) + [n for n in re.findall(r"[^\W_]+", path.lower()) if not n.isdigit()]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n``: how often all texts hold each word of two letters or more, lower-cased."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}{2,}"), F.lit(0))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, *, vocabulary: int = 50_000, sample: int = 2_000) -> Model:
    """Count words over all of ``docs`` (doc_id, text), and by class over labelled ones.

    All counts stay in a table, ``Model.counts``, and the driver holds the ``vocabulary`` most
    frequent of them. Classes are counted on the ``sample`` labelled documents that come first
    in the order of a hash of their id, with ``toxic`` or not ``quality`` to block, and keep
    ``vocabulary`` words; both bounds are of the labelled sample. Nulls in labels or texts
    count as unlabelled.
    """
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    chosen = labels.filter("doc_id IS NOT NULL").select("doc_id", bad).filter("bad IS NOT NULL").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0)))
    by_class = held.select("bad", F.explode(words).alias("word")).groupBy("word")
    by_class = by_class.agg(F.count(F.when(F.col("bad"), 1)).alias("b"), F.count(F.when(~F.col("bad"), 1)).alias("a"))
    counts = materialise(count_words(docs), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toPandas()
    own = {w: int(n) for w, n in counts.filter(F.col("word").isin(*BLOCK_WORDS, *PLAIN_WORDS)).collect()}
    telling = by_class.orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(vocabulary).toPandas()
    model = Model(
        {**own, **dict(zip(most["word"], most["n"].astype(int).tolist(), strict=True))},
        {w: n for w, n in zip(telling["word"], telling["b"].astype(int).tolist(), strict=True) if n},
        {w: n for w, n in zip(telling["word"], telling["a"].astype(int).tolist(), strict=True) if n},
        counts=counts,
    )
    # Named words count more than the texts say.
    model.total = int(total) + sum(model.words[w] - own.get(w, 0) for w in {*BLOCK_WORDS, *PLAIN_WORDS})
    return model


def block_score(host: Column, path: Column, model: Model) -> Column:
    """``Model.score`` of every row."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([model.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(host, path)


def _with_all_counts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``host``, ``path``) with ``block_score``, names split by all of ``model.counts``.

    Each distinct name gets the counts of its own substrings, so no task holds more of them.
    """
    own = {w: model.words[w] for w in BLOCK_WORDS + PLAIN_WORDS}
    model_ = replace(model, words=own, known={}, counts=None)

    @F.pandas_udf("array<string>")
    def named(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([names(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["name"]:
                cuts = {name[a:b] for a in range(len(name)) for b in range(a + 2, min(len(name), a + _LONGEST) + 1)}
                out += [(name, cut) for cut in cuts if cut.isalpha()]
                if len(out) >= _OUT:
                    yield pd.DataFrame(out, columns=["name", "word"])
                    out = []
            yield pd.DataFrame(out, columns=["name", "word"])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = []
            for name, held in zip(batch["name"], batch["held"], strict=True):
                model_.known.clear()
                model_.words = {**{h["word"]: h["n"] for h in (held if held is not None else ())}, **own}
                weights.append(float(model_.weight(model_.segment(name))))
            yield pd.DataFrame({"name": batch["name"], "weight": weights})

    found = rows.select("host", "path").distinct().select("host", "path", F.posexplode(named("host", "path")).alias("at", "name"))
    found = materialise(found, "url-names")
    distinct = materialise(found.select("name").distinct(), "url-distinct")
    held = distinct.mapInPandas(parts, "name string, word string").join(model.counts, "word")
    held = held.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    weights = distinct.join(held, "name", "left").select("name", "held").mapInPandas(weigh, "name string, weight double")
    weights = materialise(weights, "url-weights")
    scores = found.join(weights, "name").groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("_w"))
    total = F.aggregate("_w", F.lit(0.0), lambda sum_, w: sum_ + w["weight"])
    scores = materialise(scores.select("host", "path", total.alias("block_score")), "url-scores")
    joined = rows.join(scores, ["host", "path"], "left")
    return joined.withColumn("block_score", F.coalesce("block_score", F.lit(0.0)))


def judge_urls(pages: DataFrame, model: Model, rules: tuple[Rule, ...], *, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    The longest rule that fits gives the verdict; else a page whose score is over the
    model's threshold is blocked. A null url, or one without ``://``, has empty host and
    path, fits no rule and is allowed. Every row is judged by itself, repeated or not;
    columns named like an output column are replaced.
    """
    passed = [name for name in pages.columns if name not in ("host", "path", "rule", "verdict", "block_score")]
    rows = pages.select(*passed, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    if model.counts is None:
        rows = rows.withColumn("block_score", block_score(F.col("host"), F.col("path"), model))
    else:
        rows = _with_all_counts(rows, model)
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    guess = F.when(F.col("block_score") > F.lit(model.threshold), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        *passed, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", guess).alias("verdict"), "block_score"
    )
