"""Registered queries: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowline.functions.binding import with_computed
from sparrowline.llm import (
    alignment,
    bpe,
    html,
    html_training,
    lines,
    mixing,
    passages,
    prefixes,
    quality,
    runs,
    shingles,
    suffixes,
    topk,
    urls,
)
from sparrowline.llm.shared import sha256, table
from sparrowline.session import materialise

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
MIX_CYCLE = (5.0, 2.0, 1.0)
MIX_EPOCHS = 3.0
POLICY = quality.V2
LINE_DOCS = 10
RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = materialise(docs, "op1-sizes")
    mixed = mixing.mix_sources(docs, mixing.cyclic(MIX_CYCLE), size=F.col("size"), max_epochs=MIX_EPOCHS)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = bpe.load(public_tokenizers.path(TOKENIZER))
    both = bpe.round_trip(F.col("text"), definition).alias("both")
    return table(spark, sf_dir, "documents").select("doc_id", both).select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("both.ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("both.decoded")).alias("decoded_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("failed_bits")
    return entries.select(
        "doc_id",
        *[name for name in quality.MEASURES if name != "n_lines"],
        (~quality.passes(quality.BASE, bits)).alias("base_failed"),
        quality.passes(POLICY, bits).alias("kept"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    trees = html_training.fit(pages)
    return html.extract_pages(pages.select("page_id", "url", "html"), trees)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of unchanged texts are made in place: only their 32 bytes move."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffixes.changed_documents(docs, length=100)
    cut = cut.select("_id", "_digest", "n_removed", "spans", sha256(F.col("kept")).alias("kept_sha256"))
    text = suffixes.text_bytes("text")
    rows = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), sha256(text).alias("_whole"), F.xxhash64(text).alias("_of")
    )
    return suffixes.with_changes(rows, cut).select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=LINE_DOCS)
    return cleaned.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed span of words; documents without one have no row."""
    return passages.removed_spans(passages.repeated_passages(table(spark, sf_dir, "documents")))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.join_shingles(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = prefixes.load(public_tokenizers.path(RANKS))
    both = prefixes.round_trip(F.col("text"), ranks, public_tokenizers.PATTERN)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", both.alias("both"))
        .select(
            "doc_id",
            (F.octet_length("both.ids") / 4).cast("long").alias("n_tokens"),
            sha256(F.col("both.ids")).alias("ids_sha256"),
            sha256(F.col("both.decoded")).alias("decoded_sha256"),
        )
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = bpe.load(public_tokenizers.path(TOKENIZER))
    pieces = prefixes.load(public_tokenizers.path(PIECES))
    return alignment.align(table(spark, sf_dir, "documents"), definition, pieces)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a planted periodic tail (``runs.repeat_tails``) and all others."""
    docs = runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # Bound before lambdas look at it: a Python result cannot be taken inside them.
    found = with_computed(docs, found=runs.find_runs(F.col("text"))).select("doc_id", "found.*")
    best = F.col("best")
    return found.withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256(runs.lines_of(F.col("runs"))).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_text": op4_html_text,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_shingle_join": op9_shingle_join,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

# Words, counted in SQL: the characters between them are space and \x09 to \x0D.
_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_quality_rules": rf"""
        WITH worded AS (
            SELECT doc_id, coalesce(text, '') AS text, {_SQL_WORDS} AS w FROM documents),
        windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
                   unnest(list_transform(range(1, len(w) - 1), lambda k: [w[k], w[k + 1], w[k + 2]])) AS win
            FROM worded),
        again AS (
            SELECT doc_id, i FROM windows
            QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS s(d) GROUP BY doc_id),
        cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded),
        lined AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
            FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        measured AS (
            SELECT doc_id, len(w) AS n_words,
                   coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words
            FROM worded LEFT JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (10 * n_symbols > n_words)
                   AND NOT (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) AS kept
        FROM judged""",
    "op6_line_dedup": r"""
        WITH cut AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
        often AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often o USING (key) GROUP BY doc_id""",
    "op7_exact_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
    "op9_shingle_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
            FROM worded),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b USING (s)
            WHERE a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached AS (
            SELECT x AS doc_id, x AS root FROM ways
            UNION
            SELECT ways.y, root FROM reached JOIN ways ON ways.x = reached.doc_id)
        SELECT w.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, coalesce(min(root), w.doc_id) AS component_id
        FROM worded w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r USING (doc_id) GROUP BY w.doc_id""",
    "op13_periodic_runs": r"""
        WITH worded AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce(
                       list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(
                           list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda r, step: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) AS h
            FROM documents),
        places AS (
            SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM worded),
        edited AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
                       w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
            FROM places),
        words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM edited),
        equal AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word
            WHERE y.i > x.i AND y.i - x.i <= x.n // 4),
        islands AS (
            SELECT doc_id, q, min(i) AS s, count(*) + q AS l
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
            GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (
            SELECT * FROM islands r WHERE NOT EXISTS (
                FROM islands o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
        best AS (
            SELECT doc_id, s, l, q FROM runs
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
        told AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
            FROM runs GROUP BY doc_id),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, l AS length, q AS period,
               (1000 * l) // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
