"""Documents, chunks, embeddings and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import sql_strip, sql_words, table
from sparrowline.functions.embedders import hashed
from sparrowline.operators import documents as ops
from sparrowline.operators.embedding import check_index_model, embed_texts, index_models
from sparrowline.plans.index_build import build_index
from sparrowline.session import work_path
from sparrowline.sources import documents as doc_sources
from sparrowline.sources import files
from sparrowline.sources import index as index_source

DIM = 256


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def turns_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation read as a document: its turns are the pages, and the
    system turns are pages without text."""
    text = F.when(F.col("role") != "system", F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text")
    )


def scan_documents(spark, sf_dir):
    """Pages written as files below the work folder, and read by byte ranges."""
    path = work_path(spark, "page-files")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name")
    files.write_files(table(spark, sf_dir, "pages").select(name, F.encode("html", "UTF-8").alias("content")), path)
    page_id = F.regexp_extract("path", r"(-?[0-9]+)\.html$", 1).cast("bigint").alias("page_id")
    return files.read_pages(spark, path, "*.html").select(page_id, "page", "text")


def assemble_pages(spark, sf_dir):
    return ops.assemble_pages(turns_as_pages(spark, sf_dir), docs(spark, sf_dir))


def raw_text_roundtrip(spark, sf_dir):
    path = work_path(spark, "raw-text")
    doc_sources.write_raw_text(docs(spark, sf_dir), path)
    return doc_sources.read_raw_text(spark, path)


def chunk_fixed(spark, sf_dir):
    return ops.chunk_fixed(docs(spark, sf_dir))


def chunk_overlap(spark, sf_dir):
    return ops.chunk_overlapping(docs(spark, sf_dir))


def chunk_recursive(spark, sf_dir):
    return ops.chunk_recursive(docs(spark, sf_dir))


def chunk_pages(spark, sf_dir):
    return ops.chunk_pages(turns_as_pages(spark, sf_dir))


def wrap_chunks(spark, sf_dir):
    wrapped = ops.wrap_chunks(ops.chunk_fixed(docs(spark, sf_dir)))
    return wrapped.select("doc_id", "pos", F.col("document.page_content").alias("page_content"))


def split_tokens(spark, sf_dir):
    return ops.split_words(docs(spark, sf_dir))


def sparse(df: DataFrame, keys: list[str]) -> DataFrame:
    """The non-zero places of the vectors, as rows."""
    return df.select(*keys, F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0").withColumn(
        "weight", F.round(F.col("weight").cast("double"), 6)
    )


def embed(spark, sf_dir):
    return sparse(embed_texts(ops.chunk_fixed(docs(spark, sf_dir)), hashed(DIM), "chunk"), ["doc_id", "pos"])


def index_build(spark, sf_dir):
    """Pages to documents to chunks to a stored index; the second run adds nothing."""
    path, raw = work_path(spark, "index"), work_path(spark, "raw-text")
    for _ in range(2):
        build_index(turns_as_pages(spark, sf_dir), hashed(DIM), path, raw)
    return index_source.read_index(spark, path).select("chunk_id", "doc_id", "pos", "chunk", "dim", "model")


def index_update(spark, sf_dir):
    """An index of other texts, cut to another size, then built again from the documents."""
    path, raw = work_path(spark, "index"), work_path(spark, "raw-text")
    pages = docs(spark, sf_dir).withColumn("page", F.lit(0))
    older = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" as it was"))).otherwise(F.col("text"))
    build_index(pages.withColumn("text", older), hashed(DIM), path, raw, size=700)
    for _ in range(2):
        build_index(pages, hashed(DIM), path, raw)
    return sparse(index_source.read_index(spark, path), ["chunk_id", "doc_id", "pos", "chunk", "dim", "model"])


def index_open(spark, sf_dir):
    """No index yet: it is built from the raw texts by the recursive splitter."""
    raw = work_path(spark, "raw-text")
    doc_sources.write_raw_text(docs(spark, sf_dir), raw)
    opened = index_source.index_open(spark, work_path(spark, "index"), raw, hashed(DIM))
    return opened.select("chunk_id", "doc_id", "pos", "chunk", "dim", "model")


def check_model(spark, sf_dir):
    index = index_source.index_rows(ops.chunk_fixed(docs(spark, sf_dir)), hashed(DIM))
    return index_models(check_index_model(index, hashed(DIM)))


QUERIES = {
    "scan_documents": scan_documents,
    "assemble_pages": assemble_pages,
    "raw_text_roundtrip": raw_text_roundtrip,
    "chunk_fixed": chunk_fixed,
    "chunk_overlap": chunk_overlap,
    "chunk_recursive": chunk_recursive,
    "chunk_pages": chunk_pages,
    "wrap_chunks": wrap_chunks,
    "split_tokens": split_tokens,
    "embed_texts": embed,
    "index_build": index_build,
    "index_update": index_update,
    "index_open": index_open,
    "check_index_model": check_model,
}

SQL_PAGES = """SELECT conv_id AS doc_id, turn AS page, CASE WHEN role <> 'system' THEN text ELSE '' END AS text
    FROM conversations"""

SQL_PAGE_DOCS = f"SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM ({SQL_PAGES}) GROUP BY doc_id"


def sql_chunks(source: str, size: int = 1000, stride: int = 1000) -> str:
    return f"""SELECT doc_id, (i // {stride})::INTEGER AS pos, substr(text, i + 1, {size}) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, length(text), {stride})) AS i FROM ({source}))"""


SQL_DOCS = "SELECT doc_id, text FROM documents"
SQL_CHUNKS = sql_chunks(SQL_DOCS)


def sql_sparse(source: str, keys: str, text: str) -> str:
    """Non-zero places of the hashed vectors of ``text``."""
    return f"""SELECT {keys}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {keys})))::FLOAT::DOUBLE AS weight
    FROM (SELECT {keys}, bucket, count(*)::DOUBLE AS n
          FROM (SELECT {keys}, (('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM})::INTEGER AS bucket
                FROM (SELECT {keys}, unnest({sql_words(f"lower({text})")}) AS w FROM ({source})))
          GROUP BY {keys}, bucket)"""


# The recursive splitter with 1000 and 100. Lines shorter than 1000 follow each
# other in one run, a longer line is a run of words; without any newline the
# text is one run of words. (The documents have no blank lines, and no words of
# 1000 characters.) A run is packed step by step: from a first piece ``a``, up to
# the last piece ``b`` that fits; the next chunk starts at the first piece from
# which at most 100 characters are repeated and the following piece still fits.
_SPLIT = f"""WITH RECURSIVE
    lines AS (SELECT doc_id, i, CASE WHEN i > 1 THEN chr(10) ELSE '' END || parts[i] AS line, len(parts) AS n
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
    marked AS (SELECT *, length(line) >= 1000 OR n = 1 AS long FROM lines WHERE line <> ''),
    runs AS (SELECT *, sum(long::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) * 2 - long::INTEGER AS run FROM marked),
    units AS (SELECT doc_id, run, i, 0 AS j, line AS piece FROM runs WHERE NOT long
        UNION ALL SELECT doc_id, run, i, j, CASE WHEN j > 1 THEN ' ' ELSE '' END || parts[j]
        FROM (SELECT doc_id, run, i, parts, unnest(range(1, len(parts) + 1)) AS j
              FROM (SELECT doc_id, run, i, string_split(line, ' ') AS parts FROM runs WHERE long))),
    pieces AS (SELECT doc_id, run, piece, row_number() OVER w AS k, sum(length(piece)) OVER w AS stop,
            sum(length(piece)) OVER w - length(piece) AS start
        FROM units WHERE piece <> '' WINDOW w AS (PARTITION BY doc_id, run ORDER BY i, j)),
    lists AS (SELECT doc_id, run, list(piece ORDER BY k) AS texts, list(start ORDER BY k) AS starts,
            list(stop ORDER BY k) AS stops FROM pieces GROUP BY doc_id, run),
    packed AS (SELECT doc_id, run, texts, starts, stops, 1::BIGINT AS a, len(list_filter(stops, lambda e: e <= 1000))::BIGINT AS b
        FROM lists
        UNION ALL SELECT doc_id, run, texts, starts, stops, a, len(list_filter(stops, lambda e: e <= starts[a] + 1000))
        FROM (SELECT doc_id, run, texts, starts, stops,
                     1 + len(list_filter(starts, lambda s: s < greatest(stops[b] - 100, stops[b + 1] - 1000))) AS a
              FROM packed WHERE b < len(texts))),
    joined AS (SELECT doc_id, run, a, {sql_strip("array_to_string(texts[a:b], '')")} AS chunk FROM packed),
    placed AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, a) - 1)::INTEGER AS pos, chunk
        FROM joined WHERE chunk <> '')"""

ORACLES = {
    "scan_documents": """SELECT page_id, (i - 1)::BIGINT AS page, string_split(html, chr(12))[i] AS text
        FROM (SELECT page_id, html, unnest(range(1, len(string_split(html, chr(12))) + 1)) AS i FROM pages)""",
    "assemble_pages": f"""SELECT doc_id, coalesce(p.text, '') AS text
        FROM documents d LEFT JOIN ({SQL_PAGE_DOCS}) p USING (doc_id)""",
    "raw_text_roundtrip": SQL_DOCS,
    "chunk_fixed": SQL_CHUNKS,
    "chunk_overlap": sql_chunks(SQL_DOCS, 1000, 900),
    "chunk_recursive": f"{_SPLIT} SELECT doc_id, pos, chunk FROM placed",
    "index_open": f"""{_SPLIT} SELECT doc_id || ':' || pos AS chunk_id, doc_id, pos, chunk, {DIM}::INTEGER AS dim,
        'hashed-{DIM}' AS model FROM placed""",
    "chunk_pages": sql_chunks(SQL_PAGE_DOCS),
    "wrap_chunks": f"SELECT doc_id, pos, chunk AS page_content FROM ({SQL_CHUNKS})",
    "split_tokens": f"""SELECT doc_id, (i - 1)::INTEGER AS pos, words[i] AS token
        FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i
              FROM (SELECT doc_id, {sql_words("text")} AS words FROM documents))""",
    "embed_texts": f"""SELECT doc_id, pos, bucket, round(weight, 6) AS weight
        FROM ({sql_sparse(SQL_CHUNKS, "doc_id, pos", "chunk")})""",
    "index_build": f"""SELECT doc_id || ':' || pos AS chunk_id, doc_id, pos, chunk, {DIM}::INTEGER AS dim,
        'hashed-{DIM}' AS model FROM ({sql_chunks(SQL_PAGE_DOCS)})""",
    "index_update": f"""SELECT c.doc_id || ':' || c.pos AS chunk_id, c.doc_id, c.pos, chunk, {DIM}::INTEGER AS dim,
        'hashed-{DIM}' AS model, bucket, round(weight, 6) AS weight
        FROM ({SQL_CHUNKS}) c JOIN ({sql_sparse(SQL_CHUNKS, "doc_id, pos", "chunk")}) USING (doc_id, pos)""",
    "check_index_model": f"""SELECT 'hashed-{DIM}' AS model, {DIM}::INTEGER AS dim, count(*) AS chunks
        FROM ({SQL_CHUNKS})""",
}
