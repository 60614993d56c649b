"""Queries over markdown made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.functions import text as T
from tessera.plans.corpus import table
from tessera.plans.registry import query
from tessera.sources.web import clip_files, markdown


def _page(body="text"):
    head = F.concat(F.lit("---\ntitle: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\ntype: "), F.when(F.col("doc_id") % 2 == 0, "Concept").otherwise("entity"), F.lit("\nsources: [\"a.pdf\", "), "source", F.lit("]\ntags:\n  - x\n  - "), "lang", F.lit("\n---\n\n# Doc\n\n"))
    return F.concat(head, F.col(body))


@query("document_chunks")
def document_chunks(spark, sf_dir):
    """Heading-aware chunks of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", M.chunks()(_page()).alias("c"))
    return docs.select("doc_id", F.explode("c").alias("c")).select("doc_id", F.col("c.index").alias("chunk"), "c.heading_path", "c.char_start", "c.char_end", "c.oversized", F.sha2("c.text", 256).alias("hash"))


@query(
    "page_projection",
    "SELECT doc_id, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'concept' ELSE 'entity' END AS type, 'a.pdf,' || source AS sources, 'x,' || lang AS tags, 'a.pdf,' || source AS parsed_sources, md5('# Doc' || chr(10) || chr(10) || text) AS body FROM documents",
)
def page_projection(spark, sf_dir):
    """Title, type and lists of pages, by expressions and by the YAML parser."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _page().alias("content"))
    fm = docs.withColumn("fm", M.front_matter("content"))
    c = F.col("content")
    return fm.select(
        "doc_id", T.page_title(c, F.lit("x.md")).alias("title"), T.page_type(c).alias("type"), F.array_join(T.page_sources(c), ",").alias("sources"),
        F.array_join(T.list_field(c, "tags"), ",").alias("tags"), F.array_join(F.col("fm.lists")["sources"], ",").alias("parsed_sources"), F.md5(F.regexp_replace("fm.body", r"\A\n+", "")).alias("body"),
    )


@query(
    "file_and_review_blocks",
    "SELECT doc_id, 'wiki/d' || doc_id || '.md' AS path, md5('> ' || replace(text, chr(10), chr(10) || '> ')) AS hash, 1 AS n_warnings, CASE WHEN doc_id % 2 = 0 THEN 'duplicate' ELSE 'confirm' END AS review_type, 'a.md,b.md' AS pages FROM documents",
)
def file_and_review_blocks(spark, sf_dir):
    """Generated text with one good file (a whole document, quoted, so that its lines are no fences), one unsafe file and one
    review, parsed back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))).alias("text"))
    out = F.concat(
        F.lit("---FILE: wiki/d"), F.col("doc_id").cast("string"), F.lit(".md---\n"), "text", F.lit("\n---END FILE---\n---FILE: ../x.md---\nno\n---END FILE---\n---REVIEW: "),
        F.when(F.col("doc_id") % 2 == 0, "duplicate").otherwise("other"), F.lit(" | Title ---\nBody\nOPTIONS: A | B\nPAGES: a.md, b.md\n---END REVIEW---\n"),
    )
    got = docs.select("doc_id", M.parse_file_blocks(out).alias("f"), M.parse_review_blocks(out).alias("r"))
    return got.select(
        "doc_id", F.col("f.files")[0]["path"].alias("path"), F.md5(F.col("f.files")[0]["content"]).alias("hash"), F.size("f.warnings").alias("n_warnings"),
        F.col("r")[0]["type"].alias("review_type"), F.array_join(F.col("r")[0]["affected_pages"], ",").alias("pages"),
    )


@query(
    "page_markdown",
    """SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS hash FROM (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>', chr(10) || chr(10) || '# '), '</h1>', ''), '<p>', chr(10) || chr(10)), '</p>', ''),
    '<b>', '**'), '<br>', chr(10)), '&amp;', '&'), '&quot;', '"') AS t FROM pages)""",
)
def page_markdown(spark, sf_dir):
    """The main content of web pages as markdown."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(markdown("html")).alias("hash"))


@query(
    "clip_files",
    """SELECT clip_id, 'raw/sources/' || base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path FROM (
  SELECT page_id AS clip_id, b || '-20240101' AS base, row_number() OVER (PARTITION BY b ORDER BY page_id) AS n FROM (
    SELECT page_id, 'page-' || (page_id % 20) AS b FROM pages))""",
)
def clip_file_names(spark, sf_dir):
    """Clips with colliding titles get numbered names."""
    clips = table(spark, sf_dir, "pages").select(F.col("page_id").alias("clip_id"), F.concat(F.lit("Page "), (F.col("page_id") % 20).cast("string"), F.lit("!")).alias("title"), "url", F.col("html").alias("text"), F.lit("2024-01-01").cast("date").alias("day"))
    return clip_files(clips).select("clip_id", "path")
