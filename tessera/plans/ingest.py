"""Ingest queries: summaries, grouping, cascades and one whole batch with a stand-in model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import front_matter_value, list_field, page_title, page_type
from tessera.operators import ingest as N
from tessera.plans.corpus import table
from tessera.plans.registry import query
from tessera.session import shared_dir
from tessera.sources import journal as J
from tessera.sources.versions import KeyedTable


def _pages(spark, sf_dir):
    """Documents as typed pages that name their source and a related page, which is missing for every third."""
    doc = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\ntype: "), F.when(F.col("doc_id") % 3 == 0, "source").otherwise("concept"), F.lit('\ntitle: "Doc '), doc, F.lit('"\nsources: ["'), "source", F.lit('.pdf"'), F.when(F.col("doc_id") % 2 == 0, F.lit(', "b.pdf"')).otherwise(""), F.lit(']\nrelated: ["d-'), F.floor(F.col("doc_id") / 2).cast("string"), F.lit('", "x"]\n---\n\n[[d-'), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("|two]] text\n\nmore"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/d-"), doc, F.lit(".md")).alias("path"), F.concat(F.lit("d-"), doc, F.lit(".md")).alias("file_name"), head.alias("content"))


@query("entity_summaries", "SELECT 'd-' || doc_id AS slug, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'concept' END AS type, 'Doc ' || doc_id AS title, '[[d-' || (doc_id // 2) || '|two]] text' AS description FROM documents")
def entity_summaries(spark, sf_dir):
    return N.entity_summaries(_pages(spark, sf_dir)).drop("tags")


@query("pages_by_type", "SELECT type, CASE WHEN type = 'source' THEN 4 ELSE 3 END AS place, n, title, path FROM (SELECT *, count(*) OVER (PARTITION BY type) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'concept' END AS type, 'Doc ' || doc_id AS title, 'wiki/d-' || doc_id || '.md' AS path FROM documents))")
def pages_by_type(spark, sf_dir):
    return N.pages_by_type(_pages(spark, sf_dir).select(page_type(F.col("content")).alias("type"), page_title(F.col("content"), F.col("file_name")).alias("title"), "path"))



@query(
    "cascade_delete",
    """SELECT 'wiki/d-' || doc_id || '.md' AS path, CASE WHEN (doc_id // 2) % 5 = 0 THEN 'two text' ELSE '[[d-' || (doc_id // 2) || '|two]] text' END AS line,
  CASE WHEN (doc_id // 2) % 5 = 0 THEN 'x' ELSE 'd-' || (doc_id // 2) || ',x' END AS related FROM documents WHERE doc_id % 5 <> 0""",
)
def cascade_delete(spark, sf_dir):
    """Every fifth page deleted with all that points to it."""
    pages = _pages(spark, sf_dir)
    out = N.cascade_delete(pages, pages.where(F.regexp_extract("path", "d-([0-9]+)", 1).cast("long") % 5 == 0))["pages"]
    return out.select("path", F.regexp_extract("content", r"(?m)^(.*text)$", 1).alias("line"), F.array_join(list_field(F.col("content"), "related"), ",").alias("related"))


@query("deleted_sources", "SELECT 'wiki/d-' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'delete' END AS action, CASE WHEN doc_id % 2 = 0 THEN 'b.pdf' ELSE '' END AS sources FROM documents WHERE source = 'src3'")
def deleted_sources(spark, sf_dir):
    """What deleting one source does to each page that names it."""
    gone = spark.range(1).select(F.lit("src3.pdf").alias("source"))
    return N.delete_sources(_pages(spark, sf_dir), gone).select("path", "action", F.array_join("sources", ",").alias("sources"))


def _model(text: str) -> str:
    """A stand-in: every text with an even length becomes a page and a log entry with a review, others give nothing; it fails
    where the length is divisible by eleven."""
    if len(text) % 11 == 0:
        raise TimeoutError("no answer")
    if len(text) % 2:
        return "no files"
    name = f"n{len(text) % 50}"
    return f'---FILE: wiki/concepts/{name}.md---\n---\ntype: concept\nsources: ["{len(text)}"]\n---\n\n# {name}\n---END FILE---\n---FILE: wiki/log.md---\n- {len(text)}\n---END FILE---\n---REVIEW: suggestion | Look at {name} ---\nwhy\n---END REVIEW---'


def _ingested(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("content"), "doc_id")
    cache = docs.where("doc_id % 3 = 0").select("name", F.sha2("content", 256).alias("hash"), F.array().cast("array<string>").alias("files_written"))
    log = spark.range(1).select(F.lit("wiki/log.md").alias("path"), F.lit("old\n").alias("content"))
    return N.ingest(docs.drop("doc_id"), cache, log, _model, "2024-01-01")


@query("ingest_failures", "SELECT 'doc-' || doc_id || '.txt' AS name, 'TimeoutError: no answer' AS error FROM documents WHERE doc_id % 3 <> 0 AND least(length(text), 50000) % 11 = 0")
def ingest_failures(spark, sf_dir):
    return _ingested(spark, sf_dir)["failures"]


@query("ingest_cached", "SELECT 'doc-' || doc_id || '.txt' AS name, sha256(text) AS hash, CASE WHEN n % 2 = 0 THEN 'wiki/concepts/n' || (n % 50) || '.md,wiki/log.md' ELSE 'wiki/sources/doc-' || doc_id || '.md' END AS files FROM (SELECT *, least(length(text), 50000) AS n FROM documents) WHERE doc_id % 3 <> 0 AND n % 11 <> 0")
def ingest_cached(spark, sf_dir):
    """What a batch adds to the cache: sources whose call failed are not among them."""
    return _ingested(spark, sf_dir)["cache"].select("name", "hash", F.array_join("files_written", ",").alias("files"))


@query(
    "ingest_batch",
    """WITH t AS (SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, least(length(text), 50000) AS n, text FROM documents WHERE doc_id % 3 <> 0 AND least(length(text), 50000) % 11 <> 0),
f AS (SELECT name, n, 'wiki/concepts/n' || (n % 50) || '.md' AS path, row_number() OVER (PARTITION BY n % 50 ORDER BY name) AS r FROM t WHERE n % 2 = 0)
SELECT path, md5(string_agg(n::VARCHAR, ',' ORDER BY r)) AS hash, count(*) AS n_sources FROM (SELECT path, n, min(r) AS r FROM f GROUP BY 1, 2) GROUP BY path
UNION ALL SELECT 'wiki/sources/doc-' || doc_id || '.md', md5(name), 1 FROM t WHERE n % 2 = 1
UNION ALL SELECT 'wiki/log.md', md5('old' || chr(10) || chr(10) || string_agg('- ' || n, chr(10) || chr(10) ORDER BY name) || chr(10)), count(*) FROM t WHERE n % 2 = 0 HAVING count(*) > 0""",
)
def ingest_batch(spark, sf_dir):
    """A batch of documents of which every third is cached: pages that several sources write are merged in the order of the
    sources' names, all log entries are appended, and failed sources write nothing."""
    out = _ingested(spark, sf_dir)["writes"]
    listed = list_field(F.col("content"), "sources")
    log = F.col("path") == "wiki/log.md"
    return out.select("path", F.md5(F.when(log, F.col("content")).otherwise(F.array_join(listed, ","))).alias("hash"), F.when(log, F.regexp_count("content", F.lit("(?m)^- "))).otherwise(F.size(listed)).cast("long").alias("n_sources"))



@query("research_pages", "SELECT 'wiki/queries/research-topic-' || item_id || '-2024-01-01.md' AS path, 1 AS n_refs FROM benchmark")
def research_pages(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    tasks = items.select(F.col("item_id").alias("task_id"), F.concat(F.lit("Topic "), F.col("item_id").cast("string")).alias("topic"), F.concat(F.lit("<think>x</think>"), "text").alias("synthesis"), F.lit("2024-01-01").cast("date").alias("day"))
    results = items.select(F.col("item_id").alias("task_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.lit("https://www.x.org/a").alias("url"), F.lit("T").alias("title"))
    return N.research_pages(tasks, results).select("path", F.regexp_count("content", F.lit(r"(?m)^[0-9]+\. \[")).alias("n_refs"))


@query("cancelled_outputs", "SELECT 'wiki/d-' || doc_id || '.md' AS path, CASE WHEN (doc_id // 2) % 4 = 0 THEN 'x' ELSE 'd-' || (doc_id // 2) || ',x' END AS related FROM documents WHERE doc_id % 4 <> 0")
def cancelled_outputs(spark, sf_dir):
    """Every fourth page was written by a cancelled task: it goes, and nothing points to it any more."""
    pages = _pages(spark, sf_dir)
    i = F.regexp_extract("path", "d-([0-9]+)", 1).cast("long")
    tasks = pages.select(i.alias("task_id"), F.when(i % 4 == 0, "cancelled").otherwise("done").alias("status"), F.array("path").alias("files_written"))
    return N.cleanup_cancelled(pages, tasks)["pages"].select("path", F.array_join(list_field(F.col("content"), "related"), ",").alias("related"))


@query(
    "source_cascade",
    """SELECT 'wiki/d-' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 AND source = 'src3' THEN 'b.pdf' WHEN doc_id % 2 = 0 THEN source || '.pdf,b.pdf' ELSE source || '.pdf' END AS sources,
  NOT (doc_id // 2 IN (SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id % 2 = 1)) AS linked, NULL AS log FROM documents WHERE NOT (source = 'src3' AND doc_id % 2 = 1)
UNION ALL SELECT 'wiki/log.md', '', FALSE, 'old' || chr(10) || chr(10) || '- 2024-01-01: deleted source src3.pdf' || chr(10)""",
)
def source_cascade(spark, sf_dir):
    """One source deleted: pages of it alone go with the links to them, others lose it from their lists, the log says so."""
    log = spark.range(1).select(F.lit("wiki/log.md").alias("path"), F.lit("log.md").alias("file_name"), F.lit("old\n").alias("content"))
    gone = spark.range(1).select(F.lit("src3.pdf").alias("source"))
    cache = spark.createDataFrame([("src3.pdf",), ("b.pdf",)], "name string")
    out = N.delete_source_cascade(_pages(spark, sf_dir).unionByName(log), gone, cache, "2024-01-01")["pages"]
    return out.select("path", F.array_join(list_field(F.col("content"), "sources"), ",").alias("sources"), F.contains("content", F.lit("[[d-")).alias("linked"), F.when(F.col("path") == "wiki/log.md", F.col("content")).alias("log"))


@query("duplicate_prompts", "SELECT batch, md5('Which of these pages are about the same thing?' || chr(10) || chr(10) || string_agg('- d-' || doc_id || ' (' || CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'concept' END || '): Doc ' || doc_id || ' - [[d-' || (doc_id // 2) || '|two]] text', chr(10) ORDER BY 'd-' || doc_id)) AS hash FROM (SELECT doc_id, (row_number() OVER (ORDER BY 'd-' || doc_id) - 1) // 200 AS batch FROM documents) GROUP BY 1")
def duplicate_prompts(spark, sf_dir):
    """What a judge of duplicates is asked, for batches of as many pages as one call takes."""
    s = N.judged_batches(N.entity_summaries(_pages(spark, sf_dir)))
    return N.duplicate_prompt(s).select("batch", F.md5("prompt").alias("hash"))


@query("caption_prompts", "SELECT doc_id, 'Describe the image in one sentence.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Text before the image:' || chr(10) || lang ELSE '' END AS prompt, '## Output language: ' || lang || chr(10) || chr(10) || 'Write the whole answer, titles included, in ' || lang || ', whatever the language of the sources. Proper nouns take their usual form in ' || lang || '.' AS directive FROM documents")
def caption_prompts(spark, sf_dir):
    before = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise("  ")
    return table(spark, sf_dir, "documents").select("doc_id", N.caption_prompt(before, F.lit("")).alias("prompt"), N.language_directive(F.col("lang")).alias("directive"))


MERGED = "doc_id % 10 = 0 AND doc_id + 1 <= (SELECT max(doc_id) FROM documents)"


def _merges(spark, sf_dir):
    """Every tenth document and the next one as duplicates, of which the next one stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    last = docs.agg(F.max("doc_id").alias("last"))
    name = lambda n: F.concat(F.lit("d-"), n.cast("string"))
    i = F.col("doc_id")
    return docs.join(F.broadcast(last)).where((i % 10 == 0) & (i < F.col("last"))).select(i.alias("group_id"), name(i + 1).alias("canonical"), F.array(name(i), name(i + 1)).alias("slugs"), F.lit("---\ntype: concept\nsources: []\n---\n\nboth").alias("merged"))


@query(
    "merged_duplicates",
    f"""WITH g AS (SELECT doc_id AS k FROM documents WHERE {MERGED}),
src AS (SELECT doc_id, source || '.pdf' AS s, doc_id // 2 AS half FROM documents)
SELECT 'wiki/d-' || (k + 1) || '.md' AS path, CASE WHEN a.s = b.s THEN a.s || ',b.pdf' ELSE b.s || ',' || a.s || ',b.pdf' END AS sources, '2024-01-01' AS updated, NULL AS link, TRUE AS written FROM g JOIN src a ON a.doc_id = k JOIN src b ON b.doc_id = k + 1
UNION ALL SELECT 'wiki/d-' || doc_id || '.md', CASE WHEN doc_id % 2 = 0 THEN s || ',b.pdf' ELSE s END, '', 'd-' || (half + 1), TRUE FROM src WHERE half IN (SELECT k FROM g) AND doc_id NOT IN (SELECT k FROM g) AND doc_id - 1 NOT IN (SELECT k FROM g)
UNION ALL SELECT 'wiki/d-' || k || '.md', NULL, NULL, NULL, FALSE FROM g""",
)
def merged_duplicates(spark, sf_dir):
    """Every tenth document merged into the next one: canonical pages, pages whose links are led on, pages that go."""
    pages = _pages(spark, sf_dir)
    merges = _merges(spark, sf_dir)
    out = N.merge_duplicates(pages, merges, "2024-01-01")
    link = F.nullif(F.regexp_extract("content", r"\[\[([^\]|]+)\|two\]\]", 1), F.lit(""))
    writes = out["writes"].select("path", F.array_join(list_field(F.col("content"), "sources"), ",").alias("sources"), front_matter_value(F.col("content"), "updated").alias("updated"), link.alias("link"), F.lit(True).alias("written"))
    none = F.lit(None).cast("string")
    return writes.union(out["deletes"].select("path", none, none, none, F.lit(False)))


@query(
    "executed_merges",
    f"""WITH g AS (SELECT doc_id AS k FROM documents WHERE {MERGED}),
src AS (SELECT doc_id, source || '.pdf' AS s, doc_id // 2 AS half FROM documents)
SELECT 'wiki/d-' || (k + 1) || '.md' AS path, CASE WHEN a.s = b.s THEN a.s || ',b.pdf' ELSE b.s || ',' || a.s || ',b.pdf' END AS sources, '2024-01-01' AS updated, NULL AS link FROM g JOIN src a ON a.doc_id = k JOIN src b ON b.doc_id = k + 1
UNION ALL SELECT 'wiki/d-' || doc_id || '.md', CASE WHEN doc_id % 2 = 0 THEN s || ',b.pdf' ELSE s END, '', 'd-' || (CASE WHEN half IN (SELECT k FROM g) THEN half + 1 ELSE half END) FROM src WHERE doc_id NOT IN (SELECT k FROM g) AND doc_id - 1 NOT IN (SELECT k FROM g)""",
)
def executed_merges(spark, sf_dir):
    """The same merges carried out through the journal: what the table of pages holds afterwards."""
    tables = {"pages": KeyedTable(spark, shared_dir(spark, "wiki-pages"), J.PAGES), "history": KeyedTable(spark, shared_dir(spark, "wiki-history"), J.HISTORY)}
    tables["pages"].replace(_pages(spark, sf_dir).select("path", "content"))
    J.execute_merges(J.Journal(spark, shared_dir(spark, "journal"), tables), _merges(spark, sf_dir), "2024-01-01", F.lit("2024-01-01").cast("timestamp"))
    link = F.nullif(F.regexp_extract("content", r"\[\[([^\]|]+)\|two\]\]", 1), F.lit(""))
    return tables["pages"].read().select("path", F.array_join(list_field(F.col("content"), "sources"), ",").alias("sources"), front_matter_value(F.col("content"), "updated").alias("updated"), link.alias("link"))
