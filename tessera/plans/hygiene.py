"""Hygiene queries: caches, duplicates, list unions, reviews and cascades over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hygiene as H
from tessera.operators import vectors as V
from tessera.operators.entities import similar_names
from tessera.operators.linking import linked
from tessera.plans.corpus import table
from tessera.plans.registry import query


@query("ingest_cache_misses", "SELECT doc_id, hash FROM (SELECT doc_id, sha256(text) AS hash, doc_id % 3 = 0 AS known, doc_id % 6 = 0 AS lost, text FROM documents) WHERE NOT known OR lost OR sha256(text) <> hash")
def ingest_cache_misses(spark, sf_dir):
    """Documents to ingest where every third is cached, and of every other cached one a written file is gone."""
    docs = table(spark, sf_dir, "documents")
    incoming = docs.select(F.col("doc_id").alias("name"), F.col("text").alias("content"))
    out = F.concat(F.lit("wiki/"), F.col("doc_id").cast("string"), F.lit(".md"))
    cache = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("hash"), F.array(out).alias("files_written"))
    files = docs.where("doc_id % 6 <> 0").select(out.alias("path"))
    return H.cache_misses(incoming, cache, files).select(F.col("name").alias("doc_id"), "hash")


@query("exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("title_duplicates", "WITH t AS (SELECT regexp_replace(lower(string_split(text, chr(10))[1]), '[\\s\\-_]+', '', 'g') AS key, 'd' || doc_id AS slug FROM documents) SELECT md5(key) AS key, slug, n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM t WHERE key <> '') WHERE n > 1")
def title_duplicates(spark, sf_dir):
    """Documents of one first line."""
    pages = table(spark, sf_dir, "documents").select(F.split("text", "\n")[0].alias("title"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"))
    return H.title_duplicates(pages).select(F.md5("key").alias("key"), "slug", "n")



@query(
    "list_union",
    "SELECT doc_id, CASE WHEN upper(lang) = upper(source) THEN lang WHEN lang = 'en' THEN 'EN,' || source ELSE 'EN,' || lang || ',' || source END AS merged, CASE WHEN lang = 'en' THEN 'delete' ELSE 'skip' END AS fate FROM documents",
)
def list_union(spark, sf_dir):
    """Union without regard to case (first spelling), and what deleting a source does to a page that lists it."""
    docs = table(spark, sf_dir, "documents")
    merged = H.union_ci(F.array(F.lit("EN"), "lang"), F.array("lang", "source"))
    return docs.select("doc_id", F.array_join(merged, ",").alias("merged"), H.source_fate(F.array("lang"), F.lit("EN")).alias("fate"))


@query(
    "merged_reviews",
    """SELECT type, key, min(event_id) AS first_id, count(*) AS n_merged, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'missing-page' WHEN 'click' THEN 'duplicate' ELSE 'suggestion' END AS type, 'user ' || user_id AS key, 'p' || (event_id % 7) AS page FROM events) GROUP BY type, key""",
)
def merged_reviews(spark, sf_dir):
    """Events as review items: those of one kind and title become one, in order of arrival."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "missing-page").when(F.col("event_type") == "click", "duplicate").otherwise("suggestion")
    items = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("Missing page:  User "), F.col("user_id").cast("string")).alias("title"),
        F.col("props").alias("description"), F.lit(None).cast("string").alias("source_path"),
        F.array(F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string"))).alias("affected_pages"), F.lit(None).cast("array<string>").alias("search_queries"),
    )
    m = H.merge_reviews(items)
    return m.select("type", "key", F.col("id").alias("first_id"), "n_merged", F.array_join(F.array_sort("affected_pages"), ",").alias("pages"))


@query(
    "resolved_reviews",
    """SELECT item_id FROM benchmark WHERE CASE WHEN item_id % 2 = 0 THEN item_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) ELSE item_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) OR item_id + 1 NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) END""",
)
def resolved_reviews(spark, sf_dir):
    """Half of the items ask for a page, half name two duplicates; every fourth document exists as a page."""
    name = lambda c: F.concat(F.lit("Page "), c.cast("string"))
    pages = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("id"), name(F.col("doc_id")).alias("title"))
    path = lambda c: F.concat(F.lit("wiki/page-"), c.cast("string"), F.lit(".md"))
    i = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.when(i % 2 == 0, "missing-page").otherwise("duplicate").alias("type"), F.concat(F.lit("Missing page: "), name(i)).alias("title"),
        F.when(i % 2 == 1, F.array(path(i), path(i + 1))).alias("affected_pages"),
    )
    return H.resolved_by_rule(items, pages).select(F.col("id").alias("item_id"))


@query("vector_upsert", "SELECT vec_id, label, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS origin FROM embeddings WHERE label NOT IN (5)")
def vector_upsert(spark, sf_dir):
    """Rows of one page replaced, those of another deleted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.where("label = 3").withColumn("origin", F.lit("new"))
    out = V.upsert_pages(e.withColumn("origin", F.lit("old")), new, "label")
    return V.delete_pages(out, e.where("label = 5"), "label").select("vec_id", "label", "origin")


LINKED = "'# T' || chr(10) || '- [[D' || (doc_id // 2) || '|two]] a' || chr(10) || 'see [[d ' || (doc_id // 3) || ']] and [[x]]'"


@query(
    "dead_links_stripped",
    """SELECT doc_id, 'see ' || CASE WHEN (doc_id // 3) % 10 = 0 AND doc_id // 3 <= m THEN 'd ' || (doc_id // 3) ELSE '[[d ' || (doc_id // 3) || ']]' END || ' and [[x]]' AS content,
  CASE WHEN (doc_id // 2) % 10 = 0 AND doc_id // 2 <= m THEN '' ELSE '- [[D' || (doc_id // 2) || '|two]] a' END AS index_line FROM documents, (SELECT max(doc_id) AS m FROM documents)""",
)
def dead_links_stripped(spark, sf_dir):
    """Pages with links to others, of which every tenth is deleted: dead links become text, index lines go."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = lambda k: F.floor(F.col("doc_id") / k).cast("string")
    keys = H.deleted_keys(docs.where("doc_id % 10 = 0").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("slug"), F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("title")))
    path = F.col("doc_id").cast("string")
    pages = docs.select(path.alias("path"), F.concat(F.lit("see [[d "), n(3), F.lit("]] and [[x]]")).alias("content"))
    index = docs.select(path.alias("path"), F.concat(F.lit("- [[D"), n(2), F.lit("|two]] a")).alias("content"))
    a = H.strip_dead_links(pages, keys)
    b = H.clean_index(index, keys).withColumnRenamed("content", "index_line")
    return a.join(b, "path").select(F.col("path").cast("long").alias("doc_id"), "content", "index_line")


@query("first_urls", "SELECT host, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM (SELECT *, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages) GROUP BY host")
def first_urls(spark, sf_dir):
    """The first page of each host."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "url", "page_id")
    return H.first_by(pages, ["host"], ["page_id"]).select("host", "url", "page_id")


@query(
    "related_source_pages",
    """SELECT path, source FROM (SELECT 'wiki/' || CASE WHEN doc_id % 3 = 0 THEN 'sources/Src1-x' ELSE 'd' END || doc_id || '.md' AS path, 'src1.pdf' AS source FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'wiki/' || CASE WHEN doc_id % 3 = 0 THEN 'sources/Src1-x' ELSE 'd' END || doc_id || '.md', source || '.pdf' FROM documents WHERE doc_id % 2 = 0 AND source IN ('src1', 'src2')
  UNION ALL SELECT 'wiki/' || CASE WHEN doc_id % 3 = 0 THEN 'sources/Src1-x' ELSE 'd' END || doc_id || '.md', 'src2.pdf' FROM documents WHERE doc_id % 5 = 0) GROUP BY ALL""",
)
def related_source_pages(spark, sf_dir):
    """Two deleted sources: pages under their stem, pages that list them (in capitals), pages that quote one."""
    i = F.col("doc_id")
    path = F.concat(F.lit("wiki/"), F.when(i % 3 == 0, "sources/Src1-x").otherwise("d"), i.cast("string"), F.lit(".md"))
    head = F.when(i % 2 == 0, F.concat(F.lit("---\nsources: ["), F.upper("source"), F.lit(".PDF, b.pdf]\n---\n"))).otherwise(F.lit(""))
    end = F.when(i % 5 == 0, F.lit(' from "src2.pdf"')).otherwise(F.lit(" not src2.pdf"))
    pages = table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(head, F.translate("text", '"', ""), end).alias("content"))
    sources = spark.range(1).select(F.explode(F.array(F.lit("src1.pdf"), F.lit("src2.pdf"))).alias("source"))
    return H.related_pages(pages, sources)


@query(
    "similar_titles",
    """WITH t AS (SELECT page_id, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\\x00-\\x7F]', '_', 'g') AS x FROM pages WHERE html IS NOT NULL),
n AS (SELECT DISTINCT x FROM (SELECT x FROM t UNION ALL SELECT substr(x, 1, 4) || substr(x, 6) FROM t WHERE page_id % 3 = 0) WHERE x <> '')
SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x)::INTEGER AS distance FROM n a JOIN n b ON a.x < b.x AND abs(length(a.x) - length(b.x)) <= greatest(length(a.x), length(b.x)) // 10 AND levenshtein(a.x, b.x) <= greatest(length(a.x), length(b.x)) // 10""",
)
def similar_titles(spark, sf_dir):
    """Titles of web pages, and of every third one a misspelt form, that are alike but for a tenth of their letters. DuckDB's
    edit distance is one of bytes, so letters of two bytes are one sign here."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.regexp_replace(title, r"[^\x00-\x7F]", "_").alias("name"))
    misspelt = pages.where("page_id % 3 = 0").select("page_id", F.concat(F.substring("name", 1, 4), F.expr("substr(name, 6)")).alias("name"))
    return similar_names(pages.unionByName(misspelt))


@query("linked_titles", None)
def linked_titles(spark, sf_dir):
    """Documents with links to the web pages whose titles stand in them; tested against brute force."""
    titles = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("target"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return linked(docs, titles, count="n_places").select("doc_id", "n_places", F.md5("content").alias("content_md5"))
