"""Lookups, captions, images, languages and other small functions over rows that try every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import language as L
from tessera.functions import markdown as M
from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import hygiene as H
from tessera.operators import ingest as N
from tessera.plans.corpus import table, web_nodes
from tessera.plans.registry import query


@query(
    "name_functions",
    """SELECT doc_id, lang || '-n-' || doc_id || '-2024-05-06-070809.md' AS query_file, 'history/wiki_d_' || doc_id || '.md.2024-05-06T07-08-09.md' AS backup,
  regexp_replace(lang, '(.)', '\\1', 'g') || '\\.\\(' || doc_id || '\\)' AS quoted, 'a ' || lang || ') b' AS caption, round(8 + sqrt(doc_id / greatest(m, 1)) * 20, 6) AS size FROM documents, (SELECT max(doc_id) AS m FROM documents)""",
)
def name_functions(spark, sf_dir):
    """Names of saved answers and backups, quoted patterns, captions as alternative texts, sizes of nodes."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    now, most = F.lit("2024-05-06 07:08:09").cast("timestamp"), docs.agg(F.max("doc_id").alias("m"))
    return docs.join(F.broadcast(most)).select(
        "doc_id", T.query_file_name(F.concat("lang", F.lit("  N! "), i), now).alias("query_file"), N.backup_path(F.concat(F.lit("wiki/d "), i, F.lit(".md")), now).alias("backup"),
        T.quoted_regex(F.concat("lang", F.lit(".("), i, F.lit(")"))).alias("quoted"), T.caption_text(F.concat(F.lit(" a\r\n"), "lang", F.lit("] b\n"))).alias("caption"), F.round(G.node_size(F.col("doc_id"), F.col("m")), 6).alias("size"),
    )


@query(
    "typed_pages",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'thesis' WHEN doc_id % 7 = 0 THEN 'entity' WHEN doc_id % 7 = 1 THEN 'concept' WHEN doc_id % 7 = 2 THEN 'source' WHEN doc_id % 7 = 3 THEN 'query' WHEN doc_id % 7 = 4 THEN 'synthesis' WHEN doc_id % 7 = 5 THEN 'comparison' ELSE 'other' END AS type,
  doc_id % 7 <> 6 AS embeddable FROM documents""",
)
def typed_pages(spark, sf_dir):
    """Types from the front matter, else from the folder; structural pages are not embedded."""
    folder = F.element_at(F.array(*map(F.lit, ("entities", "concepts", "sources", "queries", "synthesis", "comparisons", "x"))), (F.col("doc_id") % 7 + 1).cast("int"))
    i = F.col("doc_id").cast("string")
    path = F.concat(F.lit("w/wiki/"), folder, F.lit("/"), F.when(F.col("doc_id") % 7 == 6, F.lit("Index")).otherwise(F.concat(F.lit("d"), i)), F.lit(".md"))
    content = F.when(F.col("doc_id") % 3 == 0, F.lit("---\ntype: Thesis\n---\nx")).otherwise(F.lit("---\ntitle: x\n---\nx"))
    pages = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content")).withColumn("file_name", T.file_name(F.col("path")))
    kept = N.embeddable(pages).select("doc_id", F.lit(True).alias("embeddable"))
    return pages.join(kept, "doc_id", "left").select("doc_id", T.page_type_or_folder(F.col("content"), F.col("path")).alias("type"), F.coalesce("embeddable", F.lit(False)).alias("embeddable"))


@query("slug_paths", "SELECT 'p' || page_id AS slug, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'wiki/a/p' || page_id || '.md' ELSE 'wiki/b/p' || page_id || '.md' END AS path FROM pages")
def slug_paths(spark, sf_dir):
    """Slugs with the first file of that name: some have two files, some none."""
    i = F.col("page_id")
    name = lambda folder: F.concat(F.lit(f"wiki/{folder}/p"), i.cast("string"), F.lit(".md"))
    pages = table(spark, sf_dir, "pages").select("page_id")
    files = pages.where("page_id % 3 = 1").select(name("a").alias("path")).union(pages.where("page_id % 3 > 0").select(name("b").alias("path")))
    return N.paths_of_slugs(pages.select(F.concat(F.lit("p"), i.cast("string")).alias("slug")), files).select("slug", "path")


@query("stale_extractions", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def stale_extractions(spark, sf_dir):
    """Files of which every second has no extraction and every third an old one."""
    d, at = table(spark, sf_dir, "documents"), lambda day: F.lit(day).cast("timestamp")
    files = d.select(F.col("doc_id").cast("string").alias("path"), at("2024-02-01").alias("modificationTime"))
    done = d.where("doc_id % 2 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, at("2024-01-01")).otherwise(at("2024-02-01")).alias("modificationTime"))
    return H.stale_extractions(files, done).select(F.col("path").cast("long").alias("doc_id"))


def _images(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.floor(i / 10).cast("string")).alias("path"), F.when(i % 4 > 0, i % 4).cast("int").alias("page"), i.cast("int").alias("index"), F.concat(F.lit("i"), i.cast("string")).alias("name"))


@query("images_by_page", "SELECT path, section, string_agg(name, ',' ORDER BY doc_id) AS names FROM (SELECT doc_id, 'd' || (doc_id // 10) AS path, CASE WHEN doc_id % 4 > 0 THEN 'Page ' || (doc_id % 4) ELSE 'Document' END AS section, 'i' || doc_id AS name FROM documents) GROUP BY 1, 2")
def images_by_page(spark, sf_dir):
    return N.images_by_page(_images(spark, sf_dir)).select("path", "section", F.array_join(F.transform("images", lambda x: x["name"]), ",").alias("names"))


def _captions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    images = table(spark, sf_dir, "documents").select(F.concat(F.lit("u"), i).alias("url"), F.concat(F.lit("h"), i).alias("sha256"), "doc_id")
    plan = N.caption_plan(images.union(images), images.where("doc_id % 4 = 0").select("sha256", F.lit("known]").alias("caption")))
    return N.captioned(plan, images.where("doc_id % 4 IN (1, 2)").select("sha256", F.when(F.col("doc_id") % 4 == 1, "new").alias("caption")))


@query("caption_counts", "SELECT count(*) FILTER (WHERE doc_id % 4 = 1) AS fresh, count(*) FILTER (WHERE doc_id % 4 = 0) AS cached, count(*) FILTER (WHERE doc_id % 4 > 1) AS failed FROM documents")
def caption_counts(spark, sf_dir):
    return N.caption_counts(_captions(spark, sf_dir))


@query("captioned_pages", """SELECT doc_id, 'a ![' || CASE doc_id % 4 WHEN 0 THEN 'known)' WHEN 1 THEN 'new' ELSE 'old' END || '](u' || doc_id || ') b ![' || CASE doc_id % 4 WHEN 0 THEN 'known)' WHEN 1 THEN 'new' ELSE 'old' END || '](u' || doc_id || ') ![z](other)' AS content FROM documents""")
def captioned_pages(spark, sf_dir):
    """Pages whose images take the captions found for them."""
    i = F.col("doc_id").cast("string")
    ref = F.concat(F.lit("![old](u"), i, F.lit(")"))
    pages = table(spark, sf_dir, "documents").select(i.alias("path"), F.concat(F.lit("a "), ref, F.lit(" b "), ref, F.lit(" ![z](other)")).alias("content"))
    return N.with_captions(pages, _captions(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "content")


@query("image_places", "SELECT doc_id, pos, CASE pos WHEN 0 THEN 'a ' WHEN 1 THEN 'a ![o](u) b ' END AS before, CASE pos WHEN 0 THEN ' b ![o](u) c' WHEN 1 THEN ' c' END AS after FROM documents, (SELECT unnest([0, 1]) AS pos)")
def image_places(spark, sf_dir):
    """A repeated image has the text around each of its places."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("a ![o](u) b ![o](u) c").alias("content"))
    return N.image_references(pages).select(F.col("path").cast("long").alias("doc_id"), "pos", "before", "after")


@query("hidden_types", "SELECT count(*) AS n FROM pages WHERE page_id % 4 <> 2")
def hidden_types(spark, sf_dir):
    """Query pages are no nodes of the graph that is shown."""
    nodes = web_nodes(spark, sf_dir).where("path LIKE 'wiki/sources/%'")
    none = spark.createDataFrame([], "src string, target string")
    return G.display_graph(nodes, none)[0].agg(F.count("*").alias("n"))


@query("page_links", "SELECT doc_id, 'd' || (doc_id // 2) || ',x y,d' || (doc_id // 2) AS links, 'd' || (doc_id // 2) AS slug, 'two' AS label FROM documents")
def page_links(spark, sf_dir):
    """Links of pages in order, repeats kept, and the parts of one."""
    half = F.floor(F.col("doc_id") / 2).cast("string")
    text = F.concat(F.lit("a [[d"), half, F.lit("|two]] b [[ x y ]] [[]] [[d"), half, F.lit("]]"))
    one = T.unwrap_wikilink(F.concat(F.lit(" [[ d"), half, F.lit("|two ]] ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.wikilinks(text), ",").alias("links"), one["slug"].alias("slug"), one["label"].alias("label"))


@query(
    "valid_groups",
    """SELECT doc_id AS group_id, 'd' || doc_id || ',d' || (doc_id + 1) AS slugs FROM documents WHERE doc_id % 4 <> 0 AND doc_id + 1 <= (SELECT max(doc_id) FROM documents)""",
)
def valid_groups(spark, sf_dir):
    """Proposed duplicates cut to pages that exist; every fourth pair was declared different before."""
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    d, i = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    groups = d.select(i.alias("group_id"), F.array(name(i + 1), name(i), name(i), F.lit("gone")).alias("slugs"))
    apart = d.where("doc_id % 4 = 0").select(F.array(F.upper(name(i)), name(i + 1)).alias("slugs"))
    out = H.valid_groups(groups, d.select(name(i).alias("slug")), apart)
    return out.select("group_id", F.concat_ws(",", name(F.col("group_id")), name(F.col("group_id") + 1)).alias("slugs")).where(F.size(F.split("slugs", ",")) == 2)


@query("redirected_lists", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b,C' ELSE 'b,C,z' END AS related FROM documents")
def redirected_lists(spark, sf_dir):
    """List entries led to what replaces their pages, without repeats."""
    to = F.create_map(F.lit("a"), F.lit("b"), F.lit("c2"), F.lit("c"))
    have = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, ("a", "b", "C", "c2")))).otherwise(F.array(*map(F.lit, ("a", "C", "c2", "z"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(H.redirected(have, to), ",").alias("related"))
