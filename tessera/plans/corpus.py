"""The driver's tables seen as a linked corpus: pages with names and contents, nodes, links and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, file_name, content``: each document as a page named after its source and id."""
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/"), name).alias("path"), name.alias("file_name"), F.col("text").alias("content"))


HREF = r'<a href="/?([^"]*)"'


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, target``: every link of every web page, in order, repeats kept."""
    links = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.explode(links).alias("target")).where("target <> ''")


#: Types of page nodes by id, and of term nodes by length: they only have to be spread over the types.
PAGE_TYPES = ("source", "synthesis", "query", "source")
TERM_TYPES = ("entity", "concept", "overview", "entity", "concept")


def web_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (source: their host) and the terms that they link to (source: their first letter)."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.element_at(F.array(*map(F.lit, PAGE_TYPES)), (F.col("page_id") % 4 + 1).cast("int")).alias("type"),
        F.concat(F.lit("wiki/sources/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.array(F.regexp_extract("url", "//([^/]+)", 1)).alias("sources"),
    )
    terms = web_links(spark, sf_dir).select("target").distinct()
    terms = terms.select(
        F.col("target").alias("id"),
        F.col("target").alias("title"),
        F.element_at(F.array(*map(F.lit, TERM_TYPES)), (F.length("target") % 5 + 1).cast("int")).alias("type"),
        F.concat(F.lit("wiki/terms/"), "target", F.lit(".md")).alias("path"),
        F.array(F.lower(F.substring("target", 1, 1))).alias("sources"),
    )
    return pages.unionByName(terms)


SQL_LINKS = """
links AS (SELECT 'p' || page_id AS src, unnest(regexp_extract_all(html, '<a href="/?([^"]*)"', 1)) AS target FROM pages),
good AS (SELECT * FROM links WHERE target <> '' AND target <> src),
nodes AS (
  SELECT 'p' || page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         ['source', 'synthesis', 'query', 'source'][page_id % 4 + 1] AS type, 'wiki/sources/p' || page_id || '.md' AS path,
         [regexp_extract(url, '//([^/]+)', 1)] AS sources FROM pages
  UNION ALL
  SELECT DISTINCT target, target, ['entity', 'concept', 'overview', 'entity', 'concept'][length(target) % 5 + 1],
         'wiki/terms/' || target || '.md', [lower(substr(target, 1, 1))] FROM links WHERE target <> ''),
directed AS (SELECT DISTINCT src, target AS dst FROM good),
edges AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM directed),
degrees AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM directed UNION ALL SELECT dst FROM directed) GROUP BY 1),
counts AS (SELECT n.id, count(e.id) AS link_count FROM nodes n LEFT JOIN (SELECT src AS id FROM good UNION ALL SELECT target FROM good) e ON n.id = e.id GROUP BY 1),
nb AS (SELECT a AS id, b AS n FROM edges UNION ALL SELECT b, a FROM edges),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS n_common, sum(1e0 / ln(greatest(d.degree, 2))) AS aa
           FROM nb x JOIN nb y ON x.n = y.n AND x.id < y.id JOIN degrees d ON d.id = x.n GROUP BY 1, 2),
direct AS (SELECT a, b, 3e0 * count(*) AS v FROM (SELECT src AS a, dst AS b FROM directed UNION ALL SELECT dst, src FROM directed) GROUP BY 1, 2),
shared AS (SELECT x.id AS a, y.id AS b, 4e0 * count(*) AS v FROM (SELECT DISTINCT id, unnest(sources) AS s FROM nodes) x
           JOIN (SELECT id, unnest(sources) AS s FROM nodes) y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
aff AS (SELECT * FROM (VALUES {affinity}) t(ta, tb, w)),
total AS (SELECT a, b, sum(v) AS v FROM (SELECT * FROM direct UNION ALL SELECT * FROM shared
          UNION ALL SELECT a, b, 1.5e0 * aa FROM common UNION ALL SELECT b, a, 1.5e0 * aa FROM common) GROUP BY 1, 2),
rel AS (SELECT t.a, t.b, t.v + coalesce(f.w, 0.5e0) AS relevance FROM total t JOIN nodes x ON x.id = t.a JOIN nodes y ON y.id = t.b
        LEFT JOIN aff f ON f.ta = x.type AND f.tb = y.type),
community AS (SELECT id, CASE WHEN starts_with(path, 'wiki/sources') THEN sources[1] ELSE lower(substr(id, 1, 1)) END AS community FROM nodes)
"""


def graph_sql(select: str) -> str:
    from tessera.operators.graph import AFFINITY

    rows = ", ".join(f"('{a}', '{b}', {v}e0)" for (a, b), v in AFFINITY.items())
    return "WITH " + SQL_LINKS.replace("{affinity}", rows).strip() + "\n" + select
