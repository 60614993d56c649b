"""Link-graph queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import insights as I
from tessera.operators.graph_versions import GraphVersions
from tessera.plans.corpus import graph_sql, web_links, web_nodes
from tessera.plans.registry import query
from tessera.session import shared_dir, stored


def _graph(spark, sf_dir):
    nodes = web_nodes(spark, sf_dir)
    return nodes, web_links(spark, sf_dir).withColumnRenamed("target", "dst").where("src <> dst")


def _communities(nodes):
    return nodes.select("id", F.when(F.col("path").startswith("wiki/sources"), F.col("sources")[0]).otherwise(F.lower(F.substring("id", 1, 1))).alias("community"))


@query("graph_resolved_links", graph_sql("SELECT src, target AS dst, count(*) AS n FROM good GROUP BY 1, 2"))
def graph_resolved_links(spark, sf_dir):
    found = G.resolve_links(web_nodes(spark, sf_dir), web_links(spark, sf_dir))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("graph_link_counts", graph_sql("SELECT n.id, n.type, link_count, coalesce(degree, 0) AS degree FROM nodes n JOIN counts USING (id) LEFT JOIN degrees USING (id)"))
def graph_link_counts(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    out = nodes.select("id", "type").join(G.link_counts(nodes, links), "id").join(G.set_degrees(links), "id", "left")
    return out.select("id", "type", "link_count", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("graph_edges", graph_sql("SELECT * FROM edges"))
def graph_edges(spark, sf_dir):
    return G.undirected(_graph(spark, sf_dir)[1])


@query("graph_common_neighbours", graph_sql("SELECT a, b, n_common, round(aa, 6) AS adamic_adar FROM common"))
def graph_common_neighbours(spark, sf_dir):
    found = G.common_neighbours(_graph(spark, sf_dir)[1])
    return found.select("a", "b", "n_common", F.round("adamic_adar", 6).alias("adamic_adar"))


@query("graph_shared_sources", graph_sql("SELECT a, b, (v / 4)::BIGINT AS n_shared FROM shared"))
def graph_shared_sources(spark, sf_dir):
    return G.shared_sources(web_nodes(spark, sf_dir))


@query("graph_relevance", graph_sql("SELECT a, b, round(relevance, 6) AS relevance FROM rel"))
def graph_relevance(spark, sf_dir):
    return G.relevance(*_graph(spark, sf_dir)).withColumn("relevance", F.round("relevance", 6))


@query("graph_versions", graph_sql("SELECT a, b, round(relevance, 6) AS relevance FROM rel"))
def graph_versions(spark, sf_dir):
    """The same relevance, reached in three versions: pages that lack, change and lose links and sources on the way."""
    nodes = web_nodes(spark, sf_dir)
    links = web_links(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.collect_list("target").alias("links"))
    pages = stored(nodes.join(links, "id", "left").select("id", "type", "sources", F.coalesce("links", F.array().cast("array<string>")).alias("links")))
    part = F.pmod(F.xxhash64("id"), F.lit(50))
    graph = GraphVersions(spark, shared_dir(spark, "graph"))
    other = pages.where(part == 1).select(F.concat(F.lit("gone-"), "id").alias("id"), "type", "sources", "links")
    changed = pages.where(part == 2).select("id", F.lit("query").alias("type"), F.array(F.lit("elsewhere"), F.lit("elsewhere")).alias("sources"), F.slice("links", 1, 1).alias("links"))
    graph.advance(pages.where(part > 2).unionByName(other).unionByName(changed))
    graph.advance(pages.where(part <= 1))
    graph.advance(pages.where(part == 2), other.select("id"))
    return graph.relevance().withColumn("relevance", F.round("relevance", 6))


RELATED = "SELECT a, b, round(relevance, 6) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(relevance, 9) DESC, b) AS rank FROM rel WHERE relevance >= 2) WHERE rank <= 3"


@query("graph_related", graph_sql(RELATED))
def graph_related(spark, sf_dir):
    found = G.most_related(*_graph(spark, sf_dir), 3, 2.0)
    return found.select("a", "b", F.round("relevance", 6).alias("relevance"), "rank")


@query(
    "graph_expansion",
    graph_sql(
        """, near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(relevance, 9) DESC, b) AS rank FROM rel),
seeds AS (SELECT 'p' || page_id AS id, page_id AS pos FROM pages WHERE page_id % 100 = 0),
hits AS (SELECT n.b AS id, n.relevance, s.id AS seed, row_number() OVER (PARTITION BY n.b ORDER BY s.pos, n.rank) AS r
         FROM near n JOIN seeds s ON s.id = n.a WHERE n.rank <= 3 AND n.relevance >= 2 AND n.b NOT IN (SELECT id FROM seeds))
SELECT id, round(relevance, 6) AS relevance, seed FROM hits WHERE r = 1"""
    ),
)
def graph_expansion(spark, sf_dir):
    """Neighbours of the pages whose id is divisible by 100, the seeds themselves excluded; only their pairs are scored."""
    nodes, links = _graph(spark, sf_dir)
    number = F.substring("id", 2, 20).try_cast("long")
    seeds = nodes.where(F.col("path").startswith("wiki/sources/") & (number % 100 == 0)).select("id", number.alias("pos"))
    return G.expand(seeds, G.relevance(nodes, links, seeds)).select("id", F.round("relevance", 6).alias("relevance"), "seed")


@query("graph_type_counts", graph_sql("SELECT type, count(*) AS n, max(link_count) AS most_links FROM nodes JOIN counts USING (id) GROUP BY type"))
def graph_type_counts(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return nodes.join(G.link_counts(nodes, links), "id").groupBy("type").agg(F.count("*").alias("n"), F.max("link_count").alias("most_links"))


FILTERED = """, shown AS (SELECT n.id FROM nodes n JOIN counts USING (id) WHERE type NOT IN ('query') AND type <> 'overview'
  AND lower(id) NOT IN ('index', 'overview', 'log', 'schema', 'purpose') AND link_count > 0 AND link_count <= 40)
SELECT a, b FROM edges WHERE a IN (SELECT id FROM shown) AND b IN (SELECT id FROM shown)"""


@query("graph_filtered", graph_sql(FILTERED))
def graph_filtered(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    counted = nodes.join(G.link_counts(nodes, links), "id")
    return G.filter_graph(counted, G.undirected(links), hidden_types=["query"], hide_isolated=True, max_links=40)[1]


COHESION = """, inner_edges AS (SELECT x.community, count(*) AS n FROM edges JOIN community x ON x.id = a JOIN community y ON y.id = b WHERE x.community = y.community GROUP BY 1),
comm AS (SELECT c.community, count(*) AS n_nodes, coalesce(any_value(i.n), 0) AS n_edges,
  coalesce(any_value(i.n), 0) / (CASE WHEN count(*) > 1 THEN count(*) * (count(*) - 1) / 2e0 ELSE 1e0 END) AS cohesion
  FROM community c LEFT JOIN inner_edges i USING (community) GROUP BY 1)"""


@query("graph_cohesion", graph_sql(COHESION + " SELECT community, n_nodes, n_edges, round(cohesion, 6) AS cohesion FROM comm"))
def graph_cohesion(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return G.cohesion(_communities(nodes), G.undirected(links)).withColumn("cohesion", F.round("cohesion", 6))


FULL = """, full_nodes AS (SELECT n.id, n.title, n.type, c.link_count, m.community FROM nodes n JOIN counts c USING (id) JOIN community m USING (id)),
weighted AS (SELECT e.a, e.b, coalesce(r.relevance, 1) AS weight FROM edges e LEFT JOIN rel r ON r.a = e.a AND r.b = e.b)"""


@query(
    "graph_surprising",
    graph_sql(
        FULL
        + """, s AS (SELECT w.a, w.b,
  (x.community <> y.community)::INT * 3 + (CASE WHEN x.type = y.type THEN 0 WHEN x.type || '-' || y.type IN ('source-concept', 'concept-source', 'source-synthesis', 'synthesis-source', 'query-entity', 'entity-query') THEN 2 ELSE 1 END)
  + (CASE WHEN least(x.link_count, y.link_count) <= 2 AND greatest(x.link_count, y.link_count) >= 0.5e0 * (SELECT greatest(max(link_count), 1) FROM counts) THEN 2 ELSE 0 END)
  + (weight > 0 AND weight < 2)::INT AS score
  FROM weighted w JOIN full_nodes x ON x.id = w.a JOIN full_nodes y ON y.id = w.b WHERE x.id NOT IN ('index', 'log', 'overview') AND y.id NOT IN ('index', 'log', 'overview'))
SELECT a, b, score::INT AS score, a || ':::' || b AS key FROM s WHERE score >= 3 ORDER BY score DESC, key LIMIT 5"""
    ),
)
def graph_surprising(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    full = nodes.join(G.link_counts(nodes, links), "id").join(_communities(nodes), "id")
    edges = G.undirected(links)
    weights = edges.join(G.relevance_between(nodes, links, edges), ["a", "b"], "left").select("a", "b", F.coalesce("relevance", F.lit(1.0)).alias("weight"))
    return I.surprising(full, weights).select("a", "b", "score", "key")


@query(
    "graph_gaps",
    graph_sql(
        COHESION
        + FULL
        + """, bridge AS (SELECT id, count(DISTINCT community) AS n FROM (SELECT a AS id, community FROM edges JOIN community ON id = b UNION ALL SELECT b, community FROM edges JOIN community ON id = a) GROUP BY 1
  HAVING n >= 3 ORDER BY n DESC, id LIMIT 3),
isolated AS (SELECT 'isolated-node' AS type, 0 AS section, '' AS key, count(*) AS n FROM full_nodes WHERE link_count <= 1 AND type <> 'overview' AND id NOT IN ('index', 'log') HAVING count(*) > 0),
parts AS (SELECT * FROM isolated UNION ALL SELECT 'sparse-community', 1, community, n_nodes FROM comm WHERE cohesion < 0.15e0 AND n_nodes >= 3
  UNION ALL SELECT 'bridge-node', 2, id, n FROM bridge WHERE id NOT IN ('index', 'log', 'overview'))
SELECT type, key, n FROM (SELECT *, row_number() OVER (ORDER BY section, CASE WHEN section = 2 THEN -n ELSE 0 END, key) AS r FROM parts) WHERE r <= 8"""
    ),
)
def graph_gaps(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    full = nodes.join(G.link_counts(nodes, links), "id").join(_communities(nodes), "id")
    return I.knowledge_gaps(full, G.undirected(links)).select("type", "key", "n")


@query("graph_communities")
def graph_communities(spark, sf_dir):
    """Communities found by distributed modularity moves, with their cohesion and best-linked members. No SQL: the tests hold
    the operator's modularity against known partitions."""
    nodes, links = _graph(spark, sf_dir)
    edges = G.undirected(links)
    found = G.communities(nodes.select("id"), edges.withColumn("weight", F.lit(1.0)))
    labels = nodes.select("id", "title").join(G.link_counts(nodes, links), "id")
    return G.community_table(found, edges, labels)


LINT = """, said AS (SELECT src, target FROM links WHERE target <> '' UNION ALL SELECT 'p' || page_id, 'P' || (2 * page_id + 1) FROM pages UNION ALL SELECT 'p' || page_id, 'x/and.md' FROM pages),
inbound AS (SELECT lower(target) AS k, count(*) AS n FROM said GROUP BY 1),
keys AS (SELECT DISTINCT lower(id) AS k FROM nodes)
SELECT 'orphan' AS type, 'info' AS severity, id AS page, NULL AS link FROM nodes LEFT JOIN inbound ON lower(id) = k WHERE n IS NULL
UNION ALL SELECT 'no-outlinks', 'info', id, NULL FROM nodes WHERE id NOT IN (SELECT src FROM said)
UNION ALL SELECT 'broken-link', 'warning', src, target FROM said WHERE lower(target) NOT IN (SELECT k FROM keys)
  AND lower(regexp_replace(regexp_extract(target, '([^/]*)$', 1), '\\.md$', '')) NOT IN (SELECT k FROM keys)"""


@query("lint_structure", graph_sql(LINT))
def lint_structure(spark, sf_dir):
    """Orphans, pages without links and broken links of all nodes. Each page also links, in capitals, to the page of twice its
    number and one, which exists for the first half, and to a file whose name is a term."""
    from tessera.operators.hygiene import lint_structure as lint

    nodes, links = web_nodes(spark, sf_dir), web_links(spark, sf_dir)
    pages = nodes.where("path LIKE 'wiki/sources/%'").select("id", F.substring("id", 2, 20).try_cast("long").alias("n"))
    more = pages.select("id", F.explode(F.array(F.concat(F.lit("P"), (2 * F.col("n") + 1).cast("string")), F.lit("x/and.md"))).alias("target"))
    return lint(nodes.select(F.col("id").alias("slug")), links.union(more).withColumnRenamed("src", "slug"))


@query("lint_severity", graph_sql(LINT.replace("SELECT 'orphan' AS type", "SELECT severity, count(*) AS n FROM (SELECT 'orphan' AS type") + ") GROUP BY severity"))
def lint_severity(spark, sf_dir):
    """Findings by severity."""
    return lint_structure(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
