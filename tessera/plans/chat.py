"""Conversation queries."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators import retrieval as R
from tessera.plans.corpus import document_pages, table
from tessera.plans.registry import query


@query("chat_history", "SELECT conv_id, turn, role, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations WHERE role IN ('user', 'assistant')) WHERE pos <= 10")
def chat_history(spark, sf_dir):
    return C.last_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "pos")


@query("chat_summaries", "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 50) AS title FROM conversations GROUP BY conv_id")
def chat_summaries(spark, sf_dir):
    return C.summaries(table(spark, sf_dir, "conversations"))


@query("chat_without_last_answer", "SELECT conv_id, turn, role FROM conversations c WHERE NOT (role = 'assistant' AND turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND role = 'assistant'))")
def chat_without_last_answer(spark, sf_dir):
    return C.without_last_answer(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("chat_latest", "SELECT conv_id, last_turn FROM (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1) ORDER BY last_turn DESC, conv_id LIMIT 20")
def chat_latest(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return s.orderBy(F.desc("last_turn"), "conv_id").limit(20)


CITED = "CASE WHEN turn % 4 = 1 THEN text || ' [1] [3] [1]' WHEN turn % 4 = 3 THEN text || ' [9] <!-- cited: 2, 4 -->' ELSE text END"


@query(
    "chat_citations",
    f"""WITH a AS (SELECT conv_id, turn, {CITED} AS text FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, regexp_extract(text, '<!--\\s*cited:\\s*([0-9,\\s]+?)\\s*-->', 1) AS listed, regexp_extract_all(text, '\\[([0-9]{{1,3}})\\]', 1) AS br FROM a)
SELECT DISTINCT conv_id, turn, trim(ref)::INT AS ref FROM (SELECT conv_id, turn, unnest(CASE WHEN listed <> '' THEN string_split(listed, ',') ELSE br END) AS ref FROM c)""",
)
def chat_citations(spark, sf_dir):
    """Answers with references added by turn, resolved to the numbers that they cite."""
    mod = F.col("turn") % 4
    text = F.when(mod == 1, F.concat("text", F.lit(" [1] [3] [1]"))).when(mod == 3, F.concat("text", F.lit(" [9] <!-- cited: 2, 4 -->"))).otherwise(F.col("text"))
    return C.citations(table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", text))


QUESTIONS = ("the andthe thation", "ouwhea rend", "der und sch", "ererst of heting")
BUDGET, MOST = 20_000, 6_000


def _pack_sql() -> str:
    """Each question's top pages, scored as in ``search_lexical``, then taken one after the other while they fit."""
    from tessera.plans.retrieval import scored_sql

    parts, names = [], []
    for i, q in enumerate(QUESTIONS):
        terms = [w for w in q.split() if w not in R.STOP_WORDS]
        sql = scored_sql(q, terms, q).strip()
        for t in ("scored", "top", "anchored", "placed"):
            sql = re.sub(rf"\b{t}\b", f"{t}{i}", sql)
        parts.append(sql)
        names.append(f"SELECT {i} AS query_id, CASE WHEN title_match THEN 0 ELSE 1 END AS priority, path, content, row_number() OVER (ORDER BY score DESC, path) AS pos FROM top{i}")
    return "WITH RECURSIVE " + ", ".join(parts) + f""", cand AS ({" UNION ALL ".join(names)}),
near AS (SELECT query_id, 2 AS priority, 'wiki/' || source || '-' || doc_id || '.md' AS path, text AS content, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS query_id) q, documents WHERE doc_id < 40 AND doc_id % 5 = query_id AND ('wiki/' || source || '-' || doc_id || '.md') NOT IN (SELECT path FROM cand c WHERE c.query_id = q.query_id)),
line AS (SELECT query_id, path, CASE WHEN length(content) > {MOST} THEN {MOST} + 19 ELSE length(content) END AS n, row_number() OVER (PARTITION BY query_id ORDER BY priority, pos) AS i
  FROM (SELECT query_id, priority, path, content, pos FROM cand UNION ALL SELECT query_id, priority, path, content, pos FROM near)),
run AS (SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS number, '' AS path, 0::BIGINT AS n, FALSE AS taken FROM (SELECT DISTINCT query_id FROM line)
  UNION ALL SELECT r.query_id, l.i, CASE WHEN r.used + l.n <= {BUDGET} THEN r.used + l.n ELSE r.used END, CASE WHEN r.used + l.n <= {BUDGET} THEN r.number + 1 ELSE r.number END, l.path, l.n, r.used + l.n <= {BUDGET}
  FROM run r JOIN line l ON l.query_id = r.query_id AND l.i = r.i + 1)
SELECT query_id, number, path, n AS n_chars FROM run WHERE taken"""


@query("chat_context_pack", _pack_sql())
def chat_context_pack(spark, sf_dir):
    """What four questions are given: title hits, other hits, then related pages that are no hits (here the first documents by
    their number), packed under a budget."""
    pages = document_pages(spark, sf_dir)
    parts = []
    for i, q in enumerate(QUESTIONS):
        top = R.ranked(R.score_pages(pages, q).select("path", "title_match", "score"), keep=R.TOP)
        parts.append(top.select(F.lit(i).alias("query_id"), F.col("rank").alias("pos"), "path", "title_match"))
    hits = functools.reduce(DataFrame.union, parts)
    near = table(spark, sf_dir, "documents").where("doc_id < 40").select((F.col("doc_id") % 5).cast("int").alias("query_id"), F.concat(F.lit("wiki/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (-F.col("doc_id")).alias("relevance"))
    overview = spark.range(1).select(F.lit("wiki/overview.md").alias("path"), F.lit("all").alias("content"))
    packed = C.pack_greedily(C.context_candidates(hits, near, pages, overview), BUDGET, MOST)
    return packed.select("query_id", "number", "path", F.length("content").alias("n_chars"))
