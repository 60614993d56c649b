"""Retrieval queries over documents, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.operators.text_index import TextIndex
from tessera.operators.vector_index import VectorIndex, recall
from tessera.plans.corpus import document_pages, table
from tessera.plans.registry import query
from tessera.session import shared_dir

QUERY = "the andthe thation, of heting"
STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
PUNCT = r"[\s,，。！？、；：\"''（）()\-_/\\·~～…]+".replace("''", "''''")


def _tokens_sql(expr: str) -> str:
    """DuckDB for the tokens of texts without Han."""
    return f"list_filter(string_split_regex(lower({expr}), '{PUNCT}'), lambda t: length(t) > 1 AND NOT list_contains([{STOP}], t))"


#: Questions with Han and odd punctuation, and their terms.
ASKED = [
    ("注意力机制", "力 力机 制 机 机制 意 意力 注 注意 注意力机制"), ("什么是 attention", "attention 么是 什 什么 什么是 么"), ("的 是", ""), ("默会知识。", "会 会知 知 知识 识 默 默会 默会知识"),
    ("The KV-cache!", "cache! kv"), ("a b cd", "cd"), ("注意", "注意"), ("", ""),
]
ASKED = [(q, " ".join(sorted(t.split()))) for q, t in ASKED]


@query(
    "query_tokens",
    f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct({_tokens_sql('text')})), ' ') AS tokens FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, 0, '{t}')" for i, (_, t) in enumerate(ASKED)) + ")",
)
def query_tokens(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1 - i).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(q).alias("text")) for i, (q, _) in enumerate(ASKED)))).alias("x")).select("x.*")
    return users.union(more).select("conv_id", "turn", F.array_join(F.array_sort(R.query_tokens(F.col("text"))), " ").alias("tokens"))


TERMS = ["andthe", "thation", "heting"]
PHRASE = "the andthe thation, of heting"


def scored_sql(phrase: str, terms: list[str], query: str) -> str:
    """The top pages of one query (without Han), ``top``, with where their snippets start, ``placed``."""
    held = lambda col: " + ".join(f"contains({col}, '{t}')::INT" for t in terms)
    return f"""
scored AS (
  SELECT 'wiki/' || f AS path, t AS title, content, s.tt > 0 OR contains(lt, '{phrase}') AS title_match,
         (CASE WHEN lower(regexp_replace(f, '\\.md$', '')) = '{phrase}' THEN 200 ELSE 0 END + CASE WHEN contains(lt, '{phrase}') THEN 50 ELSE 0 END
          + 20 * least(occ, 10) + 5 * s.tt + s.ct)::DOUBLE AS score, occ, lc
  FROM (SELECT *, {held('lt')} AS tt, {held('lc')} AS ct, ((length(lc) - length(replace(lc, '{phrase}', ''))) // length('{phrase}'))::INT AS occ
        FROM (SELECT source || '-' || doc_id || '.md' AS f, replace(source || '-' || doc_id, '-', ' ') AS t, text AS content, lower(text) AS lc,
                     lower(replace(source || '-' || doc_id, '-', ' ') || ' ' || source || '-' || doc_id || '.md') AS lt FROM documents)) s),
top AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, path LIMIT 20),
anchored AS (SELECT *, CASE WHEN occ > 0 THEN '{phrase}' {' '.join(f"WHEN contains(lc, '{t}') THEN '{t}'" for t in terms)} ELSE '{query}' END AS anchor FROM top),
placed AS (SELECT *, instr(lc, anchor) - 1 AS p FROM anchored)
"""


SCORED = scored_sql(PHRASE, TERMS, QUERY)


@query(
    "search_lexical",
    f"""WITH {SCORED}
SELECT path, title, title_match, score,
  CASE WHEN p < 0 THEN replace(substr(content, 1, 160), chr(10), ' ')
  ELSE (CASE WHEN p > 80 THEN '...' ELSE '' END) || replace(substr(content, greatest(0, p - 80) + 1, least(length(content), p + length(anchor) + 80) - greatest(0, p - 80)), chr(10), ' ')
       || (CASE WHEN p + length(anchor) + 80 < length(content) THEN '...' ELSE '' END) END AS snippet
FROM placed""",
)
def search_lexical(spark, sf_dir):
    """Top pages for one query with snippets: expressions in one scan, top-k per partition."""
    return R.top_pages(R.score_pages(document_pages(spark, sf_dir), QUERY))


#: Distances of every query vector (ids divisible by 100) to all others, the nearest 30 of each.
KNN = """
near AS (SELECT query_id, vec_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)),
hits AS (SELECT query_id, vec_id, label, d, 1e0 / (1e0 + d) AS s FROM near WHERE rank <= 30)
"""


def _hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = V.nearest_of_many(e, e.where("vec_id % 100 = 0"), 30)
    return found.join(e.select("vec_id", "label"), "vec_id").withColumn("score", V.similarity(F.col("distance")))


@query("vector_nearest", f"WITH {KNN.strip()} SELECT query_id, vec_id, label, round(s, 6) AS score FROM hits")
def vector_nearest(spark, sf_dir):
    """The thirty nearest chunks of every query."""
    return _hits(spark, sf_dir).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_nearest_to_one", "SELECT vec_id, label, round(1e0 / (1e0 + d), 6) AS score FROM (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 30")
def vector_nearest_to_one(spark, sf_dir):
    """The top thirty for one given vector, the origin."""
    e = table(spark, sf_dir, "embeddings")
    size = e.select(F.size("embedding").alias("n")).limit(1).collect()
    return V.nearest(e, [0.0] * (size[0].n if size else 1), 30).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "vector_page_scores",
    f"""WITH {KNN.strip()}, p AS (SELECT query_id, label, max(s) + least(0.3e0 * (sum(s) - max(s)), greatest(0e0, 1 - max(s))) AS score, count(*) AS n_chunks FROM hits GROUP BY 1, 2)
SELECT query_id, label, round(score, 6) AS score, n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label) AS r FROM p) WHERE r <= 10""",
)
def vector_page_scores(spark, sf_dir):
    """The ten best pages of every query."""
    found = V.page_scores(_hits(spark, sf_dir), ["query_id", "label"], "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "label")
    return found.withColumn("r", F.row_number().over(best)).where("r <= 10").select("query_id", "label", F.round("score", 6).alias("score"), "n_chunks")


@query(
    "vector_nearest_of_many",
    """SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, d AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
  FROM embeddings a, embeddings b, LATERAL (SELECT sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d)
  WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""",
)
def vector_nearest_of_many(spark, sf_dir):
    """All vectors against every row whose id is divisible by 100, the stated query set."""
    e = table(spark, sf_dir, "embeddings")
    found = V.nearest_of_many(e, e.where("vec_id % 100 = 0"), 5)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def _index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return VectorIndex.build(shared_dir(spark, "vector-index"), e), e.where("vec_id % 100 = 0")


@query("vector_index_nearest", f"WITH {KNN.strip()} SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM near WHERE rank <= 10")
def vector_index_nearest(spark, sf_dir):
    """The ten nearest rows of every query, from an index of which all lists are probed."""
    index, asked = _index(spark, sf_dir)
    return index.search(asked, 10, exact=True).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("vector_index_recall", "SELECT count(*) AS n_queries, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the index, probed as it was measured to need, finds nine in ten of the true ten nearest rows of the queries."""
    index, asked = _index(spark, sf_dir)
    got = recall(index.search(asked, 10), index.search(asked, 10, exact=True))
    return asked.agg(F.count("*").alias("n_queries")).crossJoin(got.select((10 * F.col("n_found") >= 9 * F.col("n_true")).alias("reached")))  # one row each


#: Every page against the user turns of conversations whose id is divisible by 100, and the twenty best of each.
ASK = f"""
asked AS (SELECT conv_id, turn, conv_id || ':' || turn AS qid, text AS question, regexp_replace(lower(trim(text)), '^{PUNCT}|{PUNCT}$', '', 'g') AS phrase, {_tokens_sql('text')} AS toks
  FROM conversations WHERE role = 'user' AND conv_id % 100 = 0 AND text IS NOT NULL),
q AS (SELECT *, CASE WHEN len(toks) > 0 THEN toks ELSE [lower(question)] END AS terms FROM asked),
pg AS (SELECT 'wiki/' || source || '-' || doc_id || '.md' AS path, replace(source || '-' || doc_id, '-', ' ') AS title, text AS content, lower(text) AS lc,
  lower(replace(source || '-' || doc_id, '-', ' ') || ' ' || source || '-' || doc_id || '.md') AS lt, lower(source || '-' || doc_id) AS stem FROM documents WHERE text IS NOT NULL),
held AS (SELECT q.*, pg.*, list_sum(list_transform(list_distinct(terms), lambda x: contains(lt, x)::INT)) AS tt, list_sum(list_transform(list_distinct(terms), lambda x: contains(lc, x)::INT)) AS ct,
  ((length(lc) - length(replace(lc, phrase, ''))) // greatest(length(phrase), 1))::INT AS occ FROM q, pg),
graded AS (SELECT *, (tt > 0 OR (phrase <> '' AND contains(lt, phrase))) AS title_match, (CASE WHEN stem = phrase THEN 200 ELSE 0 END + CASE WHEN phrase <> '' AND contains(lt, phrase) THEN 50 ELSE 0 END + 20 * least(occ, 10) + 5 * tt + ct)::DOUBLE AS score FROM held),
topped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM graded WHERE score > 0) WHERE rank <= 20)
"""


def questions(spark, sf_dir):
    """The stated questions: user turns of conversations whose id is divisible by 100."""
    return table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 100 = 0").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")


@query(
    "search_questions",
    f"""WITH {ASK.strip()}, anchored AS (SELECT *, CASE WHEN occ > 0 THEN phrase ELSE coalesce(list_filter(terms, lambda x: contains(lc, x))[1], question) END AS anchor FROM topped),
placed AS (SELECT *, instr(lc, lower(anchor)) - 1 AS p FROM anchored)
SELECT qid, rank, path, title, title_match, score,
  CASE WHEN p < 0 THEN replace(substr(content, 1, 160), chr(10), ' ')
  ELSE (CASE WHEN p > 80 THEN '...' ELSE '' END) || replace(substr(content, greatest(0, p - 80) + 1, least(length(content), p + length(anchor) + 80) - greatest(0, p - 80)), chr(10), ' ')
       || (CASE WHEN p + length(anchor) + 80 < length(content) THEN '...' ELSE '' END) END AS snippet
FROM placed""",
)
def search_questions(spark, sf_dir):
    """The twenty best pages of every stated question, from a positional index of all pages."""
    index = TextIndex.build(shared_dir(spark, "text-index"), document_pages(spark, sf_dir))
    return index.search(questions(spark, sf_dir))


@query(
    "search_hybrid",
    f"""WITH {ASK.strip()}, {KNN.strip()},
lex AS (SELECT conv_id AS query_id, path, rank FROM topped WHERE turn = 0 AND conv_id IN (SELECT vec_id FROM embeddings)),
vec AS (SELECT query_id, 'wiki/' || d.source || '-' || d.doc_id || '.md' AS path, row_number() OVER (PARTITION BY query_id ORDER BY h.d, h.vec_id) AS rank FROM hits h JOIN documents d ON d.doc_id = h.vec_id),
fused AS (SELECT query_id, path, l.rank AS lexical_rank, v.rank AS vector_rank, coalesce(1e0 / (60 + l.rank), 0) + coalesce(1e0 / (60 + v.rank), 0) AS rrf FROM lex l FULL JOIN vec v USING (query_id, path))
SELECT query_id, path, lexical_rank, vector_rank, round(rrf, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, path) AS r FROM fused) WHERE r <= 20""",
)
def search_hybrid(spark, sf_dir):
    """For every query vector its nearest pages and those of its own question (the first turn of the conversation of its id, if
    there is one), fused by rank; vector hits count only if their page exists."""
    pages, e = document_pages(spark, sf_dir), table(spark, sf_dir, "embeddings")
    index = TextIndex.build(shared_dir(spark, "text-index"), pages)
    own = questions(spark, sf_dir).where("turn = 0").join(e.select(F.col("vec_id").alias("conv_id")).distinct(), "conv_id")
    lex = index.search(own, "conv_id").select(F.col("qid").alias("query_id"), "path", "rank")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("wiki/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    vec = docs.join(_hits(spark, sf_dir), F.col("doc_id") == F.col("vec_id")).withColumn("rank", F.row_number().over(order)).select("query_id", "path", "rank")
    return R.fuse(lex, vec, "path", by="query_id").withColumn("rrf", F.round("rrf", 9))


@query(
    "context_budget",
    """SELECT doc_id, c AS max_ctx, floor(c * 0.15e0)::BIGINT AS response_reserve, floor(c * 0.05e0)::BIGINT AS index_budget, floor(c * 0.5e0)::BIGINT AS page_budget,
  least(floor(c * 0.5e0)::BIGINT, greatest(5000, floor(floor(c * 0.5e0) * 0.3e0)::BIGINT)) AS max_page_size
FROM (SELECT doc_id, CASE WHEN n_chars > 100 THEN n_chars * 10 ELSE 204800 END AS c FROM documents)""",
)
def context_budget(spark, sf_dir):
    size = F.when(F.col("n_chars") > 100, F.col("n_chars") * 10).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", R.context_budget(size).alias("b")).select("doc_id", "b.*")
