"""Lexical retrieval, snippets and rank fusion.

Pages are scored by expressions over their own columns; a query is a literal, so nothing is joined or shuffled but the
final top-k, which Spark takes per partition first. Ties are broken by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import QUERY_PUNCTUATION, page_title

#: Weights and words of the scoring rule: fixed values.
FILE_NAME, PHRASE_IN_TITLE, PHRASE_IN_CONTENT, TITLE_TOKEN, CONTENT_TOKEN = 200, 50, 20, 5, 1
MOST_OCCURRENCES, TOP, RRF_K, SNIPPET = 10, 20, 60, 80
STOP_WORDS = "的 是 了 什么 在 有 和 与 对 从 the is a an what how are was were do does did be been being have has had it its in on at to for of with by this that these those".split()
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def query_tokens(query: Column) -> Column:
    """Distinct terms in order of first use. Terms of more than two characters with Han give their bigrams, their
    characters that are no stop words, and themselves."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    raw = F.filter(F.split(F.lower(query), f"[{QUERY_PUNCTUATION}]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))

    def expand(t: Column) -> Column:
        n = F.length(t)
        grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))
        chars = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(1))), lambda c: ~F.array_contains(stop, c))
        return F.when(t.rlike(CJK) & (n > 2), F.concat(grams, chars, F.array(t))).otherwise(F.array(t))

    tokens = F.array_distinct(F.flatten(F.transform(raw, expand)))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def query_terms(query: Column) -> Column:
    """The tokens, or the whole query where it has none."""
    tokens = query_tokens(query)
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lower(query)))


def query_phrase(query: Column) -> Column:
    """The query without surrounding punctuation, lower case."""
    p = QUERY_PUNCTUATION
    return F.regexp_replace(F.lower(F.trim(query)), f"^[{p}]+|[{p}]+$", "")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping; an empty needle does not occur."""
    n = F.length(needle)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


def held_tokens(text_lower: Column, tokens: list[str]) -> Column:
    return sum((F.contains(text_lower, F.lit(t)).cast("int") for t in tokens), F.lit(0))


def snippet(content: Column, anchor: Column) -> Column:
    """The anchor's surroundings, or the beginning where it does not stand; line ends become spaces."""
    at = F.instr(F.lower(content), F.lower(anchor)) - 1
    start = F.greatest(F.lit(0), at - SNIPPET)
    end = F.least(F.length(content), at + F.length(anchor) + SNIPPET)
    cut = F.translate(F.substring(content, start + 1, end - start), "\n", " ")
    around = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(content), "...").otherwise(""))
    return F.when(at < 0, F.translate(F.substring(content, 1, 2 * SNIPPET), "\n", " ")).otherwise(around)


def parse_query(spark, query: str) -> tuple[str, list[str]]:
    """(phrase, terms) of one query, worked out by the column expressions above."""
    row = spark.range(1).select(query_phrase(F.lit(query)).alias("p"), query_terms(F.lit(query)).alias("t")).first()
    return row.p, list(row.t)


def score_pages(pages: DataFrame, query: str) -> DataFrame:
    """``path, file_name, content`` -> matching pages with ``title, title_match, score, snippet``. Pages without any
    signal are dropped before snippets are cut."""
    phrase, terms = parse_query(pages.sparkSession, query)
    p = F.lit(phrase)
    base = pages.select("path", "file_name", "content", page_title(F.col("content"), F.col("file_name")).alias("title"), F.lower("content").alias("_c"))
    base = base.withColumn("_t", F.lower(F.concat_ws(" ", "title", "file_name")))
    by_name = F.lower(F.regexp_replace("file_name", r"\.md$", "")) == p
    in_title = F.contains("_t", p) if phrase else F.lit(False)
    signals = base.select(
        "path", "title", "content", "_c",
        by_name.alias("_name"), in_title.alias("_in_title"),
        F.least(occurrences(F.col("_c"), p), F.lit(MOST_OCCURRENCES)).alias("_occ"),
        held_tokens(F.col("_t"), terms).alias("_tt"), held_tokens(F.col("_c"), terms).alias("_ct"),
    )
    score = F.when(F.col("_name"), FILE_NAME).otherwise(0) + F.when(F.col("_in_title"), PHRASE_IN_TITLE).otherwise(0) + PHRASE_IN_CONTENT * F.col("_occ") + TITLE_TOKEN * F.col("_tt") + CONTENT_TOKEN * F.col("_ct")
    first_held = F.coalesce(*(F.when(F.contains("_c", F.lit(t)), F.lit(t)) for t in terms), F.lit(query))
    anchor = F.when(F.col("_occ") > 0, p).otherwise(first_held)
    hits = signals.withColumn("score", score.cast("double")).where("score > 0")
    return hits.select("path", "title", ((F.col("_tt") > 0) | F.col("_in_title")).alias("title_match"), "score", snippet(F.col("content"), anchor).alias("snippet"))


def top_pages(scored: DataFrame, n: int = TOP) -> DataFrame:
    return scored.orderBy(F.desc("score"), "path").limit(n)


def ranked(df: DataFrame, by: str = "score", tie: str = "path", keep: int | None = None) -> DataFrame:
    """With ``rank`` from 1. A total order needs one partition, so the top ``keep`` rows are taken first."""
    if keep is not None:
        df = df.orderBy(F.desc(by), tie).limit(keep)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))


def fuse(lexical: DataFrame, vector: DataFrame, key: str, n: int = TOP, k: int = RRF_K, by: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``key, rank``), the best ``n``: ``key, lexical_rank, vector_rank, rrf``. With
    ``by``, a column of both, each of its values has lists of its own."""
    keys = [by, key] if by else [key]
    a = lexical.select(*keys, F.col("rank").alias("lexical_rank"))
    b = vector.select(*keys, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    fused = a.join(b, keys, "full_outer").withColumn("rrf", part("lexical_rank") + part("vector_rank"))
    if not by:
        return fused.orderBy(F.desc("rrf"), key).limit(n)
    # sums of equal ranks come out alike, whichever list gives them
    best = Window.partitionBy(by).orderBy(F.desc(F.round("rrf", 12)), key)
    return fused.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).drop("r")


def image_hits(pages: DataFrame, query: str) -> DataFrame:
    """Images of pages whose caption holds a query term, first by URL; caption matches come first."""
    _, terms = parse_query(pages.sparkSession, query)
    refs = F.expr(r"transform(regexp_extract_all(content, '!\\[[^\\]]*\\]\\([^)\\s]+\\)', 0), m -> struct(regexp_extract(m, '!\\[([^\\]]*)\\]', 1) AS alt, regexp_extract(m, '\\]\\(([^)\\s]+)\\)', 1) AS url))")
    images = pages.select("path", F.posexplode(refs).alias("pos", "r")).select("path", "pos", "r.alt", "r.url")
    one = images.groupBy("url").agg(F.min_by("alt", F.struct("path", "pos")).alias("alt"), F.min("path").alias("path"))
    return one.withColumn("caption_match", held_tokens(F.lower("alt"), terms) > 0).orderBy(F.desc("caption_match"), "url")


def context_budget(size: Column) -> Column:
    """Character budgets for a context size; 204 800 where none is given."""
    ctx = F.when(F.coalesce(size, F.lit(0)) > 0, size).otherwise(F.lit(204800))
    pages = F.floor(ctx * 0.5)
    return F.struct(
        ctx.cast("long").alias("max_ctx"), F.floor(ctx * 0.15).alias("response_reserve"), F.floor(ctx * 0.05).alias("index_budget"), pages.alias("page_budget"),
        F.least(pages, F.greatest(F.lit(5000).cast("long"), F.floor(pages * 0.3))).alias("max_page_size"),
    )
