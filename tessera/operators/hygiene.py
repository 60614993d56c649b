"""Hygiene of a page corpus: lint, list fields, dead links, merges' bookkeeping, reviews and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import file_name, group_key, link_key, page_sources, review_title

# lists


def union_ci(*lists: Column) -> Column:
    """Union without regard to case: first spelling, first place."""
    every = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def minus_ci(values: Column, gone: Column) -> Column:
    lower = F.transform(gone, F.lower)
    return F.filter(values, lambda x: ~F.array_contains(lower, F.lower(x)))


def source_fate(sources: Column, source: Column) -> Column:
    """What deleting a source does to a page: ``skip`` if it is not listed, ``keep`` with the others, or ``delete``."""
    left = F.filter(sources, lambda x: F.lower(x) != F.lower(source))
    return F.when(F.size(left) == F.size(sources), "skip").when(F.size(left) > 0, "keep").otherwise("delete")


def redirected(values: Column, redirects: Column) -> Column:
    """Values mapped to what replaces them, then without repeats."""
    return union_ci(F.transform(values, lambda x: F.coalesce(F.element_at(redirects, x), x)))


# lint


def lint_structure(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``type, severity, page, link``: orphans, pages without links, broken links (one row per occurrence).

    ``pages``: slug; ``links``: slug, target. Targets match slugs without regard to case, by whole slug or last part.
    """
    known = pages.select(F.lower("slug").alias("k")).distinct()
    by_base = pages.select(F.lower(file_name(F.col("slug"))).alias("k")).distinct()
    keys = known.union(by_base).distinct()
    inbound = links.select(F.lower("target").alias("k")).distinct()
    row = lambda df, kind, severity, link: df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("slug").alias("page"), link.cast("string").alias("link"))
    orphans = pages.withColumn("k", F.lower("slug")).join(inbound, "k", "left_anti")
    silent = pages.join(links.select("slug").distinct(), "slug", "left_anti")
    at = links.withColumn("k", F.lower("target")).join(keys, "k", "left_anti").drop("k")
    broken = at.withColumn("k", F.lower(F.regexp_replace(file_name(F.col("target")), r"\.md$", ""))).join(keys, "k", "left_anti")
    none = F.lit(None)
    return row(orphans, "orphan", "info", none).union(row(silent, "no-outlinks", "info", none)).union(row(broken, "broken-link", "warning", F.col("target")))


# cleaning after deletions


def deleted_keys(pages: DataFrame) -> DataFrame:
    """``key``: both the slug and the title of every deleted page, normalised."""
    return pages.select(F.explode(F.array("slug", "title")).alias("x")).select(link_key(F.col("x")).alias("key")).where("key <> ''").distinct()


def clean_index(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Contents without list lines whose first link is a deleted page: lines are joined with the keys and put together
    again, so neither the keys nor a page's lines have to be few."""
    subject = lambda line: F.regexp_extract(line, r"^\s*[-*]\s*\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]", 1)
    lines = pages.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).withColumn("key", link_key(F.trim(subject(F.col("line")))))
    gone = keys.withColumn("_gone", F.lit(True))
    kept = lines.join(gone, "key", "left").where("_gone IS NULL OR key = ''")
    text = kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l")).select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    return pages.select("path").join(text, "path", "left").select("path", F.coalesce("content", F.lit("")).alias("content"))


def dead_links(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """``path, dead``: the links of each page that point to deleted pages, as written."""
    found = F.regexp_extract_all("content", F.lit(r"\[\[[^\]|]+?(?:\|[^\]]+)?\]\]"), F.lit(0))
    each = pages.select("path", F.explode(F.array_distinct(found)).alias("link")).withColumn("key", link_key(F.trim(F.regexp_extract("link", r"\[\[([^\]|]+?)(?:\||\]\])", 1))))
    return each.join(keys, "key", "left_semi").groupBy("path").agg(F.sort_array(F.collect_set("link")).alias("dead"))


def strip_dead_links(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Dead links replaced by their label, or target, in every page that has any."""
    dead = pages.join(dead_links(pages, keys), "path", "left")
    plain = lambda link: F.regexp_replace(link, r"^\[\[(?:[^\]|]+?\|)?([^\]]+)\]\]$", "$1")
    text = F.aggregate("dead", F.col("content"), lambda acc, link: F.replace(acc, link, plain(link)))
    return dead.select("path", F.when(F.col("dead").isNull(), F.col("content")).otherwise(text).alias("content"))


def related_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``path, source``: pages that quote a source's name, lie under a ``sources`` folder with a name that begins with its
    stem, or list it in their front matter. Each page gives the keys by which it can be named (what stands between
    two quotes, the beginnings of its own name, its list), and keys meet names in equal joins, so neither side has to be
    small. Without regard to case but for what is quoted."""
    names = sources.select("source").distinct()
    stems = names.select("source", F.lower(F.regexp_replace("source", r"(?<=.)\.[^.]*$", "")).alias("key"))
    listed = pages.select("path", F.explode(F.transform(page_sources(F.col("content")), F.lower)).alias("key"))
    parts = F.split("content", '"')
    quoted = pages.where(F.size(parts) > 2).select("path", F.explode(F.array_distinct(F.slice(parts, 2, F.size(parts) - 2))).alias("key"))
    own = F.lower(file_name(F.col("path")))
    begins = pages.where(F.col("path").rlike("(^|/)sources/") & (F.length(own) > 0)).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: F.substring(own, F.lit(1), i))).alias("key"))
    lower = names.select("source", F.lower("source").alias("key"))
    met = quoted.join(names.select("source", F.col("source").alias("key")), "key").union(begins.join(stems, "key").select("key", "path", "source")).union(listed.join(lower, "key"))
    return met.select("path", "source").distinct()


# duplicates


def valid_groups(groups: DataFrame, slugs: DataFrame, whitelist: DataFrame) -> DataFrame:
    """``group_id, slugs``: proposed groups cut to existing slugs, of two or more, and not declared different."""
    member = groups.select("group_id", F.explode(F.array_distinct("slugs")).alias("slug")).join(slugs.select("slug").distinct(), "slug", "left_semi")
    kept = member.groupBy("group_id").agg(F.sort_array(F.collect_list("slug")).alias("slugs")).where(F.size("slugs") >= 2)
    return kept.withColumn("key", group_key(F.col("slugs"))).join(whitelist.select(group_key(F.col("slugs")).alias("key")).distinct(), "key", "left_anti").drop("key")


def title_duplicates(pages: DataFrame) -> DataFrame:
    """``key, slug, n``: candidate groups without a judge, pages of one normalised title, one row a page; ``n``: the pages of
    the group. Only counts are grouped, so a title may be that of very many pages."""
    k = pages.select(link_key(F.col("title")).alias("key"), "slug").where("key <> ''")
    return k.join(k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


# caches


def cache_misses(incoming: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """Sources to ingest: no entry of the same name and content hash, or one whose written files are not all there.

    ``incoming``: name, content; ``cache``: name, hash, files_written; ``files``: path.
    """
    lost = cache.select("name", F.explode("files_written").alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("name").distinct()
    good = cache.join(lost, "name", "left_anti").select("name", "hash")
    return incoming.withColumn("hash", F.sha2("content", 256)).join(good, ["name", "hash"], "left_anti")


def stale_extractions(sources: DataFrame, extracted: DataFrame) -> DataFrame:
    """Sources without an extraction at least as new: ``path, modificationTime``."""
    fresh = extracted.select("path", F.col("modificationTime").alias("_at"))
    return sources.join(fresh, "path", "left").where("_at IS NULL OR _at < modificationTime").drop("_at")


# reviews


def merge_reviews(items: DataFrame) -> DataFrame:
    """Items of one kind and normalised title become one, in order of arrival (``seq``): the last given description and
    source win, pages and queries are united, id and title are the first's."""
    k = items.withColumn("key", review_title(F.col("title")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    g = k.groupBy("type", "key").agg(
        F.min_by("id", "seq").alias("id"), F.min_by("title", "seq").alias("title"), last("description").alias("description"), last("source_path").alias("source_path"), F.count("*").alias("n_merged"),
    )
    for c in ("affected_pages", "search_queries"):
        # values are made distinct as rows, so that a title of very many items never has all their lists in one row
        each = k.select("type", "key", "seq", F.posexplode(c).alias("pos", "v")).groupBy("type", "key", "v").agg(F.min(F.struct("seq", "pos")).alias("at"))
        united = each.groupBy("type", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(c))
        kind = k.schema[c].dataType.simpleString()
        right = united.select(F.col("type").alias("_t"), F.col("key").alias("_k"), c)
        g = g.join(right, F.col("type").eqNullSafe(F.col("_t")) & F.col("key").eqNullSafe(F.col("_k")), "left").drop("_t", "_k").withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return g.select("id", "type", "title", "key", "description", "source_path", "affected_pages", "search_queries", "n_merged")


def resolved_by_rule(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """``id`` of items that the corpus settles: missing pages that exist by id, hyphenated id or title, and duplicates of
    which some page is gone. ``reviews``: id, type, title, affected_pages; ``pages``: id, title."""
    base = lambda x: F.lower(F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"\.md$", ""))
    ids = pages.select(F.lower("id").alias("k")).distinct()
    names = pages.select(F.explode(F.array(F.lower("id"), F.lower("title"))).alias("k")).where("k <> ''").distinct()
    title = review_title(F.col("title"))
    wanted = F.array_compact(F.concat(F.array(F.when((F.length(title) > 0) & (F.length(title) <= 100), title)), F.transform(F.coalesce("affected_pages", F.array().cast("array<string>")), base)))
    missing = reviews.where("type = 'missing-page'").select("id", F.explode(wanted).alias("n"))
    found = missing.select("id", F.explode(F.array("n", F.regexp_replace("n", r"\s+", "-"))).alias("k")).join(names, "k", "left_semi").select("id")
    gone = reviews.where("type = 'duplicate'").select("id", F.explode("affected_pages").alias("p")).withColumn("k", base(F.col("p"))).join(ids, "k", "left_anti").select("id")
    return found.union(gone).distinct()


def judge_batches(pending: DataFrame, size: int = 40, most: int = 5) -> DataFrame:
    """Items left to a judge, numbered in batches; beyond ``most`` batches they wait for the next sweep."""
    order = Window.orderBy("id")
    top = pending.orderBy("id").limit(size * most)
    return top.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: how repeated URLs, images and recent projects are thinned out."""
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*order, F.struct(*rest).alias("_r")))
    return df.groupBy(*key).agg(first.alias("_x")).select(*key, *(F.col(f"_x._r.{c}").alias(c) for c in rest))
