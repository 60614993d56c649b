"""From sources to pages: routing of generated files, cascades, images, research pages, and the whole ingest as a batch.

Model calls are injected as functions from text to text; everything around them is a join or an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.functions.language import language_metadata
from tessera.functions.text import caption_text, file_name, file_stem, front_matter_value, host_name, link_key, list_field, page_type, title_slug, truncated, wikilinks, without_front_matter
from tessera.operators import hygiene as H
from tessera.operators.graph import numbered
from tessera.session import checkpointed

NOT_EMBEDDED = ("index", "log", "overview", "purpose", "schema")
#: Known page types in the order in which they are shown: fixed values.
TYPE_ORDER = ("overview", "entity", "concept", "source", "synthesis", "comparison", "query", "thesis", "finding", "event", "other")
MOST_SOURCE_CHARS = 50_000


def entity_summaries(pages: DataFrame) -> DataFrame:
    """``slug, type, title, description, tags``: what a judge of duplicates sees of a page."""
    slug = F.regexp_replace("file_name", r"\.md$", "")
    c = F.col("content")
    or_else = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), other)
    first = F.trim(F.regexp_extract(F.regexp_replace(without_front_matter(c), r"(?m)^#.*$", ""), r"(?s)\A\s*(.+?)(?:\n\s*\n|\z)", 1))
    kind = or_else(F.lower(front_matter_value(c, "type")), F.lit("unknown"))
    return pages.select(slug.alias("slug"), kind.alias("type"), or_else(front_matter_value(c, "title"), slug).alias("title"), truncated(or_else(front_matter_value(c, "description"), first), 200).alias("description"), list_field(c, "tags").alias("tags"))


def embeddable(pages: DataFrame) -> DataFrame:
    return pages.where(~F.lower(file_stem(F.col("file_name"))).isin(*NOT_EMBEDDED))


def pages_by_type(pages: DataFrame) -> DataFrame:
    """``type, place, n, title, path``: one row a page, sorted by the place of the type in which types are shown, then by
    title; ``n``: the pages of the type."""
    at = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    place = F.when(at > 0, at).otherwise(len(TYPE_ORDER) + 1).cast("int")
    sizes = pages.groupBy("type").agg(F.count("*").alias("n"))
    return pages.select("type", place.alias("place"), "title", "path").join(sizes, "type").select("type", "place", "n", "title", "path").orderBy("place", "type", "title", "path")


def paths_of_slugs(slugs: DataFrame, files: DataFrame) -> DataFrame:
    """``slug, path``: the first file (path order) whose stem is the slug."""
    first = files.select("path", file_stem(F.col("path")).alias("slug")).groupBy("slug").agg(F.min("path").alias("path"))
    return slugs.join(first, "slug", "left")


def route(files: DataFrame, target_language: Column | None = None) -> DataFrame:
    """How each generated file (``path, content``) is written: ``append``, ``overwrite`` or ``merge``; pages in another
    language than the target are left out, except logs, sources and entities."""
    from tessera.functions.language import language_matches

    name = file_name(F.col("path"))
    out = files.withColumn("action", F.when(name == "log.md", "append").when(name.isin("index.md", "overview.md"), "overwrite").otherwise("merge"))
    if target_language is None:
        return out
    free = (name == "log.md") | F.col("path").rlike("^wiki/(sources|entities)/")
    return out.where(free | language_matches(F.col("content"), target_language))


def merged_pages(routed: DataFrame, existing: DataFrame, today: str, merger: Callable[[str, str], str] | None = None) -> DataFrame:
    """``path, content, backup`` to write: routed files met with what exists; ``backup`` is the text that is replaced.

    Several files of one path (``path, name, content, action``) are folded in the order of their sources' names: log
    entries are all appended, pages merged one after the other, and of overwritten files the last stands. What is
    gathered is what one page is made of."""
    old = existing.select("path", F.col("content").alias("old"))

    @M.arrow("string")
    def run(action: pd.Series, new: pd.Series, was: pd.Series) -> pd.Series:
        def one(a, n, o):
            o = o if isinstance(o, str) else None
            if a == "append":
                return "\n\n".join([*([o.rstrip("\n")] if o else []), *(x.strip() for x in n)]) + "\n"
            if a == "overwrite":
                return n[-1]
            return M.merged_in_turn(n, o, merger, today)

        return pd.Series([one(*x) for x in zip(action, new, was)])

    files = F.array_sort(F.collect_list(F.struct("name", "i", "content")))
    one = routed.groupBy("path", "action").agg(files.alias("files"))
    met = one.join(old, "path", "left").withColumn("text", run("action", F.transform("files", lambda x: x["content"]), "old"))
    return met.where(F.col("old").isNull() | (F.col("text") != F.col("old"))).select("path", F.col("text").alias("content"), F.col("old").alias("backup"))


def generated(sources: DataFrame, model: Callable[[str], str], column: str = "content") -> DataFrame:
    """Sources with ``output``, what the injected model makes of the first 50 000 characters, and ``error``, what it raised
    if it failed (then the output is null)."""
    fields = [f.name for f in sources.schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(text):
            try:
                return model(text), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for f in frames:
            got = [call((t or "")[:MOST_SOURCE_CHARS]) for t in f[column]]
            yield f.assign(output=[o for o, _ in got], error=[e for _, e in got])[[*fields, "output", "error"]]

    from pyspark.sql.types import StringType, StructField, StructType

    return sources.mapInPandas(run, StructType([*sources.schema.fields, StructField("output", StringType()), StructField("error", StringType())]))


def ingest(sources: DataFrame, cache: DataFrame, pages: DataFrame, model: Callable[[str], str], today: str, merger: Callable[[str, str], str] | None = None) -> dict[str, DataFrame]:
    """One batch of ingest: sources (``name, content``) that the cache does not know go to the model, its answer is
    parsed into files and reviews, files meet the existing pages. A source whose answer has no file gets a plain summary
    page; one whose call failed gets nothing, is not cached, and so is tried again with the next batch. Results: ``writes``
    (path, content, backup), ``reviews``, ``cache`` (entries to add), ``warnings``, ``failures`` (name, error). The model's
    answers are written to the shared folder first, so that it is asked once."""
    # of a source's text only what a summary page takes is kept
    answers = checkpointed(generated(H.cache_misses(sources, cache, pages.select("path")), model).withColumn("content", F.substring("content", 1, 3000)))
    todo = answers.where("error IS NULL")
    parsed = todo.select("name", "content", "hash", M.parse_file_blocks(F.coalesce("output", F.lit(""))).alias("f"), M.parse_review_blocks(F.coalesce("output", F.lit(""))).alias("r"))
    slug = F.coalesce(F.nullif(title_slug(file_stem(F.col("name"))), F.lit("")), F.lit("source"))
    fallback = F.array(F.struct(F.concat(F.lit("wiki/sources/"), slug, F.lit(".md")).alias("path"), F.concat(F.lit('---\ntype: source\ntitle: "'), "name", F.lit('"\nsources: ["'), "name", F.lit('"]\n---\n\n# '), "name", F.lit("\n\n"), F.substring("content", 1, 3000)).alias("content")))
    files = parsed.select("name", "hash", F.posexplode(F.when(F.size("f.files") > 0, F.col("f.files")).otherwise(fallback)).alias("i", "x")).select("name", "hash", "i", "x.path", "x.content")
    return {
        "writes": merged_pages(route(files), pages, today, merger),
        "failures": answers.where("error IS NOT NULL").select("name", "error"),
        "reviews": parsed.select("name", F.explode("r").alias("x")).select("name", "x.*"),
        "cache": files.groupBy("name", "hash").agg(F.sort_array(F.collect_set("path")).alias("files_written")),
        "warnings": parsed.select("name", F.explode("f.warnings").alias("warning")),
    }


def cascade_delete(pages: DataFrame, doomed: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages without the doomed ones (``path``): links to them become text, index lines and ``related`` entries go, their
    vectors and media folders too. Results: ``pages`` (path, content), ``vectors``, ``media`` (folders)."""
    info = pages.join(doomed.select("path").distinct(), "path", "left_semi").select("path", file_stem(F.col("path")).alias("slug"), front_matter_value(F.col("content"), "title").alias("title"), page_type(F.col("content")).alias("type"))
    keys = H.deleted_keys(info)
    left = pages.join(doomed.select("path").distinct(), "path", "left_anti").select("path", "content")
    lists = F.lower(file_name(F.col("path"))) == "index.md"
    texts = H.clean_index(left.where(lists), keys).unionByName(left.where(~lists))
    clean = H.strip_dead_links(texts, keys)
    named = clean.select("path", "content", list_field(F.col("content"), "related").alias("related"))
    dead = named.select("path", F.explode("related").alias("x")).withColumn("key", link_key(F.col("x"))).join(keys, "key", "left_semi").groupBy("path").agg(F.collect_set("x").alias("gone"))

    @M.arrow("string")
    def without(content: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([c if k is None else M.write_list(c, "related", list(k)) for c, k in zip(content, keep)])

    met = named.join(dead, "path", "left").withColumn("keep", F.when(F.col("gone").isNotNull(), F.array_except("related", "gone")))
    out = {"pages": met.select("path", F.when(F.col("keep").isNull(), F.col("content")).otherwise(without("content", "keep")).alias("content")), "media": info.where("type = 'source'").select(F.concat(F.lit("wiki/media/"), "slug").alias("folder"))}
    if vectors is not None:
        out["vectors"] = vectors.join(info.select(F.col("slug").alias("page_id")), "page_id", "left_anti")
    return out


def delete_source_cascade(pages: DataFrame, sources: DataFrame, cache: DataFrame, day: str) -> dict[str, DataFrame]:
    """All that deleting a batch of sources changes. Results: ``pages`` (path, content) that stay, with the sources taken off
    their lists, links to deleted pages as text and the log page with an entry for each source; ``deleted`` (path);
    ``cache`` without the sources' entries (``name``)."""
    fate = delete_sources(pages, sources)
    gone = fate.where("action = 'delete'").select("path")

    @M.arrow("string")
    def listed(content: pd.Series, left: pd.Series) -> pd.Series:
        return pd.Series([c if k is None else M.write_list(c, "sources", list(k)) for c, k in zip(content, left)])

    after = cascade_delete(pages.withColumn("file_name", file_name(F.col("path"))), gone)["pages"]
    kept = after.join(fate.where("action = 'keep'").select("path", F.col("sources").alias("left")), "path", "left").select("path", F.when(F.col("left").isNull(), F.col("content")).otherwise(listed("content", "left")).alias("content"))
    lines = sources.select("source").distinct().agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit(f"- {day}: deleted source "), "source"))), "\n").alias("entry"))
    log = F.lower(file_name(F.col("path"))) == "log.md"
    entry = F.concat(F.rtrim(F.regexp_replace("content", r"\n+\z", "")), F.lit("\n\n"), "entry", F.lit("\n"))
    logged = kept.where(log).crossJoin(lines).select("path", entry.alias("content"))  # log pages, and one row on the other side
    texts = kept.where(~log).unionByName(logged)
    return {"pages": texts, "deleted": gone, "cache": cache.join(sources.select(F.col("source").alias("name")).distinct(), "name", "left_anti")}


def merge_duplicates(pages: DataFrame, merges: DataFrame, today: str) -> dict[str, DataFrame]:
    """Groups of duplicates made into one page each. ``merges``: ``group_id, canonical, slugs, merged`` (the text that a judge
    made of the group). Results: ``writes`` (path, content, backup): the canonical pages, with the list fields of all
    members united and the day, and every other page whose links or ``related`` entries named a page that goes, led to the
    canonical one, index lines of such pages taken out; ``deletes`` (path, backup). What a page names is joined with the
    slugs that go, so neither pages nor merges have to be few; a group is what one call of a judge took."""
    own = pages.select("path", "content", file_stem(F.col("path")).alias("slug"))
    member = merges.select("group_id", "canonical", F.explode(F.array_distinct("slugs")).alias("slug"))
    held = own.join(member, "slug")
    to = member.where("slug <> canonical").groupBy("slug").agg(F.min("canonical").alias("to"))

    @M.arrow("string")
    def united(merged: pd.Series, texts: pd.Series) -> pd.Series:
        def one(out, have):
            for t in have:
                out = M.union_lists(out, t)
            return M.set_scalar(out, "updated", today)

        return pd.Series([one(*x) for x in zip(merged, texts)], dtype=object)

    @M.arrow("string")
    def led(content: pd.Series, names: pd.Series, goals: pd.Series) -> pd.Series:
        return pd.Series([c if n is None else M.redirected(c, dict(zip(n, g))) for c, n, g in zip(content, names, goals)], dtype=object)

    texts = held.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slug", "content"))), lambda x: x["content"]).alias("texts"))
    made = merges.select("group_id", "canonical", "merged").join(texts, "group_id").withColumn("new", united("merged", "texts"))
    canonical = held.where("slug = canonical").select("group_id", "path", F.col("content").alias("backup")).join(made.select("group_id", "new"), "group_id").select("path", F.col("new").alias("content"), "backup")
    others = own.join(member.select("slug").distinct(), "slug", "left_anti")
    index = F.lower(file_name(F.col("path"))) == "index.md"
    keys = to.select(link_key(F.col("slug")).alias("key")).where("key <> ''").distinct()
    lines = H.clean_index(others.where(index), keys).withColumnRenamed("content", "clean")
    others = others.join(lines, "path", "left").withColumn("now", F.coalesce("clean", "content"))
    named = others.select("path", F.explode(F.array_distinct(F.concat(wikilinks(F.col("now")), list_field(F.col("now"), "related")))).alias("slug"))
    led_to = named.join(to, "slug").groupBy("path").agg(F.collect_list(F.struct("slug", "to")).alias("m"))
    both = others.join(led_to, "path", "left")
    part = lambda name: F.transform("m", lambda x: x[name])
    rewritten = both.withColumn("new", F.when(F.col("m").isNull(), F.col("now")).otherwise(led("now", part("slug"), part("to")))).where("new <> content").select("path", F.col("new").alias("content"), F.col("content").alias("backup"))
    return {"writes": canonical.unionByName(rewritten), "deletes": held.where("slug <> canonical").select("path", F.col("content").alias("backup"))}


def cleanup_cancelled(pages: DataFrame, tasks: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The files that cancelled tasks (``task_id, status, files_written``) had written, deleted with all that points to them."""
    written = tasks.where("status = 'cancelled'").select(F.explode("files_written").alias("path")).distinct()
    return cascade_delete(pages, written, vectors)


def delete_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``path, action, sources`` of pages related to deleted sources: deleted where no other source is left, kept with
    the others, or skipped where the match was loose."""
    near = H.related_pages(pages, sources).join(pages.select("path", list_field(F.col("content"), "sources").alias("have")), "path")
    g = near.groupBy("path").agg(F.first("have").alias("have"), F.collect_set("source").alias("gone"))
    left = H.minus_ci(F.col("have"), F.col("gone"))
    action = F.when(F.size(left) == F.size("have"), "skip").when(F.size(left) > 0, "keep").otherwise("delete")
    return g.select("path", action.alias("action"), left.alias("sources"))


# images

IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"


def image_references(pages: DataFrame, around: int = 150) -> DataFrame:
    """``path, pos, alt, url, before, after``: each image with the text around it."""
    refs = F.regexp_extract_all("content", F.lit(IMAGE), F.lit(0))
    found = pages.select("path", "content", refs.alias("refs"), F.split("content", IMAGE).alias("texts"))
    each = found.select("path", "content", "refs", "texts", F.posexplode("refs").alias("pos", "ref"))
    # an image starts after the texts up to it and the images before it, so repeated ones have places of their own
    at = F.expr("int(aggregate(slice(texts, 1, pos + 1), 1L, (n, x) -> n + length(x)) + aggregate(slice(refs, 1, pos), 0L, (n, x) -> n + length(x)))")
    return each.withColumn("at", at).select(
        "path", "pos", F.regexp_extract("ref", IMAGE, 1).alias("alt"), F.regexp_extract("ref", IMAGE, 2).alias("url"),
        F.substring("content", F.greatest(F.lit(1), F.col("at") - around), F.least(F.lit(around), F.col("at") - 1)).alias("before"), F.substring("content", F.col("at") + F.length("ref"), F.lit(around)).alias("after"),
    )


def caption_plan(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Images (``url, sha256``, one row per URL) with their cached ``caption``; those without one are to be asked for."""
    one = H.first_by(images.select("url", "sha256"), ["url"], ["sha256"])
    return one.join(cache.select("sha256", "caption"), "sha256", "left").withColumn("cached", F.col("caption").isNotNull())


def captioned(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """The plan with what the service said of images that the cache does not know (``sha256, caption``; null where it
    failed), and ``state``: ``cached``, ``fresh`` or ``failed``."""
    new = answers.groupBy("sha256").agg(F.min("caption").alias("new"))
    out = plan.join(new, "sha256", "left").withColumn("caption", F.coalesce("caption", "new")).drop("new")
    return out.withColumn("state", F.when(F.col("cached"), "cached").when(F.col("caption").isNotNull(), "fresh").otherwise("failed"))


def caption_counts(done: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return done.agg(n("fresh"), n("cached"), n("failed"))


def with_captions(pages: DataFrame, done: DataFrame) -> DataFrame:
    """``path, content`` with the captions of images as their alternative texts; images without one keep theirs."""
    refs = pages.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(IMAGE), F.lit(0))).alias("pos", "ref"))
    said = done.where("caption IS NOT NULL").select("url", caption_text(F.col("caption")).alias("said"))
    named = refs.withColumn("url", F.regexp_extract("ref", IMAGE, 2)).join(said, "url", "left")
    new = F.when(F.col("said").isNull(), F.col("ref")).otherwise(F.concat(F.lit("!["), "said", F.lit("]("), "url", F.lit(")")))
    each = named.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))), lambda x: x["new"]).alias("new"))
    texts = F.split("content", IMAGE)
    put = F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.get("new", i), F.lit("")))), "")
    return pages.join(each, "path", "left").select("path", F.when(F.col("new").isNull(), F.col("content")).otherwise(put).alias("content"))


def images_by_page(images: DataFrame) -> DataFrame:
    """``path, section, images``: images grouped by page number, those without one last under ``Document``."""
    section = F.coalesce(F.concat(F.lit("Page "), F.col("page").cast("string")), F.lit("Document"))
    return images.groupBy("path", section.alias("section"), F.coalesce("page", F.lit(1 << 30)).alias("_o")).agg(F.array_sort(F.collect_list(F.struct("index", "name"))).alias("images")).orderBy("path", "_o").drop("_o")


def with_image_section(content: Column, section: Column) -> Column:
    """The page with its marked image section replaced, or added at the end."""
    block = F.concat(F.lit("<!-- images:start -->\n"), section, F.lit("\n<!-- images:end -->"))
    had = content.rlike(r"(?s)<!-- images:start -->.*?<!-- images:end -->")
    escaped = F.regexp_replace(block, r"([\\$])", r"\\$1")
    return F.when(had, F.regexp_replace(content, F.lit(r"(?s)<!-- images:start -->.*?<!-- images:end -->"), escaped)).otherwise(F.concat(F.rtrim(content), F.lit("\n\n"), block, F.lit("\n")))


# pages of other kinds


def backups(writes: DataFrame, now: Column) -> DataFrame:
    """``path, content`` of the texts that ``writes`` (``path, backup``) replace, under names of the history folder."""
    return writes.where("backup IS NOT NULL").select(backup_path(F.col("path"), now).alias("path"), F.col("backup").alias("content"))


def backup_path(path: Column, now: Column) -> Column:
    return F.concat(F.lit("history/"), F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "_"), F.lit("."), F.date_format(now, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".md"))


def research_pages(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """``path, content`` of finished research (``task_id, topic, synthesis, day``) with its web results as references, each
    URL once, in order of rank."""
    from tessera.functions.text import strip_thinking

    one = H.first_by(results.select("task_id", "url", "rank", "title"), ["task_id", "url"], ["rank"])
    refs = one.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url"))).alias("r"))
    listed = F.array_join(F.transform("r", lambda x, i: F.format_string("%d. [%s](%s) - %s", i + 1, x["title"], x["url"], host_name(x["url"]))), "\n")
    head = F.concat(F.lit('---\ntype: query\ntitle: "Research: '), F.translate("topic", '"', "'"), F.lit('"\ntags: [research]\n---\n\n# '), "topic", F.lit("\n\n"))
    out = tasks.join(refs, "task_id", "left")
    body = F.concat(head, strip_thinking(F.col("synthesis")), F.lit("\n\n## References\n\n"), F.coalesce(listed, F.lit("")), F.lit("\n"))
    return out.select(F.concat(F.lit("wiki/queries/research-"), title_slug(F.col("topic")), F.lit("-"), F.date_format("day", "yyyy-MM-dd"), F.lit(".md")).alias("path"), body.alias("content"))


#: Shape of the streamed payloads that may hold reasoning: fixed values.
STREAMED = (
    "struct<choices: array<struct<delta: struct<reasoning_content: string, reasoning: string>>>, delta: struct<type: string, text: string, thinking: string>, "
    "candidates: array<struct<content: struct<parts: array<struct<text: string, thought: boolean>>>>>>"
)


def reasoning_texts(line: Column) -> Column:
    """The reasoning texts of one line of a stream in order, whichever of the usual places holds them; none of lines that
    are no data or no JSON."""
    data = F.trim(F.substring(F.trim(line), 7, 1 << 30))
    j = F.from_json(F.when(F.startswith(F.trim(line), F.lit("data: ")) & ~data.isin("", "[DONE]"), data), STREAMED)
    none = F.array().cast("array<string>")
    chosen = F.flatten(F.transform(j["choices"], lambda c: F.array(c["delta"]["reasoning_content"], c["delta"]["reasoning"])))
    delta = F.when(j["delta"]["type"] == "thinking_delta", F.array(j["delta"]["thinking"], j["delta"]["text"]))
    parts = F.transform(F.filter(F.flatten(F.transform(j["candidates"], lambda c: c["content"]["parts"])), lambda p: p["thought"]), lambda p: p["text"])
    return F.array_compact(F.concat(F.coalesce(chosen, none), F.coalesce(delta, none), F.coalesce(parts, none)))


def reasoning_chars(line: Column) -> Column:
    """How many characters of reasoning a raw line holds, as they are escaped there."""
    found = F.regexp_extract_all(line, F.lit(r'"reasoning(?:_content)?"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))


# prompts


def language_directive(language: Column) -> Column:
    """What a prompt says about the language of the answer."""
    name = language_metadata(language)["prompt_name"]
    return F.concat(F.lit("## Output language: "), name, F.lit("\n\nWrite the whole answer, titles included, in "), name, F.lit(", whatever the language of the sources. Proper nouns take their usual form in "), name, F.lit("."))


def caption_prompt(before: Column, after: Column) -> Column:
    """What a captioning service is told of the text around an image; sides without text are left out."""
    side = lambda name, x: F.when(F.length(F.trim(x)) > 0, F.concat(F.lit(f"Text {name} the image:\n"), F.trim(x)))
    return F.concat_ws("\n\n", F.lit("Describe the image in one sentence."), side("before", before), side("after", after))


#: Pages that one call of a judge of duplicates takes.
JUDGED_PAGES = 200


def judged_batches(summaries: DataFrame, most: int = JUDGED_PAGES) -> DataFrame:
    """Summaries with ``batch``: at most ``most`` in the order of slugs, so neighbours in name are judged together."""
    return numbered(summaries, [F.col("slug")], "_n").withColumn("batch", F.floor(F.col("_n") / most)).drop("_n")


def duplicate_prompt(summaries: DataFrame) -> DataFrame:
    """``batch, prompt``: entity summaries (``batch, slug, type, title, description``) as the lines a judge of duplicates gets,
    in the order of slugs. A batch is what one call takes."""
    line = F.concat(F.lit("- "), "slug", F.lit(" ("), "type", F.lit("): "), "title", F.when(F.length("description") > 0, F.concat(F.lit(" - "), "description")).otherwise(""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slug", line.alias("line")))), lambda x: x["line"]), "\n")
    return summaries.groupBy("batch").agg(F.concat(F.lit("Which of these pages are about the same thing?\n\n"), lines).alias("prompt"))
