"""Conversations: history, titles, citations and context packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import arrow
from tessera.functions.text import WIKILINK

HISTORY, TITLE = 10, 50
CUT_NOTE = "\n\n[...truncated...]"


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` user and assistant messages of each conversation, ``pos`` counted from the newest."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def without_last_answer(messages: DataFrame) -> DataFrame:
    """Messages without each conversation's newest answer."""
    last = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return messages.join(last, ["conv_id", "turn"], "left_anti")


def summaries(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages, last_turn, title``: the title is the first user message, cut."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.substring(first, 1, TITLE).alias("title"))


def citations(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, ref``: numbers of the comment that lists them, else of bracketed numbers; repeats once."""
    listed = F.split(F.regexp_extract("text", r"<!--\s*cited:\s*([0-9,\s]+?)\s*-->", 1), r"\s*,\s*")
    listed = F.filter(listed, lambda x: x != "")
    bracketed = F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,9})\]"), F.lit(1))
    refs = F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(bracketed))
    return answers.select("conv_id", "turn", F.explode(F.transform(refs, lambda x: x.cast("int"))).alias("ref"))


def cited_pages(answers: DataFrame, references: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, tier, title, path``: the pages that answers cite. ``references`` (``conv_id, turn, pos, title,
    path``) are the numbered pages that an answer was given. The first tier that yields a page counts: the comment that
    lists numbers (repeats stay), numbers in brackets (once each), links of the text (once each; a target without a
    folder is taken for an entity's page)."""
    comment = F.split(F.regexp_extract("text", r"<!--\s*cited:\s*(.+?)\s*-->", 1), ",")
    listed = F.transform(comment, lambda x: F.regexp_extract(F.trim(x), r"^([0-9]{1,9})", 1))
    bracketed = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int").cast("string")))
    links = F.transform(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(0)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"\[\[([^\]|]+?)(?:\||\]\])", 1)).alias("id"), F.nullif(F.trim(F.regexp_extract(x, r"\|([^\]]+?)\]\]", 1)), F.lit("")).alias("label")))
    refs = references.select("conv_id", "turn", F.col("pos").alias("ref"), "title", "path")
    base = answers.select("conv_id", "turn", listed.alias("listed"), bracketed.alias("bracketed"), links.alias("links"))
    parts = []
    for tier, numbers in ((1, "listed"), (2, "bracketed")):
        each = base.select("conv_id", "turn", F.posexplode(numbers).alias("pos", "x")).where("x <> ''").select("conv_id", "turn", "pos", F.col("x").cast("int").alias("ref"))
        parts.append(each.join(refs, ["conv_id", "turn", "ref"]).select("conv_id", "turn", "pos", F.lit(tier).alias("tier"), "title", "path"))
    each = base.select("conv_id", "turn", F.posexplode("links").alias("pos", "x")).groupBy("conv_id", "turn", "x.id").agg(F.min(F.struct("pos", F.col("x.label").alias("label"))).alias("f"))
    folder = F.when(F.contains("id", F.lit("/")), "").otherwise("entities/")
    parts.append(each.select("conv_id", "turn", "f.pos", F.lit(3).alias("tier"), F.coalesce("f.label", "id").alias("title"), F.concat(F.lit("wiki/"), folder, "id", F.lit(".md")).alias("path")))
    every = parts[0].union(parts[1]).union(parts[2])
    first = every.groupBy("conv_id", "turn").agg(F.min("tier").alias("tier"))
    return every.join(first, ["conv_id", "turn", "tier"]).select("conv_id", "turn", "pos", "tier", "title", "path")


def context_candidates(hits: DataFrame, expansions: DataFrame, pages: DataFrame, overview: DataFrame | None = None) -> DataFrame:
    """What may be packed for each query, in order: title hits (priority 0), other hits (1), related pages that are no
    hits, by falling relevance (2), and the overview page (3), which only counts where nothing else can be packed.
    ``hits``: ``query_id, pos, path, title_match``; ``expansions``: ``query_id, path, relevance``; ``pages`` and
    ``overview``: ``path, content``."""
    a = hits.select("query_id", F.when(F.col("title_match"), 0).otherwise(1).alias("priority"), F.col("pos").cast("int").alias("pos"), "path")
    near = expansions.join(hits.select("query_id", "path"), ["query_id", "path"], "left_anti").groupBy("query_id", "path").agg(F.max("relevance").alias("relevance"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "path")
    out = a.union(near.select("query_id", F.lit(2).alias("priority"), F.row_number().over(order).alias("pos"), "path")).join(pages.select("path", "content"), "path")
    if overview is not None:
        queries = hits.select("query_id").union(expansions.select("query_id")).distinct()
        out = out.unionByName(queries.join(F.broadcast(overview.limit(1))).select("path", "query_id", F.lit(3).alias("priority"), F.lit(1).alias("pos"), "content"))
    return out.select("query_id", "priority", "pos", "path", "content")


def pack_greedily(candidates: DataFrame, budget: int, most: int) -> DataFrame:
    """Pages taken in order of (priority, pos) while they fit (those of priority 3 only where nothing was taken); too long ones are cut first, one that would overflow is
    passed over while later, shorter ones may still fit. One query's candidates are few by construction (top hits and
    their neighbours); each query is packed on its own: ``query_id, priority, pos, path, content, number``."""
    kind = candidates.schema["query_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in pdf.sort_values(["priority", "pos"], kind="stable").itertuples():
            text = r.content if len(r.content) <= most else r.content[:most] + CUT_NOTE
            if used >= budget or r.priority == 3 and out:
                break
            if used + len(text) <= budget:
                used += len(text)
                out.append((r.query_id, r.priority, r.pos, r.path, text, len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "priority", "pos", "path", "content", "number"])

    return candidates.groupBy("query_id").applyInPandas(pack, f"query_id {kind}, priority int, pos int, path string, content string, number int")


INDEX_NOTE = "\n\n[...index trimmed to relevant entries...]"


def trim_index(lines: list[str], tokens: list[str], budget: int) -> list[str]:
    """Headings and lines with a token, as far as they fit; a line that does not is passed over."""
    used, out = 0, []
    for x in lines:
        if (x.startswith("##") or any(t in x.lower() for t in tokens)) and used + len(x) + 1 <= budget:
            out.append(x)
            used += len(x) + 1
    return out


def trimmed_index(index: Column, tokens: Column, budget: Column) -> Column:
    """An index page cut to what matters for a query, as a column: within the budget it stays as it is."""

    @arrow("string")
    def run(text: pd.Series, words: pd.Series, most: pd.Series) -> pd.Series:
        def one(t, w, m):
            if t is None or len(t) <= m:
                return t
            kept = "\n".join(trim_index(t.split("\n"), list(w), m))
            return kept + INDEX_NOTE if len(kept) < len(t) else kept

        return pd.Series([one(*x) for x in zip(text, words, most)], dtype=object)

    return run(index, tokens, budget)


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """``id, file_name, path_name`` of new files (``id, file_name, day``): a name that is free stays; else the day is put
    before its extension, then a number from 2 on. ``taken``: ``file_name``. New files of one name take their turns by id."""
    ext = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    stem = F.substring("file_name", F.lit(1), F.length("file_name") - F.length(ext))
    dated = F.concat(stem, F.lit("-"), F.date_format("day", "yyyyMMdd"))
    here = taken.select("file_name").distinct()
    nth = F.row_number().over(Window.partitionBy("file_name", "day").orderBy("id"))
    turn = names.withColumn("turn", nth).join(here.withColumn("had", F.lit(1)), "file_name", "left").withColumn("turn", F.col("turn") + F.coalesce("had", F.lit(0)) - 1)
    # numbered names that are there already push the turns on
    used = here.select(F.regexp_extract("file_name", r"^(.*-[0-9]{8})(?:-[0-9]+)?(\.[^.]*)?$", 1).alias("dated"), F.regexp_extract("file_name", r"(\.[^.]*)$", 1).alias("ext")).where("dated <> ''").groupBy("dated", "ext").agg(F.count("*").alias("n"))
    at = turn.withColumn("dated", dated).withColumn("ext", ext).join(used, ["dated", "ext"], "left").withColumn("k", F.col("turn") + F.coalesce("n", F.lit(0)))
    name = F.when(F.col("turn") == 0, F.col("file_name")).otherwise(F.concat("dated", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""), "ext"))
    return at.select("id", "file_name", name.alias("path_name"))


def streamed_text(chunks: DataFrame) -> DataFrame:
    """Pieces put together in order of arrival."""
    return chunks.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
