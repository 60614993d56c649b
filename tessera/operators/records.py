"""State as tables: conversations, reviews, activities, projects, research slots and versioned results.

Every change gives a new table; who keeps it (a keyed table, a stream's state) is not this module's concern. Times are
given by the caller, so that a change gives the same rows whenever it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_path

RESEARCH_SLOTS, RECENT = 3, 10
NEW_TITLE = "New Conversation"

# conversations (conv_id, title, created, updated) and messages (conv_id, turn, role, text)


def create_conversations(conversations: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """With new, untitled conversations; ids (``conv_id``) that exist are left alone."""
    new = ids.select("conv_id").distinct().join(conversations.select("conv_id"), "conv_id", "left_anti")
    return conversations.unionByName(new.select("conv_id", F.lit(NEW_TITLE).alias("title"), now.alias("created"), now.alias("updated")))


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages without those of ``ids``."""
    gone = ids.select("conv_id").distinct()
    return conversations.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def rename_conversations(conversations: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Titles replaced by those of ``names`` (``conv_id, title``)."""
    new = names.groupBy("conv_id").agg(F.max("title").alias("_title"))
    out = conversations.join(new, "conv_id", "left")
    hit = F.col("_title").isNotNull()
    return out.select("conv_id", F.coalesce("_title", "title").alias("title"), "created", F.when(hit, now).otherwise(F.col("updated")).alias("updated"))


def clear_messages(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (``conv_id, pos, role, text``) after the last turn of their conversations, in the order of ``pos``."""
    from pyspark.sql import Window

    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    placed = new.withColumn("_n", nth).join(last, "conv_id", "left")
    return messages.select("conv_id", "turn", "role", "text").unionByName(placed.select("conv_id", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).alias("turn"), "role", "text"))


# reviews (id, resolved, resolved_action, ...)


def resolve_reviews(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items of ``decisions`` (``id, action``) marked as resolved by their action."""
    by = decisions.groupBy("id").agg(F.max("action").alias("_action"))
    out = items.join(by, "id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)) | F.col("_action").isNotNull()).withColumn("resolved_action", F.coalesce("_action", "resolved_action"))
    return out.select(*items.columns)


def dismiss_reviews(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_anti").select(*items.columns)


def clear_resolved(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce("resolved", F.lit(False)))


def review_split(items: DataFrame) -> DataFrame:
    """One row: items that wait and items that are resolved."""
    done = F.coalesce("resolved", F.lit(False))
    return items.agg(F.count(F.when(~done, 1)).alias("pending"), F.count(F.when(done, 1)).alias("resolved"))


def judged_ids(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """``batch, id``: what a judge says is resolved (``batch, id``), kept only where the batch held that item."""
    return answers.select("batch", "id").distinct().join(batches.select("batch", "id"), ["batch", "id"], "left_semi")


# activities (id, status, detail, created, ...)


def log_activities(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log after ``events`` (``seq, id, kind, status, text, at``), in the order of ``seq``: ``add`` opens an activity,
    ``status`` sets its status, ``detail`` adds to its text. What is said of unknown activities is passed over."""
    had = log.select("id", F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("kind"), "status", F.col("detail").alias("text"), F.col("created").alias("at"))
    every = had.unionByName(events.select("id", F.col("seq").cast("long").alias("seq"), "kind", "status", "text", "at"))
    opened = every.where("kind = 'add'").groupBy("id").agg(F.min("seq").alias("_from"), F.min_by("at", "seq").alias("created"))
    live = every.join(opened, "id").where("seq >= _from")
    status = F.max_by("status", F.when(F.col("kind").isin("add", "status"), F.col("seq")))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind").isin("add", "detail") & F.col("text").isNotNull(), F.struct("seq", "text"))))
    return live.groupBy("id").agg(status.alias("status"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("detail"), F.first("created").alias("created"))


def clear_done(log: DataFrame) -> DataFrame:
    """Running activities only."""
    return log.where("status = 'running'")


# projects (id, path, name, opened)


def upsert_projects(registry: DataFrame, opened: DataFrame) -> DataFrame:
    """The registry with the latest opening of each project id; paths are normalised."""
    every = registry.select("id", "path", "name", "opened").unionByName(opened.select("id", normalize_path(F.col("path")).alias("path"), "name", "opened"))
    return every.groupBy("id").agg(F.max(F.struct("opened", "path", "name")).alias("x")).select("id", "x.path", "x.name", "x.opened")


def recent_projects(openings: DataFrame, most: int = RECENT) -> DataFrame:
    """The newest opening of each path, newest first."""
    newest = openings.groupBy("path").agg(F.max(F.struct("opened", "name")).alias("x")).select("path", "x.opened", "x.name")
    return newest.orderBy(F.desc("opened"), "path").limit(most)


def forget_project(openings: DataFrame, paths: DataFrame) -> DataFrame:
    return openings.join(paths.select("path").distinct(), "path", "left_anti")


def tasks_of_project(tasks: DataFrame, project: str) -> DataFrame:
    """What a queue takes up again for one project: its own tasks, of which those cut off in the middle wait anew."""
    mine = tasks.where(F.col("project_id") == project)
    return mine.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


# research slots (task_id, seq, status)


def next_research(tasks: DataFrame, slots: int = RESEARCH_SLOTS) -> DataFrame:
    """``task_id, slot``: the queued tasks, in order of arrival, that free slots take up. Running tasks hold theirs."""
    from pyspark.sql import Window

    running = tasks.where(F.col("status").isin("searching", "synthesizing", "saving")).agg(F.count("*").alias("running"))
    queue = tasks.where("status = 'queued'").orderBy("seq", "task_id").limit(slots)  # never more than there are slots
    nth = F.row_number().over(Window.orderBy("seq", "task_id"))
    return queue.withColumn("n", nth).join(F.broadcast(running)).withColumn("slot", (F.col("n") + F.col("running")).cast("int")).where(F.col("slot") <= slots).select("task_id", "slot")


# versions


class Versioned:
    """A result kept for one version of its data: asked for another version, it is worked out anew, and the old one is let
    go. ``reset`` lets it go at once, as when another project is opened."""

    def __init__(self, compute: Callable[[], DataFrame]):
        self.compute, self.version, self.kept = compute, None, None

    def get(self, version: int) -> DataFrame:
        if self.kept is None or version != self.version:
            self.reset()
            self.version, self.kept = version, self.compute().persist()
        return self.kept

    def reset(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.version, self.kept = None, None


def reset_project(spark, held: list[Versioned], streams: list | None = None) -> None:
    """Let go of what belongs to one project: kept results, cached tables, and the streams that feed its queues."""
    for q in streams or []:
        q.stop()
    for v in held:
        v.reset()
    spark.catalog.clearCache()
