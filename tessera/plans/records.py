"""State tables as queries: conversations, reviews, activities, projects, slots and queues, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators import hygiene as H
from tessera.operators import records as S
from tessera.plans.corpus import table
from tessera.plans.registry import query


@query(
    "chat_mutations",
    """WITH m AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0
  UNION ALL SELECT conv_id, coalesce(last, -1) + n, CASE WHEN n = 1 THEN 'user' ELSE 'assistant' END
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 <> 0) JOIN (SELECT unnest([1, 2]) AS n) ON TRUE
  LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1) USING (conv_id)),
c AS (SELECT DISTINCT conv_id FROM conversations UNION SELECT -1)
SELECT c.conv_id, CASE WHEN conv_id = -1 THEN 'New Conversation' WHEN conv_id % 3 = 0 THEN 'Renamed ' || conv_id ELSE 'Talk' END AS title,
  CASE WHEN conv_id = -1 OR conv_id % 3 = 0 THEN 9 ELSE 1 END AS updated, coalesce(n, 0) AS n_messages, t AS last_turn
FROM c LEFT JOIN (SELECT conv_id, count(*) AS n, max(turn) AS t FROM m GROUP BY 1) USING (conv_id) WHERE conv_id % 5 <> 0""",
)
def chat_mutations(spark, sf_dir):
    """A new conversation; every fifth deleted, every third renamed, every seventh emptied; two messages added to all."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = messages.select("conv_id").distinct()
    talks = ids.select("conv_id", F.lit("Talk").alias("title"), F.lit(1).alias("created"), F.lit(1).alias("updated"))
    talks = S.create_conversations(talks, spark.range(1).select(F.lit(-1).cast("long").alias("conv_id")), F.lit(9))
    talks = S.rename_conversations(talks, ids.where("conv_id % 3 = 0").withColumn("title", F.concat(F.lit("Renamed "), F.col("conv_id").cast("string"))), F.lit(9))
    talks, messages = S.delete_conversations(talks, messages, ids.where("conv_id % 5 = 0"))
    messages = S.clear_messages(messages, ids.where("conv_id % 7 = 0"))
    new = ids.where("conv_id % 5 <> 0").select("conv_id", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("user").alias("role")), F.struct(F.lit(2).alias("pos"), F.lit("assistant").alias("role")))).alias("x")).select("conv_id", "x.pos", "x.role", F.lit("t").alias("text"))
    last = S.append_messages(messages, new).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    return talks.join(last, "conv_id", "left").select("conv_id", "title", "updated", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "last_turn")


def _reviews(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("resolved"), F.when(F.col("event_type") == "purchase", "bought").alias("resolved_action"))


@query(
    "review_mutations",
    """SELECT event_id AS id, event_type = 'purchase' OR event_id % 7 = 0 AS resolved, CASE WHEN event_id % 7 = 0 THEN 'done' WHEN event_type = 'purchase' THEN 'bought' END AS resolved_action FROM events WHERE event_id % 11 <> 0""",
)
def review_mutations(spark, sf_dir):
    """Every seventh item resolved, every eleventh dismissed."""
    items = _reviews(spark, sf_dir)
    items = S.resolve_reviews(items, items.where("id % 7 = 0").select("id", F.lit("done").alias("action")))
    return S.dismiss_reviews(items, items.where("id % 11 = 0"))


@query("review_split", "SELECT count(*) FILTER (WHERE event_type <> 'purchase') AS pending, count(*) FILTER (WHERE event_type = 'purchase') AS resolved FROM events")
def review_split(spark, sf_dir):
    return S.review_split(_reviews(spark, sf_dir))


@query("reviews_left", "SELECT event_id AS id FROM events WHERE event_type <> 'purchase'")
def reviews_left(spark, sf_dir):
    return S.clear_resolved(_reviews(spark, sf_dir)).select("id")


@query(
    "judged_reviews",
    """SELECT batch, id FROM (SELECT event_id AS id, (row_number() OVER (ORDER BY event_id) - 1) // 40 AS batch FROM events ORDER BY event_id LIMIT 200) WHERE id % 3 = 0""",
)
def judged_reviews(spark, sf_dir):
    """The first five batches of forty items; a judge that names every third, and items of other batches, is believed only
    about its own."""
    batches = H.judge_batches(_reviews(spark, sf_dir).select("id"))
    mine = batches.where("id % 3 = 0").select("batch", "id")
    return S.judged_ids(mine.union(mine.select((F.col("batch") + 1).alias("batch"), "id")), batches)


@query(
    "activity_log",
    """WITH e AS (SELECT user_id AS id, event_id AS seq, event_type AS t, value FROM events),
o AS (SELECT id, min(seq) AS s FROM e WHERE t = 'view' GROUP BY 1),
l AS (SELECT e.* FROM e JOIN o USING (id) WHERE seq >= s)
SELECT id, arg_max(CASE WHEN t = 'view' THEN 'running' WHEN t = 'error' THEN 'error' ELSE 'done' END, seq) FILTER (WHERE t IN ('view', 'error', 'purchase')) AS status,
  md5(coalesce(string_agg(CASE WHEN t = 'view' THEN 'v' ELSE 'c' || seq END, '' ORDER BY seq) FILTER (WHERE t IN ('view', 'click')), '')) AS detail, min(s) AS created
FROM l JOIN o USING (id) GROUP BY id""",
)
def activity_log(spark, sf_dir):
    """Users as activities: views open them, clicks add detail, errors and purchases set their status."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    kind = F.when(t == "view", "add").when(t == "click", "detail").when(t.isin("error", "purchase"), "status")
    status = F.when(t == "view", "running").when(t == "error", "error").when(t == "purchase", "done")
    text = F.when(t == "view", "v").when(t == "click", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    events = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), kind.alias("kind"), status.alias("status"), text.alias("text"), F.col("event_id").alias("at")).where("kind IS NOT NULL")
    none = spark.createDataFrame([], "id long, status string, detail string, created long")
    return S.log_activities(none, events).select("id", "status", F.md5("detail").alias("detail"), "created")


@query("activities_running", "SELECT user_id AS id FROM events WHERE event_type = 'view'")
def activities_running(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"))
    return S.clear_done(log).select("id")


PROJECT = "'p' || (user_id % 40)"


@query(
    "project_registry",
    f"SELECT {PROJECT} AS id, arg_max('/w/x' || (event_id % 3), event_id) AS path, arg_max('n' || (event_id % 5), event_id) AS name, max(event_id) AS opened FROM events GROUP BY 1",
)
def project_registry(spark, sf_dir):
    """The last opening of each project, its path normalised."""
    e = table(spark, sf_dir, "events")
    opened = e.select(F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("id"), F.concat(F.lit("/w\\\\x"), (F.col("event_id") % 3).cast("string")).alias("path"), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("name"), F.col("event_id").alias("opened"))
    return S.upsert_projects(spark.createDataFrame([], "id string, path string, name string, opened long"), opened)


@query("recent_projects", "SELECT path, opened FROM (SELECT '/w/' || (user_id % 40) AS path, max(event_id) AS opened FROM events WHERE user_id % 40 <> 3 GROUP BY 1) ORDER BY opened DESC, path LIMIT 10")
def recent_projects(spark, sf_dir):
    """The ten paths opened last, one of them forgotten."""
    openings = table(spark, sf_dir, "events").select(F.concat(F.lit("/w/"), (F.col("user_id") % 40).cast("string")).alias("path"), F.col("event_id").alias("opened"), F.lit("n").alias("name"))
    return S.recent_projects(S.forget_project(openings, spark.range(1).select(F.lit("/w/3").alias("path")))).select("path", "opened")


@query("project_tasks", "SELECT event_id AS task_id, CASE WHEN event_type = 'click' THEN 'pending' ELSE event_type END AS status FROM events WHERE user_id % 4 = 1")
def project_tasks(spark, sf_dir):
    """What one project's queue takes up again."""
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project_id"), F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))
    return S.tasks_of_project(tasks, "p1").select("task_id", "status")


@query("research_slots", "SELECT event_id AS task_id, (row_number() OVER (ORDER BY event_id) + 1)::INT AS slot FROM (SELECT event_id FROM events WHERE event_id > 1 ORDER BY event_id LIMIT 2)")
def research_slots(spark, sf_dir):
    """One task runs, all others wait: the next two take the free slots."""
    e = table(spark, sf_dir, "events")
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") == 1, "searching").when(F.col("event_id") < 1, "done").otherwise("queued").alias("status"))
    return S.next_research(tasks)


@query("streamed_text", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS hash FROM conversations GROUP BY 1")
def streamed_text(spark, sf_dir):
    """Turns as the pieces of one stream."""
    pieces = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"))
    return C.streamed_text(pieces).select(F.col("message_id").alias("conv_id"), F.md5("text").alias("hash"))


@query(
    "cited_pages",
    """WITH a AS (SELECT conv_id, turn, turn % 4 = 3 AS listed FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 0 AS pos, CASE WHEN listed THEN 1 ELSE 2 END AS tier, 'T2' AS title, 'wiki/p2.md' AS path FROM a WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, turn, 1, 1, 'T2', 'wiki/p2.md' FROM a WHERE conv_id % 2 = 0 AND listed
UNION ALL SELECT conv_id, turn, 0, 3, 'the x', 'wiki/entities/x.md' FROM a WHERE conv_id % 2 = 1
UNION ALL SELECT conv_id, turn, 1, 3, 'queries/q', 'wiki/queries/q.md' FROM a WHERE conv_id % 2 = 1""",
)
def cited_pages(spark, sf_dir):
    """Answers that cite in a comment, in brackets, or, where they were given no numbered pages, by links."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    end = F.when(F.col("turn") % 4 == 3, F.lit(" [[x|the x]] [[queries/q]] [[x]] [1] <!-- cited: 2, 2, 9 -->")).otherwise(F.lit(" [[x|the x]] [[queries/q]] [2] [7] [2]"))
    refs = a.where("conv_id % 2 = 0").select("conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    refs = refs.withColumn("title", F.concat(F.lit("T"), F.col("pos").cast("string"))).withColumn("path", F.concat(F.lit("wiki/p"), F.col("pos").cast("string"), F.lit(".md")))
    return C.cited_pages(a.withColumn("text", F.concat(F.lit("said"), end)), refs)


@query(
    "free_file_names",
    """SELECT page_id AS id, CASE WHEN page_id % 20 = 0 THEN 'note-20240101' || CASE WHEN r > 1 THEN '-' || r ELSE '' END || '.txt'
  WHEN r = 1 THEN 'page-' || (page_id % 20) || '.md' ELSE 'page-' || (page_id % 20) || '-20240101' || CASE WHEN r > 2 THEN '-' || (r - 1) ELSE '' END || '.md' END AS path_name
FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS r FROM pages)""",
)
def free_file_names(spark, sf_dir):
    """Files of colliding names, one of which is taken already."""
    k = F.col("page_id") % 20
    names = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(k == 0, "note.txt").otherwise(F.concat(F.lit("page-"), k.cast("string"), F.lit(".md"))).alias("file_name"), F.lit("2024-01-01").cast("date").alias("day"))
    return C.free_names(names, spark.range(1).select(F.lit("note.txt").alias("file_name"))).select("id", "path_name")


@query(
    "trimmed_index",
    """SELECT conv_id, turn, CASE WHEN contains(l, 'heting') THEN '## A|x heting y|## B' ELSE '## A|## B' END || '||[...index trimmed to relevant entries...]' AS kept FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations WHERE role = 'user')""",
)
def trimmed_index(spark, sf_dir):
    """An index cut to headings and the lines that hold a word of each question."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    tokens = F.when(F.contains(F.lower("text"), F.lit("heting")), F.array(F.lit("heting"))).otherwise(F.array(F.lit("no such word")))
    index = F.lit("## A\nx heting y\nplain line\n## B\nanother line of the index that is far too long to be of any use here")
    return users.select("conv_id", "turn", F.translate(C.trimmed_index(index, tokens, F.lit(60)), "\n", "|").alias("kept"))
