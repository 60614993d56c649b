"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: words, characters of words, symbols, repeated lines and words in repeated 5-word windows. Across texts:
every line that has a word is normalised (lower case, white space collapsed, ends trimmed) and hashed together with
its host; lines that more than ``max_docs`` distinct documents (ids) of one host hold are over the limit. Such a line is
taken away from every document but the one with the host's least id, so that no content is lost altogether, and a row
that keeps less than ``min_left`` of its words is depleted and rejected.

Only hashes, ids and counts are shuffled, never texts. Rows are counted first, with partial sums before the shuffle; only
lines that more than ``max_docs`` rows hold can be over the limit, and of those alone distinct documents are counted, by
(line, id) first, so that a line that a third of all rows share is dealt to all tasks. The joins that bring lines back to
their rows are salted, and both inputs are tables written to the shared folder, so Catalyst broadcasts the smaller one
only if its measured size is under the session's limit.

Null texts count as empty and fail the base rules; a null host is a host of its own. Rows of one id are one document,
however often they are repeated. Rows without an id neither count towards the limit nor keep a line, but lose lines over
it. Rows that agree in id, host and text are judged alike. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, row_key, sized, written

MAX_DOCS = 20
MIN_LEFT = 0.3
SALTS = 8

#: Fixed values of the result's definition.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lines_of(text: Column) -> Column:
    """\\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, F.trim(F.regexp_replace(F.lower(line), SPACES, " ")))


def base_features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``id, rk`` and the counts of each row, written. All array work stays inside the row; the costly sort by (window,
    place) is only done for the few texts in which some window repeats."""
    a = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col, host_col).alias("rk"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    b = a.select("id", "rk", "t", words_of(F.col("t")).alias("w"), lines_of(F.col("t")).alias("l"))
    c = b.select(
        "id",
        "rk",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) >= 6 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END").alias("h"),
    )
    d = c.withColumn("dup", F.coalesce(F.size("h") > F.size(F.array_distinct("h")), F.lit(False)))
    e = d.withColumn("s", F.expr("CASE WHEN dup THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END")).drop("h", "dup")
    at = F.expr("sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))")
    f = e.withColumn("at", at).drop("s")
    n_repeat = F.expr("coalesce(aggregate(transform(at, (x, k) -> least(5, coalesce(get(at, k + 1), x + 5) - x)), 0L, (x, y) -> x + y), 0L)")
    g = f.withColumn("n_repeat_words", n_repeat).drop("at")
    # written, so that no later filter is pushed into the arrays' expressions
    return written(g.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "facts")


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``id, u, rk, g, w, first``: one row per line with a word; u: the row, w: its words, first: the first such line of the
    row."""
    a = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("u"), row_key(id_col, text_col, host_col).alias("rk"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    b = a.select("id", "u", "rk", F.sort_array(F.transform(lines_of(F.col("t")), lambda x: F.struct(line_key(F.col("host"), x).alias("g"), F.size(words_of(x)).alias("w")))).alias("ls"))
    return b.select("id", "u", "rk", F.expr("inline(transform(ls, (x, k) -> struct(x.g AS g, x.w AS w, int(k = 0 OR get(ls, k - 1).g <> x.g) AS first)))"))


def _salted(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def over_limit(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int = MAX_DOCS) -> DataFrame:
    """``rk, u, g, w``: the lines that are taken away, one row per line."""
    lines = written(_lines(docs, id_col, text_col, host_col), "lines")
    maybe = written(lines.groupBy("g").agg(F.sum("first").alias("n")).where(F.col("n") > max_docs).select("g"), "lines-of-many-rows", True)
    held = lines.withColumn("salt", F.pmod(F.col("u"), F.lit(SALTS)).cast("int"))
    held = written(held.join(_salted(maybe), ["g", "salt"], "left_semi").select("id", "u", "rk", "g", "w", "salt"), "lines-held")
    once = held.where("id IS NOT NULL").select("g", "id").distinct()
    often = once.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where(F.col("n") > max_docs)
    often = written(often.select("g", "keeper"), "lines-over-limit", True)
    return held.join(_salted(often), ["g", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("rk", "u", "g", "w")


def _judged(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, host_col: str, min_left: float) -> DataFrame:
    """The facts of each row with ``n_removed_words`` and ``kept``. ``gone``: the lines over the limit."""
    lost = gone.groupBy("rk", "u").agg(F.sum("w").alias("r")).groupBy("rk").agg(F.max("r").alias("r"))  # rows of one key lose alike
    out = base_features(docs, id_col, text_col, host_col).join(sized(lost), "rk", "left").withColumn("n_removed_words", F.coalesce("r", F.lit(0)).cast("long")).drop("r")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words``."""
    out = _judged(docs, written(over_limit(docs, id_col, text_col, host_col, max_docs), "lines-gone"), id_col, text_col, host_col, min_left)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their lines over the limit; columns stay as they are."""
    gone = written(over_limit(docs, id_col, text_col, host_col, max_docs), "lines-gone")
    bad = written(_judged(docs, gone, id_col, text_col, host_col, min_left).where("NOT kept").select("rk").distinct(), "rows-rejected", True)
    cut = gone.groupBy("rk").agg(F.collect_set("g").alias("gs"))
    # texts are not shuffled while these tables are few rows; else each text moves twice
    out = packed(docs, row_key(id_col, text_col, host_col).alias("rk")).join(sized(bad), "rk", "left_anti").join(sized(cut, items=F.size("gs")), "rk", "left")
    text, host = F.col("row")[text_col], F.col("row")[host_col]
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NOT_SPACE) | ~F.array_contains("gs", line_key(host, x))), "\n")
    return out.select(*(F.when(F.col("gs").isNull(), text).otherwise(cleaned).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
