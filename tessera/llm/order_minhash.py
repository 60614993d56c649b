r"""Order MinHash fingerprints, in DataFrame and SQL functions only.

A text is cut into tokens: runs of at most ``TOKEN`` characters that are no white space. Its k-mers are the pairs of
consecutive tokens, and the last token alone. Equal k-mers of a text are told apart by a running number, so that how often
one occurs counts. Every numbered k-mer has a place on a circle of 64-bit hashes; for each of ``SLOTS`` evenly spaced points
of the circle the ``2`` k-mers that follow it are the minimal ones of that slot's order. They are put back into the order
in which the text has them, and the hash of the ordered pair is the slot's value. Two texts agree in a slot only if they
have the same minimal k-mers in the same order, so the share of equal slots falls with edits and with moved parts alike.
A fingerprint is the slots' low 16 bits in hexadecimal.

Everything up to the fingerprint happens within a row: one regular expression, two sorts of an array of longs, and lambdas
that visit each k-mer a fixed number of times. The running numbers come from the runs of the sorted k-mers, not from
comparing all of them.

``next_texts`` gives each row the row before it in a total order without a window over everything: keys alone are
range-partitioned, each range's largest key bounds a block, and texts are shuffled once, by block. The bounding row of a
block also goes to the block after it. A key (id and text) so frequent that it fills a range of its own is counted
instead: one of its rows stays in the order, and the others, whose neighbour is an equal row, come from the count.

Texts are equal where they are equal as a whole; null texts count as empty. Empty texts and those of white space alone
have a fingerprint of zeros. Rows of one id are ordered by a hash of their text, rows without an id come last; a table of
one row is its own neighbour. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

TOKEN = 8
SLOTS = 64
#: A place in the text takes the low bits of a long beside a hash in the others, so k-mers are told apart by 36 bits.
PLACE_BITS = 28
#: Blocks for each shuffle partition, and the rows that one task makes of a counted key.
BLOCKS, COPIES = 4, 100_000

_MASK = (1 << PLACE_BITS) - 1
_BIN = 64 - (SLOTS.bit_length() - 1)


def _bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hash_part(x: str) -> str:
    return f"shiftrightunsigned({x}, {PLACE_BITS})"


def _place(x: str) -> str:
    return f"cast({x} & {_MASK}L as int)"


def _slot(at: str) -> str:
    """The value of the slots whose first minimal k-mer stands at ``at`` of the circle ``c``."""
    pair = _bound(f"array({_place(f'get(c, {at})')}, {_place(f'get(c, ({at} + 1) % n)')})", "p", "xxhash64(get(h, least(p[0], p[1])), get(h, greatest(p[0], p[1])))")
    return f"cast({pair} & 65535L as int)"


def _bin(x: str) -> str:
    return f"cast(shiftright({x}, {_BIN}) + {SLOTS // 2} as int)"


def slots(text: str) -> Column:
    """The ``SLOTS`` values of a text (SQL of a column that is never null)."""
    starts = lambda a, key: f"filter(sequence(0, n - 1), k -> k = 0 OR {key(f'get({a}, k - 1)')} <> {key(f'get({a}, k)')})"
    numbered = f"transform(st, (a, r) -> transform(sequence(a, coalesce(get(st, r + 1), n) - 1), k -> (xxhash64({_hash_part('get(s, k)')}, cast(k - a as bigint)) & {~_MASK}L) | (get(s, k) & {_MASK}L)))"
    # a run of k-mers in one arc of the circle serves all points from the run before up to that arc
    filled = f"transform(bs, (a, r) -> array_repeat({_slot('a')}, {_bin('get(c, a)')} - if(r = 0, -1, {_bin('get(c, get(bs, r - 1))')})))"
    out = f"concat(flatten({filled}), array_repeat({_slot('0')}, {SLOTS - 1} - {_bin('get(c, n - 1)')}))"
    out = _bound(starts("c", lambda x: f"shiftright({x}, {_BIN})"), "bs", out)
    out = _bound(f"sort_array(flatten({numbered}))", "c", out)
    out = _bound(starts("s", _hash_part), "st", out)
    out = _bound(f"sort_array(transform(h, (x, i) -> (x & {~_MASK}L) | i))", "s", out)
    out = _bound("size(h)", "n", f"CASE WHEN n = 0 THEN array_repeat(0, {SLOTS}) ELSE {out} END")
    out = _bound("transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))", "h", out)
    return F.expr(_bound(rf"regexp_extract_all({text}, '\\S{{1,{TOKEN}}}', 0)", "w", out))


def fingerprint(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two texts agree, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SLOTS))


def _literal(rows: list, kind) -> Column:
    """Keys as a literal array."""
    return F.array(*(F.struct(F.lit(r.id).cast(kind).alias("id"), F.lit(r.th).alias("th")) for r in rows))


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, slots, next_text, next_slots``: each row with the next one by falling id, after the last the first."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k", F.struct("id", F.xxhash64("text").alias("th")))
    n_blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = each.select("k", F.monotonically_increasing_id().alias("u")).repartitionByRange(n_blocks, "k", "u")
    tops = [r.k for r in keys.groupBy(F.spark_partition_id()).agg(F.max("k").alias("k")).orderBy("k").collect()]
    bounds = [k for i, k in enumerate(tops) if not i or k != tops[i - 1]]
    hot = [k for i, k in enumerate(tops) if i and k == tops[i - 1] and (i == 1 or k != tops[i - 2])]
    if not tops:
        return each.select("id", "text", slots("text").alias("slots"), F.col("text").alias("next_text"), slots("text").alias("next_slots"))
    ends = _literal(bounds, kind)
    copies = []
    if hot:
        often = F.array_contains(_literal(hot, kind), F.col("k"))
        one = each.where(often).groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("c"))
        one = written(one.select("k.id", "text", "k", "c"), "frequent-rows")
        each = each.where(~often).unionByName(one.drop("c"))
        parts = one.where("c > 1").select("id", "text", F.explode(F.expr(f"transform(sequence(0L, (c - 2) DIV {COPIES}), i -> least({COPIES}L, c - 1 - i * {COPIES}))")).alias("m"))
        same = parts.withColumn("slots", slots("text")).select("*", F.col("text").alias("next_text"), F.col("slots").alias("next_slots"))
        copies = [same.repartition(n_blocks, F.xxhash64("id", "m", F.monotonically_increasing_id())).withColumn("i", F.explode(F.expr("sequence(1L, m)"))).drop("i", "m")]
    block = F.size(F.filter(ends, lambda x: x < F.col("k")))
    placed = each.select("id", "text", "k", slots("text").alias("slots"), block.alias("b"))
    # the bounding row of a block is also the neighbour of the first row of the block after it
    twice = F.when(F.array_contains(ends, F.col("k")), F.array(F.col("b"), (F.col("b") + 1) % len(bounds))).otherwise(F.array("b"))
    dealt = placed.select("id", "text", "k", "slots", F.posexplode(twice).alias("guest", "block"))
    order = Window.partitionBy("block").orderBy(F.desc("guest"), "k")
    # rows of equal keys bound a block together: each comes as a guest, and the last of them is the neighbour
    seen = dealt.select("id", "text", "slots", "guest", F.lag("text").over(order).alias("next_text"), F.lag("slots").over(order).alias("next_slots"))
    return reduce(DataFrame.unionByName, copies, seen.where("guest = 0").drop("guest"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", fingerprint(slots("t")).alias("fingerprint")).withColumnRenamed("id", id_col)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, and the same text with its last third replaced by as many characters from the start of the next one:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    a = next_texts(docs, id_col, text_col).withColumn("n", F.length("text")).withColumn("m", F.expr("n DIV 3").cast("int"))
    edited = F.concat(F.expr("left(text, n - m)"), F.expr("left(next_text, m)"))
    b = a.select("id", "n", "slots", "next_slots", edited.alias("edited"))
    c = b.select("id", "n", "slots", "next_slots", F.sha2("edited", 256).alias("edited_sha256"), slots("edited").alias("edited_slots"))
    out = (fingerprint(F.col("slots")), fingerprint(F.col("edited_slots")), likeness(F.col("slots"), F.col("edited_slots")), likeness(F.col("slots"), F.col("next_slots")))
    names = ("fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return c.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", *(x.alias(c) for x, c in zip(out, names)))
