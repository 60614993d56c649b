"""Streams of events cut anywhere and delivered in any order."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.streaming import queues as S
from tessera.streaming import task_queue as Q
from tessera.streaming import token_stream as T

TEXTS = ["plain", "", "two\nlines", "é😀 漢字\n\n  kept  \nend", "a\n", "data: inside\nevent: x", "x" * 300]


def test_every_cut_of_the_bytes_gives_the_lines():
    for text in TEXTS:
        raw = "".join(f"data: {x}\n" for x in text.split("\n")).encode() + b": ping\r\nevent: x\r\ndata: [DONE]"
        for size in range(1, 12):
            carry, said = b"", []
            for at in range(0, len(raw), size):
                lines, carry = T.framed(carry, raw[at : at + size], at + size >= len(raw))
                said += [p for x in lines if (p := T.payload(x)) is not None]
            assert said == [*text.split("\n"), "[DONE]"] and carry == b""
    assert T.payload(b"data:x") == "x" and T.payload(b"data:  x") == " x" and T.payload(b"id: 1") is None


@pytest.mark.parametrize("size", [1, 5])
def test_messages_from_pieces_out_of_order(spark, size):
    rng = random.Random(size)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "message_id long, text string").where("length(text) < 100")
    pieces = [tuple(r) for r in rows.select("message_id", F.explode(T.cut(F.col("text"), size)).alias("p")).select("message_id", "p.*").collect()]
    rng.shuffle(pieces)
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("pieces", "lines", "checkpoint"))
    schema = "message_id long, seq long, piece binary, last boolean"

    def run(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        with Q.timed_state(spark):
            return S.replay(stream, T.said_lines, out, checkpoint)

    half = len(pieces) // 2
    run(pieces[:half] + [(None, 0, b"x", True), (99, None, b"x", True)])
    lines = run(pieces[half:] + pieces[:20])  # some come again
    got = {r.message_id: r.text for r in T.messages(lines).collect()}
    assert got == {r.message_id: r.text for r in rows.collect()}
    assert lines.groupBy("message_id", "line").count().where("count > 1").count() == 0
