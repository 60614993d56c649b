"""Streamed answers put together from the bytes of their events, whatever way those are cut and whichever batch they come in.

A message comes as pieces of bytes (``message_id, seq, piece, last``), numbered from 0. The state of a message holds the pieces
that came before their turn and the bytes of the line that is still open; since a line end is never part of a longer
character, characters that a cut splits are whole again once their line is. Each finished line that holds data goes out
as a row, once; the state of a message ends with its last piece. A piece that comes again changes nothing, null pieces are
empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The field and the end mark of an event stream: fixed values.
DATA, DONE = b"data:", "[DONE]"


def framed(carry: bytes, piece: bytes, last: bool) -> tuple[list[bytes], bytes]:
    """Finished lines, without their ends, and what is open; the last piece finishes its line."""
    *lines, rest = (carry + piece).split(b"\n")
    if last and rest:
        lines, rest = [*lines, rest], b""
    return [x.removesuffix(b"\r") for x in lines], rest


def payload(line: bytes) -> str | None:
    """What a data line says, without the one space that may follow the colon; null for other lines."""
    if not line.startswith(DATA):
        return None
    return line[len(DATA) :].removeprefix(b" ").decode("utf-8", "replace")


class Framer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "next long, lines long, carry binary, ended boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "piece binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, n, carry, ended = self.open.get() if self.open.exists() else (0, 0, b"", False)
        out = []
        for f in rows:
            for seq, piece, last in zip(f["seq"].tolist(), f["piece"], f["last"].tolist()):
                if not ended and seq >= at:
                    self.waiting.updateValue((seq,), (bytes(piece) if piece is not None else b"", bool(last)))
        carry = bytes(carry)
        while not ended and self.waiting.exists() and self.waiting.containsKey((at,)):
            piece, ended = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            lines, carry = framed(carry, bytes(piece), ended)
            for x in lines:
                if (said := payload(x)) is not None and said != DONE:
                    out.append((key[0], n, said))
                    n += 1
            at += 1
        self.open.update((at, n, carry, ended))
        yield pd.DataFrame(out, columns=["message_id", "line", "said"])

    def close(self) -> None:
        pass


def said_lines(pieces: DataFrame) -> DataFrame:
    """``message_id, line, said``: the data of each finished line, numbered from 0. ``pieces``: a stream of ``message_id, seq, piece,
    last``. Start it inside ``timed_state``."""
    kind = pieces.schema["message_id"].dataType.simpleString()
    known = pieces.where("message_id IS NOT NULL AND seq IS NOT NULL").select("message_id", "seq", "piece", F.coalesce("last", F.lit(False)).alias("last"))
    return known.groupBy("message_id").transformWithStateInPandas(Framer(), f"message_id {kind}, line long, said string", "Append", "None")


def messages(lines: DataFrame) -> DataFrame:
    """``message_id, text``: what each message has said so far, line by line."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"])
    return lines.groupBy("message_id").agg(F.array_join(said, "\n").alias("text"))


def cut(text: Column, size: int) -> Column:
    """A text as the events of a stream, its bytes cut into pieces of ``size``: an array of ``seq, piece, last``."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("data: "), x, F.lit("\n")))
    raw = F.encode(F.concat(F.array_join(lines, ""), F.lit("data: [DONE]\n")), "UTF-8")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("seq"), F.substring(raw, i * size + 1, F.lit(size)).alias("piece"), (i == n - 1).alias("last")))
