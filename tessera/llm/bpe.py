"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that lies inside no token of the vocabulary can never be merged over, so every place where such a pair
stands is a certain cut. A piece of text is cut there, each fragment is merged on its own, and the ids are
concatenated: the result is the same as merging the whole piece, but the fragments are short and repeat often, so
that most of them come from a bounded cache.

Null text counts as empty; an empty text has no ids, and its hashes are those of nothing. Rows with equal ids are
encoded one by one, and columns other than the two named ones are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import Bounded, rows

#: The pre-tokenizer's pattern and white space (Unicode White_Space), fixed values of the public format.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)



#: Bits of an id, and what stands for a pair that is never merged.
BITS, NEVER = 20, 1 << 60


def _byte_chars() -> dict[str, int]:
    """The format's stand-in character of each byte: itself if printable Latin-1, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

#: Texts below this character are cut into pieces by a pattern that lists the letters and digits, which is quicker.
LISTED = 0x250


def _listed_pieces() -> re.Pattern:
    """The pattern of the format for characters below ``LISTED``."""
    of = {kind: "".join(re.escape(c) for c in map(chr, range(LISTED)) if unicodedata.category(c)[0] == kind) for kind in "LN"}
    space = r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{of['L']}]+| ?[{of['N']}]+| ?[^{space}{of['L']}{of['N']}]+|[{space}]+(?![^{space}])|[{space}]+")


class ForcedBoundaryBPE:
    """The vocabulary, its merge ranks, and the table of byte pairs that lie inside some token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_chars()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(of[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:]):
                inside[a, b] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # one pattern that finds the gaps between bytes that no token spans
        self.cut = [bytes(np.flatnonzero(~inside[a]).astype(np.uint8)) for a in range(256)]
        self.never = [frozenset(c) for c in self.cut]
        self.pieces, self.listed, self.unlisted = regex.compile(PIECES), _listed_pieces(), re.compile(f"[^\\x00-{chr(LISTED - 1)}]")
        # both ids of a pair in one number, and its rank with the id it makes in another
        self.pairs = {a << BITS | b: rank << BITS | made for (a, b), (rank, made) in self.ranks.items()}
        self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragment = Bounded(self._merge, 50_000)
        self.piece = Bounded(self._piece, 120_000)

    def _merge(self, raw: bytes) -> bytes:
        """Ids of one fragment: the lowest-ranked pair is merged first, the leftmost of equals. What can be merged is kept
        beside the ids, and each merge looks up the two pairs that it changes."""
        ids, get = list(map(self.byte_id.__getitem__, raw)), self.pairs.get
        if len(ids) > 48:
            ids = self._merge_long(ids)
        else:
            can = [get(a << BITS | b, NEVER) for a, b in zip(ids, ids[1:])]
            while can and (best := min(can)) != NEVER:
                i, made = can.index(best), best & (1 << BITS) - 1
                ids[i : i + 2] = (made,)
                del can[i]
                if i:
                    can[i - 1] = get(ids[i - 1] << BITS | made, NEVER)
                if i < len(can):
                    can[i] = get(made << BITS | ids[i + 1], NEVER)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As above with a heap over a linked list: n log n for fragments of any length."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at every forced boundary."""
        out, start, never = [], 0, self.never
        for i in range(1, len(raw)):
            if raw[i] in never[raw[i - 1]]:
                out.append(raw[start:i])
                start = i
        out.append(raw[start:])
        return out

    def _piece(self, piece: str) -> bytes:
        parts = self.fragments(piece.encode())
        if len(parts) == 1:  # the piece's own place in the cache is enough
            return self._merge(parts[0])
        if len(parts[0]) > 4096 or len(parts) > 4096:  # too long to be worth a place in the cache
            return b"".join(map(self._merge, parts))
        return b"".join(map(self.fragment.__getitem__, parts))

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces if self.unlisted.search(text) else self.listed
        return b"".join(map(self.piece.__getitem__, pieces.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.stop is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.stop.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids``
    (little-endian unsigned 32-bit). The text is decoded again from the ids, nothing is shuffled."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for ids, texts, id_type in ((i, t, b.column(0).type) for b in batches for i, t in rows([b])):
            coded = [model.encode(t) for t in texts]
            out = {
                "ids": pa.array(ids, id_type),
                "n": pa.array([len(c) // 4 for c in coded], pa.int64()),
                "sha": [hashlib.sha256(c).hexdigest() for c in coded],
                "back": [hashlib.sha256(model.decode(c).encode()).hexdigest() for c in coded],
            }
            if keep_ids:
                out["coded"] = pa.array(coded, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, list) else v for v in out.values()], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``doc_id, text`` from a column of little-endian unsigned 32-bit ids; null ids give a null text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = [None if not x.is_valid else model.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
