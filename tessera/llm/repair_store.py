"""Token-id files under Re-Pair grammar compression, with random-access decoding.

Texts are encoded, an end id is appended to each, and documents are laid out in ascending id order in shards of about
``SHARD_TOKENS`` ids. In each shard the id pairs that stand most often beside each other within documents are
replaced by nonterminals, round after round, until no pair is frequent any more. Symbols have 16 bits as long as those
are enough, and 32 from then on; stored, they have as many bits as the largest one needs. A shard stores its rules, the
length that each rule expands to, where each document's symbols end, and the symbols; so a document, or a slice of one,
is decoded without its neighbours.

Order: ids ascending, null ids first; rows with one id in the order of their texts' hashes. A null text counts as
empty and holds the end id alone; repeated rows are stored as often as they come. An empty table gives no shards.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import rows, shared_dir

SHARD_TOKENS = 1 << 20
MIN_COUNT = 6
#: Below this, symbols have 16 bits while pairs are replaced.
SYMBOLS = 1 << 16
#: Pieces and characters of each of the cache's two generations.
CACHED, CACHED_CHARS = 600_000, 16_000_000
MAGIC = b"RPR2"


class WordBPE:
    """Ids as the tokenizers library gives them. Texts below U+0234 (which normalisation leaves alone but for case)
    are put together from a bounded cache of their pieces that the library fills; others go to it as a whole."""

    @staticmethod
    def pieces(end: int) -> re.Pattern:
        """The format's piece pattern (contractions, letters, single digits, other signs) for lower-case text of
        characters below ``end``, whose classes are listed."""
        of = lambda kind: "".join(re.escape(c) for c in map(chr, range(end)) if unicodedata.category(c)[0] == kind and c == c.lower()[:1])
        space = "\t-\r \x85\xa0"
        return re.compile(f"'(?:[stmd]|re|ve|ll)|[{of('L')}]+|[{of('N')}]|[^{space}{of('L')}{of('N')}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.odd = re.compile("[^\x00-\u0233]")
        self.split, self.split_ascii = self.pieces(0x300), self.pieces(0x80)
        self.prose = b" \n.," + bytes(c for c in range(256) if unicodedata.category(chr(c))[0] == "L" and chr(c) == chr(c).lower())
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(1 + max(vocab.values()), bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        # the same model for pieces that are normalised and split already
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))

    def _learn(self, pieces: list[list[str]]) -> None:
        """Have the library encode pieces that are not in the cache: as one text, since each piece ends in a token that
        ends a word."""
        distinct = set().union(*pieces)
        missing = distinct.difference(self.ids)
        if len(self.ids) + len(missing) > CACHED or self.held > CACHED_CHARS:  # what is still in use moves over
            self.ids, self.old, self.held, missing = {}, self.ids, 0, distinct
        self.ids.update((p, self.old[p]) for p in missing if p in self.old)
        missing = [p for p in missing if p not in self.ids]
        if missing:
            coded = np.array(self.bare.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u2")
            ends = (2 * (np.flatnonzero(self.ends_word[coded]) + 1)).tolist()
            raw = coded.tobytes()
            self.ids.update(zip(missing, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            self.held += sum(map(len, missing))

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces of a text, or None if the library must see it as a whole. Prose of Latin-1 letters with single full
        stops and commas needs no pattern: the stops are set apart, and white space separates the pieces."""
        if "<|" in text:
            return None
        low = text.lower()
        try:
            simple = not low.encode("latin-1").translate(None, self.prose)
        except UnicodeEncodeError:
            simple = False
        if simple and not any(x in low for x in ("..", ",,", ".,", ",.")):
            return low.replace(".", " . ").replace(",", " , ").split()
        if text.isascii():
            return self.split_ascii.findall(low)
        return None if self.odd.search(text) else self.split.findall(low)

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers, then ``end``."""
        plain = list(map(self._pieces, texts))
        self._learn([p for p in plain if p])
        of = self.ids.__getitem__
        whole = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
        return [(whole(t) if p is None else b"".join(map(of, p))) + end for t, p in zip(texts, plain)]


@functools.lru_cache(2)
def load(path: str) -> WordBPE:
    model = WordBPE(path)
    if model.vocab_size >= SYMBOLS:
        raise ValueError("the vocabulary leaves no room for nonterminals of 16 bits")
    return model


def compress(seq: np.ndarray, last: np.ndarray, first_symbol: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols, the flags of documents' last symbols, and the rules of each round as rows (left, right).

    Each round counts all pairs inside documents and replaces every pair that is frequent enough; where chosen pairs overlap,
    every other one of the run is taken. Rounds go on until no pair stands ``min_count`` times, however little one saves.
    """
    rounds, free = [], first_symbol
    while len(seq) > 1:
        half, number = (16, np.uint32) if seq.dtype == np.uint16 else (32, np.uint64)
        key = (seq[:-1].astype(number) << number(half)) | seq[1:]
        spread = lambda x, number=number, half=half: (x * number(0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15)) >> number(2 * half - 20)
        ok = ~last[:-1]
        bucket = spread(key)
        heavy = np.bincount(bucket[ok].astype(np.int64), minlength=1 << 20) >= min_count  # a frequent pair fills its bucket
        at = np.flatnonzero(ok & heavy[bucket])
        if not len(at):
            break
        key, bucket = key[at], bucket[at]
        run = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        pairs, n = run[edge], np.diff(np.append(edge, len(run)))
        floor = max(min_count, int(n.max()) // 256)
        chosen = np.flatnonzero(n >= floor)
        if not len(chosen):
            break
        if half == 16 and free + len(chosen) > SYMBOLS:
            seq = seq.astype(np.uint32)  # the round begins again with wider symbols
            continue
        chosen = chosen[np.argsort(n[chosen], kind="stable")]
        # one pair for each bucket, the most frequent one; others have their turn in a later round
        table = np.full(1 << 20, -1, np.int32)
        table[spread(pairs[chosen])] = np.arange(len(chosen))
        which = table[bucket]
        hit = (which >= 0) & (pairs[chosen][which] == key)
        at, which = at[hit], which[hit]
        if not len(at):
            break
        new_run = np.concatenate([[True], np.diff(at) != 1])
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - start) % 2 == 0
        at, which = at[take], which[take]
        used = np.bincount(which, minlength=len(chosen))
        worth = used >= 3  # a rule costs about as much as two symbols
        if not worth.any():
            break
        place = np.cumsum(worth) - 1
        at, which = at[worth[which]], which[worth[which]]
        rules = pairs[chosen[worth]]
        rounds.append(np.stack([rules >> number(half), rules & number((1 << half) - 1)], 1).astype(np.uint32))
        seq, last = seq.copy(), last.copy()
        seq[at] = free + place[which]
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        free += len(rules)
    return seq, last, rounds


def _planes(symbols: np.ndarray, n: int) -> bytes:
    """The low 16 bits of each symbol, then its ``n`` higher ones, each as a row of bits."""
    return b"".join([symbols.astype("<u2").tobytes(), *(np.packbits((symbols >> np.uint32(16 + k)) & np.uint32(1)).tobytes() for k in range(n))])


def pack(docs: list[bytes], first_symbol: int, min_count: int = MIN_COUNT) -> bytes:
    """One shard of documents, each little-endian unsigned 16-bit ids with at least one id."""
    seq = np.frombuffer(b"".join(docs), "<u2").astype(np.uint16)
    last = np.zeros(len(seq), bool)
    last[np.cumsum([len(d) // 2 for d in docs]) - 1] = True
    seq, last, rounds = compress(seq, last, first_symbol, min_count)
    rules = np.concatenate(rounds) if rounds else np.empty((0, 2), np.uint32)
    lengths = np.ones(first_symbol + len(rules), np.uint32)
    at = first_symbol
    for r in rounds:
        lengths[at : at + len(r)] = lengths[r[:, 0]] + lengths[r[:, 1]]
        at += len(r)
    high = max(0, (first_symbol + len(rules) - 1).bit_length() - 16)
    head = struct.pack("<4sIIIIII", MAGIC, first_symbol, len(rounds), len(rules), len(docs), len(seq), high)
    parts = [np.array([len(r) for r in rounds], "<u4"), lengths[first_symbol:].astype("<u4"), np.flatnonzero(last).astype("<u4") + 1]
    return head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts) + _planes(rules.ravel(), high) + _planes(seq.astype(np.uint32), high)


class Shard:
    """A stored shard; expansions are gathered, never replayed symbol by symbol."""

    def __init__(self, blob: bytes):
        magic, self.first, n_rounds, n_rules, self.n_docs, n_seq, high = struct.unpack_from("<4sIIIIII", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4sIIIIII")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        def symbols(n: int) -> np.ndarray:
            out = take(n, "<u2").astype(np.uint32)
            for k in range(high):
                out |= np.unpackbits(take(-(-n // 8), "u1"), count=n).astype(np.uint32) << np.uint32(16 + k)
            return out

        rounds, lengths = take(n_rounds, "<u4"), take(n_rules, "<u4")
        self.ends = take(self.n_docs, "<u4").astype(np.int64)
        rules, self.seq = symbols(2 * n_rules).reshape(-1, 2), symbols(n_seq)
        self.lengths = np.concatenate([np.ones(self.first, np.int64), lengths.astype(np.int64)])
        self.offset = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.lengths[self.first :]) - self.lengths[self.first :]])
        self.table = np.empty(self.first + int(self.lengths[self.first :].sum()), np.uint16)
        self.table[: self.first] = np.arange(self.first)
        done = 0
        for n in rounds.tolist():
            mine = self.first + np.arange(done, done + n)
            if n:
                self.table[self.offset[mine[0]] : self.offset[mine[-1]] + self.lengths[mine[-1]]] = self.expand(rules[done : done + n].ravel())
            done += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.table[np.repeat(self.offset[symbols] - (ends - n), n) + np.arange(total)]

    def doc(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of document ``i``: symbols before and after the slice are skipped by their lengths."""
        symbols = self.seq[self.ends[i - 1] if i else 0 : self.ends[i]]
        ends = np.cumsum(self.lengths[symbols])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if stop <= start:
            return np.empty(0, np.uint16)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[start - skipped : stop - skipped]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each document has."""
        n = np.add.reduceat(self.lengths[self.seq], np.concatenate([[0], self.ends[:-1]])) if self.n_docs else np.empty(0, np.int64)
        return self.expand(self.seq), n

    def docs(self) -> Iterator[np.ndarray]:
        ids, n = self.tokens()
        yield from np.split(ids, np.cumsum(n)[:-1]) if self.n_docs else ()


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> None:
    """Write ``part, shard, before, n_tokens, ids, blob`` to ``path``: ``before`` counts the ids of the part's earlier
    shards. Rows are dealt by ranges of (id, hash of text), so that ids repeated very often are split as well."""
    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = load(tokenizer), np.array([end_id], "<u2").tobytes()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, ids, docs, size
            blob = pack(docs, model.vocab_size, min_count)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "ids": pa.array([ids], pa.list_(id_type)), "blob": pa.array([blob], pa.binary())})
            shard, before, ids, docs, size = shard + 1, before + size, [], [], 0
            return out

        for batch in batches:
            id_type = batch.column(0).type
            for some, texts in rows([batch], 1_000_000):
                for i, coded in zip(some, model.encode(texts, end)):
                    ids.append(i)
                    docs.append(coded)
                    size += len(coded) // 2
                    if size >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    dealt.mapInArrow(run, f"part int, shard int, before long, n_tokens long, ids array<{kind}>, blob binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard_id`` of each stored document, decoded from the files.

    Where each part starts is summed up from one row per part (as many as the writer's partitions), the only thing
    that the driver sees.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    totals = dict(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    offset, at = {}, 0
    for p in sorted(totals):
        offset[p] = at
        at += totals[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.column(3).type.value_type
            for i in range(batch.num_rows):
                part, shard, before = (batch.column(k)[i].as_py() for k in range(3))
                ids = batch.column(3)[i].as_py()
                flat, n = Shard(batch.column(4)[i].as_py()).tokens()
                ends = np.cumsum(n)
                start, raw = offset[part] + before + ends - n, memoryview(flat.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([f"{part}/{shard}"] * len(n))], names=[id_col, "start", "n_tokens", "ids_crc32", "shard_id"])

    return shards.select("part", "shard", "before", "ids", "blob").mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long, shard_id string")


def read_slices(spark: SparkSession, path: str, start: int, stop: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: ids ``start:stop`` of each stored document (fewer or none where it ends before), found by the lengths
    of its symbols, without expanding what lies outside the slice."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, shard = batch.column(0)[i].as_py(), Shard(batch.column(1)[i].as_py())
                got = [shard.doc(k, start, stop).astype(np.int32) for k in range(len(ids))]
                ends = np.cumsum([0, *map(len, got)])
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type.value_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return shards.select("ids", "blob").mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def store_tokens(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``df`` to the shared folder and return what reading them back gives."""
    path = shared_dir(df.sparkSession, "token-shards")
    write_shards(df, path, tokenizer, end_id, id_col, text_col)
    return read_shards(df.sparkSession, path, id_col)
