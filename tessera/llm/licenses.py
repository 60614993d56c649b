"""License scans with a positional index of rare words.

Templates are public licence texts and notices (see ``license_texts``), each with mandatory key phrases. Over all documents
it is counted how many hold each word of the templates; these counts give the words their IDF. The index holds, for each
word, where it stands in the templates' key phrases.

Of a file's words, those in the index are ranked by IDF and looked up from the top, until ``LOOKUPS`` words of each
template that can be there are (one with a key word that the file lacks cannot). Each posting gives relative positions of
a template in the file; those that all looked-up words agree on are intersected, and there the template's first key
phrase is verified word for word. As a phrase cannot stand anywhere without its rarest words, every place is found.

A text, whose words may have been changed or moved a little, is then followed from that phrase to both ends; a word that is
not at its place is sought up to ``SLACK`` words further. The text counts if the other key phrases stand within ``SLACK``
words of their places and at least ``COVERED`` of the words' IDF is found; a notice counts by its key phrase. Each scores
the IDF-weighted share of its words that are at their places, and the file's score is the best, 0 without any.

Null and empty texts have no words and no labels. Rows are scanned one by one, repeated rows alike, and are counted as
often as they come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, rows
from tessera.llm.license_texts import BASE, NOTICES, TEXTS

LOOKUPS, SLACK, COVERED = 3, 12, 0.7


@dataclass(frozen=True)
class Template:
    """Words, and where each key phrase starts and how many words it has; the first one is the anchor."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]
    base: bool = False
    whole: bool = False

    def phrase(self, k: int = 0) -> tuple[str, ...]:
        at, size = self.keys[k]
        return self.words[at : at + size]


def _notice(label: str, before: str, phrase: str, after: str, base: bool) -> Template:
    a, b, c = before.split(), phrase.split(), after.split()
    return Template(label, (*a, *b, *c), ((len(a), len(b)),), base)


def _text(label: str, text: str, phrases: tuple[str, ...]) -> Template:
    words, keys = tuple(alnum_words(text)), []
    for phrase in (tuple(p.split()) for p in phrases):
        keys.append((next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), len(phrase)))
    return Template(label, words, tuple(keys), whole=True)


TEMPLATES = tuple([_notice(*t, True) for t in BASE] + [_notice(*t, False) for t in NOTICES] + [_text(*t) for t in TEXTS])


class RareWordIndex:
    """Postings of the anchors' words under document frequencies ``df`` of ``n`` documents."""

    def __init__(self, df: dict[str, int], n: int, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for t in templates for w in t.words}
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(t.phrase()):
                self.postings.setdefault(w, []).append((k, i))
        self.key_words = [frozenset(w for j in range(len(t.keys)) for w in t.phrase(j)) for t in templates]
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}
        self.total = [sum(self.idf[w] for w in t.words) for t in templates]

    def places(self, words: list[str]) -> list[tuple[int, int]]:
        """(start of the anchor, template) of every place where the anchor is verified."""
        held = set(words)
        can = {k for k, need in enumerate(self.key_words) if need <= held}
        if not can:
            return []
        # the file's licence words from the rarest on, until each template has had its look-ups
        left = {k: min(LOOKUPS, len(set(self.templates[k].phrase()))) for k in can}
        chosen: dict[str, list[tuple[int, int]]] = {}
        for w in sorted(held & self.rank.keys(), key=self.rank.__getitem__):
            mine = [(k, i) for k, i in self.postings[w] if left.get(k)]
            if mine:
                chosen[w] = mine
                for k in {k for k, _ in mine}:
                    left[k] -= 1
                if not any(left.values()):
                    break
        at: dict[str, list[int]] = {w: [] for w in chosen}
        for p, w in enumerate(words):
            if w in at:
                at[w].append(p)
        agreed: dict[int, set[int]] = {}
        for w, mine in chosen.items():
            for k in {k for k, _ in mine}:
                if k in agreed and not agreed[k]:
                    continue
                starts = {p - i for t, i in mine if t == k for p in at[w]}
                agreed[k] = agreed[k] & starts if k in agreed else starts
        out = []
        for k, starts in agreed.items():
            phrase, size = self.templates[k].phrase(), len(self.templates[k].phrase())
            out += [(s, k) for s in starts if s >= 0 and tuple(words[s : s + size]) == phrase]
        return sorted(out)

    def coverage(self, words: list[str], s: int, k: int) -> float:
        """The IDF-weighted share of a template's words that stand at their places around its anchor at ``s``."""
        t, (at, size) = self.templates[k], self.templates[k].keys[0]
        slack = SLACK if t.whole else 0
        got = sum(map(self.idf.__getitem__, t.phrase()))
        after = self._follow(words[s + size : s + size + len(t.words) - at - size + slack], t.words[at + size :], slack)
        before = self._follow(words[max(0, s - at - slack) : s][::-1], t.words[:at][::-1], slack)
        return (got + after + before) / self.total[k]

    def _follow(self, words: list[str], wanted: tuple[str, ...], slack: int) -> float:
        """IDF of the wanted words found in order; after a word that is not there, two in a row set the place anew."""
        got, p = 0.0, 0
        for i, w in enumerate(wanted):
            if p < len(words) and words[p] == w:
                got += self.idf[w]
            elif slack and i + 1 < len(wanted):
                pair = [w, wanted[i + 1]]
                moved = next((q for q in range(max(0, p - slack), p + slack) if words[q : q + 2] == pair), None)
                if moved is not None:
                    got, p = got + self.idf[w], moved
            p += 1
        return got

    def verified(self, words: list[str], s: int, k: int) -> float | None:
        """The score of a template at an anchor, or None if a text's other key phrases or too many words are missing."""
        t = self.templates[k]
        score = self.coverage(words, s, k)
        if t.whole:
            for j, (at, size) in enumerate(t.keys[1:], 1):
                place, phrase = s + at - t.keys[0][0], list(t.phrase(j))
                if not any(words[q : q + size] == phrase for q in range(max(0, place - SLACK), place + SLACK + 1)):
                    return None
            if score < COVERED:
                return None
        return score

    def scan(self, text: str) -> tuple:
        words = alnum_words(text)
        found = [(s, k, x) for s, k in self.places(words) if (x := self.verified(words, s, k)) is not None]
        base = [(s, self.templates[k].label) for s, k, _ in found if self.templates[k].base]
        starts = [s for s, _ in base]
        labels = {self.templates[k].label for _, k, _ in found}
        score = min(1.0, max((x for *_, x in found), default=0.0))
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def word_frequencies(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[str, int], int]:
    """How many of all documents hold each word of the templates, and how many documents there are."""
    vocab = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, dict.fromkeys(vocab, 0)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                for w in vocab.intersection(alnum_words(text.as_py())):
                    df[w] += 1
        yield pa.RecordBatch.from_pydict({"w": ["", *df], "n": pa.array([n, *df.values()], pa.int64())})

    total = docs.select(text_col).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = {r.w: r.n for r in total.collect()}  # one row for each word of the templates
    return got, got.pop("", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row."""
    index = RareWordIndex(*word_frequencies(docs, text_col, templates), templates)
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows([batch]):
                got = zip(*map(index.scan, texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, k) for c, k in zip(got, kinds))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
