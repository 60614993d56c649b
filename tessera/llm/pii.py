"""Personal data with a skip-chain conditional random field.

Base spans of four kinds come from fixed patterns and checks. Beyond them, every token with a digit or an at sign is
a node of a random field over the kinds, ``secret`` (credentials) and ``none``. Adjacent nodes of a text share a chain
potential; nodes whose contents are equal or similar (same letters and digits, or the same last ``TAIL`` digits), however
far apart, share a skip potential. Base spans are nodes whose label is observed. So is that of a content that one mention
settles by itself (a card or phone number, a credential whose own features leave no doubt): it is observed in all its
mentions, which many mentions without a cue cannot outvote; so what is personal in one place is personal wherever the
text repeats it. Loopy message passing, until the messages no longer change, settles the other labels given the observed
ones. Tokens without digits or at signs are taken as ``none``; nodes of one content are linked in a row, each with the
next, so a text's links grow with its nodes.

All potentials are fitted by pseudo-likelihood, on nodes that are not base spans. Their silver labels: ``secret`` for
strings assigned to a credential word and their repeats, a base kind for repeats of a card's or phone number's digits,
else ``none``. The sample is at most ``MAX_TRAIN_DOCS`` different rows (least hashes) of at most ``MAX_TRAIN_NODES`` nodes
each, a documented limit of the fit; every text is then searched as a whole.

Null and empty texts have no spans. Rows are searched one by one, repeated rows alike.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_key, rows

#: Kinds in the order of the result's definition; the method's own kind follows.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
NONE = len(KINDS)
RANK = {k: i for i, k in enumerate(KINDS)}
#: Kinds whose digits are the content, wherever they are repeated; short addresses may be equal to other numbers.
ITS_DIGITS = (RANK["card"], RANK["phone"])

MAX_TRAIN_DOCS, MAX_TRAIN_NODES = 2000, 500
#: The rounds are a bound that is warned of, not the usual end.
ROUNDS, STILL, SURE, TAIL = 5000, 1e-4, 0.9, 7
STEPS, RATE, L2 = 300, 0.1, 2e-4
#: Log-potential of the labels that an observed node does not have.
NEVER = -1e4

# the definition's patterns, so written that long runs cost linear time
_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

_run = re.compile(r"[^\s\"'<>|,;=]+")
_marked = re.compile(r"[0-9@]")
_opens, _closes = re.compile(r"[A-Za-z0-9+@(]"), re.compile(r"[A-Za-z0-9)]")
_cue = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_ -]?key|key|bearer|auth)\b[\s\"':=]*$")
_silver = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_ -]?key|bearer)\b\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/]{12,})")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run of local characters before it, from the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _domain.match(text, at + 1):
            s = at
            while s > done and _local.match(text[s - 1]):
                s -= 1
            if s < at:
                yield s, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) sorted by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(s, "email", e) for s, e in _emails(text)]
    if _digit.search(text):
        out += [(m.start(), "ip", m.end()) for m in _ip.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or "0") <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], RANK[x[1]], x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


FEATURES = ("bias", "at", "digits", "letters", "hex", "long", "very_long", "cue", "assigned", "quoted", "dots", "plus", "mixed_long")


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs between delimiters that hold a digit or an at sign, without the signs around them: each character is looked
    at a few times, however long a run is."""
    for m in _run.finditer(text):
        x = m[0]
        if _marked.search(x) and (first := _opens.search(x)) and (last := _closes.search(x[::-1])):
            s, e = first.start(), len(x) - last.start()
            if s < e:
                yield m.start() + s, m.start() + e


def nodes(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, np.ndarray, str, str, int]]:
    """(start, end, features, content key, key of the last digits, base kind or -1) in text order."""
    if not base and "@" not in text and not _digit.search(text):
        return []
    spans = {(s, e): RANK[k] for s, k, e in reversed(base)}
    covered = sorted(spans)
    i = 0
    for s, e in _tokens(text):
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i < len(covered) and covered[i][0] < e:
            continue
        spans[s, e] = -1
    out = []
    for (s, e), kind in sorted(spans.items()):
        x = text[s:e]
        plain = "".join(ch for ch in x.lower() if ch.isalnum())
        digits = "".join(ch for ch in x if ch in "0123456789")
        before = text[max(0, s - 24) : s]
        n, letters = max(1, len(plain)), len(plain) - len(digits)
        is_hex = len(plain) >= 12 and all(ch in "0123456789abcdef" for ch in plain)
        cue = bool(_cue.search(before))
        f = (1, "@" in x, len(digits) / n, letters / n, is_hex and 0 < letters, len(plain) >= 12, len(plain) >= 24, cue, before.rstrip(" \"'")[-1:] in ("=", ":"), before[-1:] in ('"', "'"), x.count(".") / 3, before[-1:] == "+", cue and len(plain) >= 12)
        out.append((s, e, np.array(f, np.float32), plain, digits[-TAIL:] if len(digits) >= TAIL else "", kind))
    return out


def links(per_text: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain and skip links (pairs of node numbers) of texts whose nodes are numbered one after the other and given by
    their two keys."""
    chain, skip, at = [], set(), 0
    for found in per_text:
        last: dict[str, int] = {}
        for i, (plain, tail) in enumerate(found, at):
            if i > at:
                chain.append((i - 1, i))
            for key in (plain, tail and f"#{tail}"):
                if key:
                    if key in last:
                        skip.add((last[key], i))
                    last[key] = i
        at += len(found)
    as_pairs = lambda x: np.array(sorted(x), np.int64).reshape(-1, 2)
    return as_pairs(chain), as_pairs(skip)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class SkipChainCRF:
    """Node weights, a table of chain potentials and one of skip potentials."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, free: np.ndarray) -> SkipChainCRF:
        """Pseudo-likelihood of the ``free`` nodes: each given the labels of its neighbours. The skip potential is a table
        and one strength by which equal labels attract, which all kinds share, so that rare ones learn it as well."""
        k, n = NONE + 1, len(x)
        one = np.eye(k)
        seen = [np.zeros((n, k)) for _ in range(3)]  # labels before in the chain, after it, and over skips
        if n:
            np.add.at(seen[0], chain[:, 1], one[y[chain[:, 0]]])
            np.add.at(seen[1], chain[:, 0], one[y[chain[:, 1]]])
            for a, b in ((0, 1), (1, 0)):
                np.add.at(seen[2], skip[:, a], one[y[skip[:, b]]])
        w = np.zeros((x.shape[1], k))
        w[0, NONE] = 1.0
        params, m, v = [w, np.zeros((k, k)), np.zeros((k, k)), np.zeros(1)], [0.0] * 4, [0.0] * 4
        for step in range(1, STEPS + 1 if free.any() else 1):
            w, c, s, same = params
            p = _softmax(x @ w + seen[0] @ c + seen[1] @ c.T + seen[2] @ s + same * seen[2])
            r = (one[y] - p) * free[:, None] / free.sum()
            gs = seen[2].T @ r
            grads = [x.T @ r - L2 * w, seen[0].T @ r + r.T @ seen[1] - L2 * c, (gs + gs.T) / 2 - L2 * s, (seen[2] * r).sum() - L2 * same]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                params[i] = params[i] + RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        w, c, s, same = params
        return cls(w, c, s + same * np.eye(k))

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Loopy message passing on the links of all texts at once; damped, until no message changes by
        more than ``STILL``. ``given``: the observed kind of each node, or -1."""
        unary = x @ self.node
        if not len(x):
            return unary
        if given is not None:
            at = np.flatnonzero(given >= 0)
            unary[at] = NEVER
            unary[at, given[at]] = 0
        a, b = np.concatenate([chain, skip]).T
        pots = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), unary.shape[1]))
        for _ in range(ROUNDS if len(src) else 0):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            new = np.logaddexp.reduce(out[:, :, None] + pots, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change <= STILL:
                break
        else:
            if len(src):
                warnings.warn(f"messages still change by {change:.2g} after {ROUNDS} rounds", stacklevel=2)
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)

    def observed(self, x: np.ndarray, per: list[list]) -> np.ndarray:
        """The kind of each node that is a base span or whose content one of its mentions in the text settles, or -1."""
        own, secret = _softmax(x @ self.node), RANK["secret"]
        out, at = np.full(len(x), -1), 0
        for found in per:
            known: dict[str, int] = {}
            for i, (*_, plain, _, kind) in enumerate(found, at):
                if kind < 0 and own[i, secret] >= SURE:
                    kind = secret
                elif kind not in ITS_DIGITS:
                    continue
                known[plain] = min(kind, known.get(plain, NONE))
            for i, (*_, plain, _, kind) in enumerate(found, at):
                out[i] = kind if kind >= 0 else known.get(plain, -1)
            at += len(found)
        return out

    def added(self, texts: list[str], bases: list[list]) -> list[list[tuple[int, str, int]]]:
        """Spans of each text that the field adds to the base ones."""
        per = [nodes(t, b) for t, b in zip(texts, bases)]
        flat = [n for p in per for n in p]
        if not flat:
            return [[] for _ in texts]
        x = np.stack([n[2] for n in flat]).astype(np.float64)
        p = self.marginals(x, *links([[n[3:5] for n in found] for found in per]), self.observed(x, per))
        best, sure = p.argmax(1), p.max(1) >= SURE
        out, at = [], 0
        for found in per:
            out.append([(n[0], KINDS[best[i]], n[1]) for i, n in enumerate(found, at) if best[i] != NONE and sure[i] and n[5] < 0])
            at += len(found)
        return out


def silver(text: str) -> tuple[list, list[int]]:
    """Nodes of a text and their training labels."""
    found = nodes(text, base_spans(text))
    secret = [m.span(1) for m in _silver.finditer(text)]
    known, k = {n[3]: n[5] for n in reversed(found) if n[5] in ITS_DIGITS}, 0
    for n in found:  # both in text order
        while k < len(secret) and secret[k][1] <= n[0]:
            k += 1
        if n[5] < 0 and k < len(secret) and secret[k][0] < n[1]:
            known.setdefault(n[3], RANK["secret"])
    return found, [n[5] if n[5] >= 0 else known.get(n[3], NONE) for n in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS, max_nodes: int = MAX_TRAIN_NODES) -> SkipChainCRF:
    """Fit on at most ``max_docs`` different rows that hold a digit or an at sign (least hashes of id and text); of them,
    those of more than ``max_nodes`` nodes are passed over, so what the driver gets is bounded."""
    some = docs.select(row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    chosen = some.select("rk").distinct().orderBy("rk").limit(max_docs)
    schema = pa.schema([("rk", pa.binary()), ("x", pa.binary()), ("y", pa.list_(pa.int32())), ("base", pa.list_(pa.bool_())), ("keys", pa.list_(pa.string())), ("tails", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rk, t in zip(*batch.columns):
                found, y = silver(t.as_py())
                if len(found) <= max_nodes:
                    yield pa.RecordBatch.from_pydict({"rk": [rk.as_py()], "x": [b"".join(n[2].tobytes() for n in found)], "y": [y], "base": [[n[5] >= 0 for n in found]], "keys": [[n[3] for n in found]], "tails": [[n[4] for n in found]]}, schema=schema)

    rows_ = some.join(F.broadcast(chosen), "rk", "left_semi").mapInArrow(run, "rk binary, x binary, y array<int>, base array<boolean>, keys array<string>, tails array<string>")
    got = sorted(rows_.dropDuplicates(["rk"]).collect(), key=lambda r: bytes(r["rk"]))  # rows of one key have equal nodes
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    flat = lambda c, kind: np.array([v for r in got for v in r[c]], kind)
    return SkipChainCRF.fit(x, flat("y", np.int64), *links([list(zip(r["keys"], r["tails"])) for r in got]), ~flat("base", bool))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SkipChainCRF | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans`` of each row; ``n_secret`` and ``n_spans``
    count all spans of that kind and of any."""
    model = model or train(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows([batch]):
                bases = [base_spans(t) for t in texts]
                more = model.added(texts, bases)
                n = [pa.array([sum(x[1] == k for x in b) for b in bases], pa.int64()) for k in BASE_KINDS]
                full = [sorted(b + m, key=lambda x: (x[0], RANK[x[1]], x[2])) for b, m in zip(bases, more)]
                sums = [pa.array([sum(x[1] == "secret" for x in f) for f in full], pa.int64()), pa.array(map(len, full), pa.int64())]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *n, sha, pa.array(map(joined, full), pa.string()), *sums], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SkipChainCRF | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    model = model or train(docs, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]  # any name may stand in the rows
    at, plain = docs.columns.index(text_col), docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            index = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["i", "t"])
            for _, texts in rows([index]):
                bases = [base_spans(t) for t in texts]
                for text, b, m in zip(texts, bases, model.added(texts, bases)):
                    parts, done = [], 0
                    for s, k, e in sorted(b + m, key=lambda x: (x[0], RANK[x[1]], x[2])):
                        if s >= done:
                            parts += [text[done:s], f"[{k.upper()}]"]
                        done = max(done, e)
                    out.append("".join([*parts, text[done:]]))
            nulls = batch.column(at).is_null().to_pylist()
            text = pa.array([None if n else t for n, t in zip(nulls, out)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
