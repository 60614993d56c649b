"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; a line's potential comes from its own features and those of its neighbours, and adjacent
lines share a transition potential. The document's quality is the mean of the lines' marginal probabilities of being
good (forward-backward), weighted by line length, then mapped by a logistic curve fitted on the training documents.

Only documents have labels, so the labels of training lines are hidden: a document's label pulls each of its lines by
``COUPLING`` times the line's share of the length, and the fit raises the probability of the documents' labels with the
lines summed out (two forward-backward passes, one for each label). A bad document may hold good lines, and chains switch
where features say so. The sample is bounded by ``MAX_TRAIN_DOCS`` labelled documents (the least hashes of their ids) of
at most ``MAX_TRAIN_LINES`` lines, a documented limit of the fit; scoring reads every line of every text.

Lines are \\n-split lines with a word; null, empty and blank texts have none and score 0. Labels that are null, that
repeat with both values, or that belong to no document are passed over; an id that repeats is learnt from once (the row
of the least hash of id and text). Without labels of both kinds every document with a line scores the share of good
labels (0.5 without any). Rows are scored one by one; ids are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_key, rows

MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 3000, 2000
HELD_OUT_OF = 5
CUT = 0.3
STEPS, RATE, L2, COUPLING = 250, 0.1, 1e-3, 8.0

#: Features that neighbours pass on as well.
SHARED = ("symbols", "upper", "bangs", "bars", "distinct", "repeats", "again")
OWN = ("log_words", "word_length", "ends", "capital", "digits", "short", *SHARED)
N_FEATURES = 1 + len(OWN) + 2 * len(SHARED) + 2

_word = re.compile(r"[^\x20\x09-\x0D]")
_symbols, _digits, _ends = "#*$%&<>", "0123456789", (".", "!", "?", ":", ";", '"')


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of features and one length for each line with a word."""
    lines = [x for x in text.split("\n") if _word.search(x)]
    if not lines:
        return np.empty((0, N_FEATURES), np.float32), np.empty(0, np.float32)
    seen = Counter(lines) if len(lines) > 1 else {}
    own = []
    for x in lines:
        words = x.split()
        n, size = max(1, len(words)), len(x)
        short = sum(len(w) < 4 for w in words)
        own.append(
            (
                np.log1p(n),
                size / n / 10,
                x.rstrip().endswith(_ends),
                x.lstrip()[:1].isupper(),
                sum(map(x.count, _digits)) / size,
                short / n,
                sum(map(x.count, _symbols)) / n,
                sum(map(str.isupper, words)) / n,
                x.count("!!") / n,
                x.count("|") / n,
                len(set(words)) / n,
                sum(map(eq, words, words[1:])) / n,
                seen.get(x, 1) > 1,
            )
        )
    own = np.array(own, np.float32)
    shared = own[:, -len(SHARED) :]
    edge = np.zeros((1, len(SHARED)), np.float32)
    first, last = np.zeros((2, len(own), 1), np.float32)
    first[0], last[-1] = 1, 1
    out = [np.ones((len(own), 1), np.float32), own, np.concatenate([edge, shared[:-1]]), np.concatenate([shared[1:], edge]), first, last]
    return np.concatenate(out, 1), np.array([len(x) for x in lines], np.float32)


def _ordered(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length, where each starts, and how many have a line at each step."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left") if len(sizes) else np.empty(0, int)
    return order, starts, alive


def _pass(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next line's good state from the log-odds ``x`` of this one; ``t[i, j]``: potential of i then j."""
    return np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])


def forward_backward(u: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of each line: forward (own potential included), backward, marginal. Chains run side by side."""
    _, starts, alive = _ordered(sizes)
    a, b = u.copy(), np.zeros_like(u)
    for k in range(1, len(alive)):
        i = starts[: alive[k]] + k
        a[i] += _pass(a[i - 1], t)
    for k in range(len(alive) - 1, 0, -1):
        i = starts[: alive[k]] + k
        b[i - 1] = _pass(u[i] + b[i], t.T)
    return a, b, a + b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chain_sums(u: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-partition of each chain, marginal of each line, and the four marginals of each pair of adjacent lines."""
    a, b, odds = forward_backward(u, sizes, t)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(u), bool)
    inner[last] = False
    here = np.flatnonzero(inner)
    grown = np.zeros(len(u))
    grown[here] = np.logaddexp(t[0, 0], a[here] + t[1, 0])  # what the bad state's sum grows by at each step
    logz = np.add.reduceat(grown, last + 1 - sizes) + np.logaddexp(0, a[last])
    left, right = a[here], u[here + 1] + b[here + 1]
    joint = np.stack([np.full(len(here), t[0, 0]), right + t[0, 1], left + t[1, 0], left + right + t[1, 1]])
    joint = np.exp(joint - joint.max(0, initial=-np.inf))
    return logz, _sigmoid(odds), joint / joint.sum(0)


@dataclass
class LineCRF:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> LineCRF:
        """``docs``: features, line lengths and label of each training document."""
        docs = [d for d in docs if len(d[0])]
        good = sum(d[2] for d in docs)
        if not 0 < good < len(docs):
            p = (good + 1) / (len(docs) + 2)
            return cls(scale=0.0, shift=float(np.log(p / (1 - p))))
        x = np.concatenate([d[0] for d in docs]).astype(np.float64)
        sizes = np.array([len(d[0]) for d in docs])
        y = np.array([d[2] for d in docs], float)
        pull = COUPLING * np.concatenate([d[1] / d[1].sum() for d in docs])
        doc = np.repeat(np.arange(len(docs)), sizes)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(sizes) - 1] = False
        pair_doc = doc[inner]
        params, m, v = np.zeros(N_FEATURES + 5), 0.0, 0.0
        for step in range(1, STEPS + 1):
            w, t, bias = params[:N_FEATURES], params[N_FEATURES:-1].reshape(2, 2), params[-1]
            u = x @ w
            (z0, m0, j0), (z1, m1, j1) = (chain_sums(u + sign * pull, sizes, t) for sign in (-1, 1))
            r = y - _sigmoid(z1 - z0 - COUPLING + bias)  # lines that are bad agree with a bad document
            grad = np.concatenate([x.T @ (r[doc] * (m1 - m0)), (r[pair_doc] * (j1 - j0)).sum(1), [r.sum()]]) / len(docs) - L2 * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = cls(params[:N_FEATURES], params[N_FEATURES:-1].reshape(2, 2))
        model._calibrate(model.raw([d[0] for d in docs], [d[1] for d in docs]), y)
        return model

    def lines(self, text: str) -> list[tuple[str, float]]:
        """The lines of a text that have a word, each with its marginal probability of being good."""
        f, _ = line_features(text)
        odds = forward_backward(f @ self.weights, np.array([len(f)]), self.transitions)[2] if len(f) else np.empty(0)
        return list(zip([x for x in text.split("\n") if _word.search(x)], _sigmoid(odds).tolist(), strict=True))

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        z, s, c = np.log(raw / (1 - raw)), 1.0, 0.0
        for _ in range(50):  # Newton steps of a ridge logistic curve
            p = _sigmoid(s * z + c)
            h = p * (1 - p) + 1e-6
            grad = np.array([((y - p) * z).sum() - 0.01 * (s - 1), (y - p).sum()])
            hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
            ds, dc = np.linalg.solve(hess, grad)
            s, c = s + float(np.clip(ds, -1, 1)), c + float(np.clip(dc, -1, 1))
        self.scale, self.shift = (s, c) if s > 0 else (1.0, 0.0)

    def raw(self, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean marginal of each document, inside (0, 1); documents must have lines."""
        sizes = np.array([len(f) for f in features])
        _, _, odds = forward_backward(np.concatenate(features) @ self.weights, sizes, self.transitions)
        length = np.concatenate(lengths).astype(np.float64)
        at = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(_sigmoid(odds) * length, at) / np.add.reduceat(length, at)
        return np.clip(mean, 1e-9, 1 - 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        each = [line_features(t) for t in texts]
        has = np.array([len(f) > 0 for f, _ in each], bool)
        out = np.zeros(len(texts))
        if has.any():
            raw = self.raw([f for f, _ in each if len(f)], [n for f, n in each if len(f)])
            out[has] = _sigmoid(self.scale * np.log(raw / (1 - raw)) + self.shift)
        return out


def held_out(id_: Column) -> Column:
    """Rows never learnt from: crc32 of the id's text is divisible by five. A null id is held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % HELD_OUT_OF == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> LineCRF:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_lines`` lines; their features (not texts) come to
    the driver, one row for each id, so what it gets is bounded."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("rk").alias("rk"))  # a row for each id of the sample
    chosen = texts.drop("id").join(F.broadcast(one), "rk").select("rk", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [line_features(t.as_py() or "") for t in batch.column(2)]
            fits = [len(n) <= max_lines for _, n in each]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() if ok else None for (f, _), ok in zip(each, fits)], pa.binary()), pa.array([n.tobytes() for _, n in each], pa.binary())], names=["rk", "y", "f", "n"])
            yield out.filter(pa.array(fits, pa.bool_()))

    got = chosen.mapInArrow(run, "rk binary, y int, f binary, n binary").dropDuplicates(["rk"]).collect()
    got = sorted(got, key=lambda r: bytes(r.rk))
    return LineCRF.fit([(np.frombuffer(r.f, np.float32).reshape(-1, N_FEATURES), np.frombuffer(r.n, np.float32), r.y) for r in got])


def score(docs: DataFrame, model: LineCRF, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows([batch]):
                s = model.scores(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[id_col, "score", "predicted"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, predicted int")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
