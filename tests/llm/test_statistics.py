"""Divergence of sources, order MinHash and whitening against SQL, brute force and exact fractions."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import divergence, order_minhash, whitening
from tessera.llm.queries import oracle_sql, queries

ODD = [(1, None, None, "h"), (None, "some text without an id", "en", None), (None, None, None, None), (2, "", "en", "h"), (3, " \n\t ", "en", "h"), (4, "Long words " * 3000, "en", "h"), (4, "Long words " * 3000, "en", "h"), (5, "Long words " * 3000, "de", "i"), (6, "x", "en", "h"), (7, "é" * 30000, "fr", "h"), (8, "a\x00b\nc", "en", "h")]
CLASHES = ("n", "v", "g", "a", "b", "k", "block", "term", "value", "rank", "id", "slots", "next_text", "w", "deviation", "lang_", "th", "u")


def odd_documents(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def divergence_sql(spark, table):
    con = duckdb.connect()
    documents = table.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con.register("documents", documents)
    return sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({oracle_sql()['op11_source_divergence']})").fetchall(), key=repr)


@pytest.mark.parametrize("blocks", [(4096, 256), (3, 2), (1, 1)])
def test_divergence_is_that_of_the_sql(spark, blocks):
    rng = random.Random(1)
    words = [f"w{a}{b}" for a in "abcdeé" for b in "xyzß"]
    data = [(i, " ".join(rng.choices(words, [1 / (k + 1 + i % 5) for k in range(len(words))], k=rng.randrange(30))), rng.choice(["en", "de", None]), f"s{rng.randrange(7)}") for i in range(120)]
    docs = spark.createDataFrame(data + [(900, None, "xx", "only"), (901, "1 2 3", "xx", None), (902, "a b", "en", "bare"), (0, "", "en", "")], "doc_id long, text string, lang string, source string")
    got = divergence.source_divergence(docs, block_terms=blocks[0], block_groups=blocks[1])
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(got) == divergence_sql(spark, docs) and got.where("lang = 'xx'").select("value").distinct().collect() == [(0,)]


def test_divergence_of_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    assert rows(divergence.source_divergence(odd, min_docs=3)) == divergence_sql(spark, odd)
    assert divergence.source_divergence(odd.limit(0)).collect() == []


def test_shares_and_sums_are_exact_for_large_counts():
    rng = random.Random(2)
    counts = [rng.randrange(10 ** rng.randrange(1, 13)) for _ in range(2000)]
    total = sum(counts)
    got = divergence.shares(np.array(counts), np.int64(total))
    assert got.tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
    p = np.array([[1, 10**9 + 1, 5], [10**9, 1, 2]])
    assert divergence.pair_sums(p, p).tolist() == [[sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(a, b)) for b in p] for a in p]


def test_divergence_keeps_a_limit_of_terms_and_breaks_ties_by_name(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{s}{'abcdefghij'[k]}" for k in range(10)), "en", s) for s in "pq" for i in range(3)], "doc_id long, text string, lang string, source string")
    got = divergence.source_divergence(docs, top=4, block_terms=3).where("part = 'term' AND source = 'p'").orderBy("rank").collect()
    assert [(r.item, r["rank"]) for r in got] == [(f"p{c}", i + 1) for i, c in enumerate("abcd")]


BITS = (1 << 64) - 1


def spark_hash(*xs):
    seed = 42
    for x in xs:
        seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else (x & BITS).to_bytes(8, "little"), seed)
    return seed


def brute_slots(text):
    """The definition, point by point."""
    words = [w.encode() for w in re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text or "")]
    grams = [spark_hash(*words[i : i + 2]) for i in range(len(words))]
    seen, circle = {}, []
    for i, g in enumerate(grams):
        k = g >> 28
        seen[k] = seen.get(k, -1) + 1
        circle.append((((spark_hash(k, seen[k]) >> 28) + (1 << 35)) % (1 << 36), i))
    circle.sort()
    out = []
    for j in range(64):
        if not circle:
            out.append(0)
            continue
        a = next((k for k, (x, _) in enumerate(circle) if x >= j << 30), 0)
        first, second = sorted((circle[a][1], circle[(a + 1) % len(circle)][1]))
        out.append(spark_hash(grams[first], grams[second]) & 0xFFFF)
    return out


def brute_edits(data):
    """Rows of (id, text), by falling id and rising hash of the text, nulls last."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    data = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] is not None, r[0] or 0, signed(spark_hash(r[1].encode()))), reverse=True)
    values, out = [brute_slots(t) for _, t in data], []
    for k, (i, t) in enumerate(data):
        nxt = (k + 1) % len(data)
        m = len(t) // 3
        edited = t[: len(t) - m] + data[nxt][1][:m]
        e = brute_slots(edited)
        hexed = ["".join(f"{x:04x}" for x in v) for v in (values[k], e)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexed, sum(x == y for x, y in zip(values[k], e)) / 64, sum(x == y for x, y in zip(values[k], values[nxt])) / 64))
    return sorted(out, key=repr)


def test_fingerprints_are_those_of_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries()["op12_order_minhash"](spark, sf)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert rows(got) == brute_edits([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_of_odd_rows(spark):
    odd = odd_documents(spark)
    assert rows(order_minhash.edited_fingerprints(odd)) == brute_edits([r[:2] for r in ODD])
    assert order_minhash.edited_fingerprints(odd.limit(0)).collect() == []
    one = order_minhash.edited_fingerprints(odd.where("doc_id = 6")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)]
    assert len({r.fingerprint for r in order_minhash.fingerprints(odd).where("doc_id IN (1, 2, 3)").collect()}) == 1


def test_a_key_that_fills_whole_ranges_is_counted(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "COPIES", 7)
    data = [(i, f"text number {i} of a few") for i in range(40)] + [(17, "one row that comes very often")] * 400 + [(None, None)] * 300
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = order_minhash.edited_fingerprints(docs)
    assert "frequent-rows" in " ".join(got.inputFiles())
    assert rows(got) == brute_edits(data)


def test_likeness_falls_with_edits_and_with_moved_parts(spark):
    rng = random.Random(3)
    words = [f"word{rng.randrange(10**6)}" for _ in range(2000)]
    text = lambda ws: " ".join(ws)
    few, many = list(words), list(words)
    for i in rng.sample(range(2000), 20):
        few[i] = "other"
    for i in rng.sample(range(2000), 400):
        many[i] = "other"
    moved = words[1000:] + words[:1000]
    base, *others = (brute_slots(text(ws)) for ws in (words, few, many, moved, words[::-1]))
    near = [sum(a == b for a, b in zip(base, o)) / 64 for o in others]
    assert near[0] > 0.85 and near[0] > near[1] > 0.15 and near[2] < 0.75 and near[3] < 0.1


def exact_whitening(vectors):
    """Scatter in fractions, eigenvectors by numpy."""
    x = [[(int(c) * 1024 if abs(c) >= 2**53 else int(np.floor(c * 1024))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[float(sum((r[i] - Fraction(s[i], n)) * (r[j] - Fraction(s[j], n)) for r in x) / n) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    z = np.array([[float(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    return n, [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x], (z @ u[:, ::-1]) / np.sqrt(e[::-1]), e[::-1] / e.sum()


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12])
def test_whitening_is_exact(spark, scale):
    rng = np.random.default_rng(4)
    vectors = ((rng.normal(size=(150, 6)) * [5, 4, 3, 2, 1, 0.5] + 1) * scale).tolist()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, v int, w int").repartition(3)
    got = sorted(whitening.whiten(df).collect(), key=lambda r: r.vec_id)
    n, dev, white, share = exact_whitening(vectors)
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got] == dev
    assert np.allclose(np.abs([r.whitened for r in got]), np.abs(white), rtol=1e-6, atol=1e-9) and np.allclose(got[0].explained, share, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [0.0, 5.0], [0.0, 5.0]]
    bad = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(None if i == 2 else i, v) for i, v in enumerate(good + bad)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    n, dev, white, _ = exact_whitening(good)
    assert sorted((r.vec_id is None, r.n, int(r.deviation)) for r in got) == sorted((i == 2, n, x) for i, x in enumerate(dev))
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id > 3")).columns == whitening.whiten(df).columns
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {len(r.whitened) for r in whitening.whiten(line).collect()} == {1}


def test_products_and_limbs_are_exact():
    rng = np.random.default_rng(5)
    for most in (10, 1 << 24, 1 << 26, 1 << 40, 1 << 62):
        y = rng.integers(-most, most, size=(300, 4))
        want = y.astype(object).T.dot(y.astype(object))
        assert (whitening.products(y) == want).all()
    for v in (0, 1, -1, 1 << 31, -(1 << 32), 3**100, -(7**80)):
        assert sum(low << (32 * k) for k, low in whitening.limbs(v)) == v


def test_whitening_query(spark, sf):
    got = queries()["op13_whitening"](spark, sf)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.count() == 8 * n and got.agg(F.max("identity_error")).first()[0] < 1e-4
