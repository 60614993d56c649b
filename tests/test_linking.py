"""Links to titles against brute force."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import linking as K


def brute(text, terms):
    """All places by search, then from the left, the longest first."""
    found = []
    closed = [m.span() for m in K.CLOSED.finditer(text)]
    for term, target in terms.items():
        at = text.find(term)
        while at >= 0:
            end = at + len(term)
            before, after = text[at - 1 : at] if at else "", text[end : end + 1]
            glued = (before.isalnum() and term[0].isalnum() and max(before, term[0]) < "⺀") or (after.isalnum() and term[-1].isalnum() and max(after, term[-1]) < "⺀")
            if not glued and all(end <= a or at >= b for a, b in closed):
                found.append((at, end, target))
            at = text.find(term, at + 1)
    out, free = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if f[0] >= free:
            out.append(f)
            free = f[1]
    return out


def titles_of(spark, sf):
    t = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("target"))
    words = spark.createDataFrame([("the and", "w1"), ("and", "short"), ("tion", "w2"), ("thation", "w3"), ("  the and  ", "w0"), (None, "x"), ("none", None)], "title string, target string")
    return t.union(words)


@pytest.mark.parametrize("part_chars", [K.PART_CHARS, 2000])
def test_titles_in_whole_documents(spark, sf, part_chars):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    titles = titles_of(spark, sf)
    terms = {}
    for r in titles.collect():
        term = (r.title or "").strip(" ")
        if r.target and len(term) >= K.SHORTEST:
            terms[term] = min(terms.get(term, r.target), r.target)
    got = {r.doc_id: [tuple(p) for p in r.places] for r in K.title_matches(docs, titles, part_chars).collect()}
    want = {r.doc_id: brute(r.content or "", terms) for r in docs.collect()}
    assert got == want and sum(map(len, want.values())) > 50 and {"w0"} <= {t for p in want.values() for _, _, t in p}


def test_links_are_made_once_and_not_in_closed_places(spark):
    titles = spark.createDataFrame([("Rope", "rope"), ("Rope scaling", "rope-scaling"), ("KV cache", "kv-cache"), ("注意力机制", "attention"), ("self", "me")], "title string, target string")
    texts = [
        ("---\ntitle: Rope\n---\nRope scaling and Rope, Rope. Ropes KV cache", "---\ntitle: Rope\n---\n[[rope-scaling|Rope scaling]] and [[Rope]], Rope. Ropes [[kv-cache|KV cache]]"),
        ("[[rope|x]] then Rope and `KV cache` [KV cache](u) KV cache", "[[rope|x]] then Rope and `KV cache` [KV cache](u) [[kv-cache|KV cache]]"),
        ("```\nRope\n``` https://x.org/Rope Rope", "```\nRope\n``` https://x.org/Rope [[Rope]]"),
        ("这是注意力机制的文章", "这是[[attention|注意力机制]]的文章"), ("self is me", "self is me"), ("", ""), (None, None),
    ]
    pages = spark.createDataFrame([(i, t, "me") for i, (t, _) in enumerate(texts)], "i int, content string, places string")
    for part_chars in (K.PART_CHARS, 10):
        got = K.linked(pages.drop("places"), titles, part_chars=part_chars).orderBy("i").collect()
        assert [r.content for r in got][:4] == [w for _, w in texts][:4]
        own = K.linked(pages.drop("places").withColumn("name", F.lit("me")), titles, "name", part_chars).orderBy("i").collect()
        assert [r.content for r in own] == [w for _, w in texts]
    none = titles.limit(0)
    assert [r.content for r in K.linked(pages.drop("places"), none).orderBy("i").collect()] == [t for t, _ in texts]


def test_texts_are_not_shuffled(spark, sf):
    """Documents get their links and the number of places in one pass, where they lie."""
    from tessera.plans import QUERIES

    df = QUERIES["linked_titles"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_many_titles_leave_texts_where_they_lie(spark):
    """Where titles are more than one part, those that stand somewhere are found first; texts are shuffled only if these are more as well."""
    titles = spark.range(400).select(F.concat(F.lit("Title number "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target"))
    texts = ["see Title number 7, Title number 71 and Title number 399", "Title number 4000 `Title number 8`", "", None] * 3
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    want = sorted(tuple(r) for r in K.linked(pages, titles, count="n").collect())
    assert want[0] == (0, "see [[t7|Title number 7]], [[t71|Title number 71]] and [[t399|Title number 399]]", 3) and [w[2] for w in want[1:4]] == [0, 0, 0]
    for part_chars, joins in ((200, False), (20, True)):
        df = K.linked(pages, titles, part_chars=part_chars, count="n")
        assert ("Join" in df._jdf.queryExecution().optimizedPlan().toString()) == joins
        assert sorted(tuple(r) for r in df.collect()) == want


def odd_texts_and_titles():
    """Texts of few letters, scripts and gaps, copies, and titles of 4 to 70 characters cut out of them or not; with the titles' targets."""
    import random

    rnd = random.Random(4)
    draw = lambda n: "".join(rnd.choice("ab  -é注意😀") for _ in range(n))
    texts = [draw(rnd.randint(0, 300)) for _ in range(60)]
    texts += [None, "", "ab", "x" * 40 + " tail", "head", "tail", *texts[:20], "".join(texts)]
    titles = {texts[rnd.randrange(60)][i : i + rnd.randint(4, 70)] for i in range(0, 200, 3)} | {draw(4) for _ in range(300)} | {"tailhead", "headtail", "x" * 40}
    rows = [(t, f"t{i}") for i, t in enumerate(sorted(titles))]
    terms = {}
    for t, target in rows:
        if len(t.strip(" ")) >= K.SHORTEST:
            terms[t.strip(" ")] = min(terms.get(t.strip(" "), target), target)
    return texts, rows, terms


@pytest.mark.parametrize("mark_bits", [K.MARK_BITS, 1 << 8])
def test_titles_of_all_lengths_and_scripts(spark, monkeypatch, mark_bits):
    """On each path; a table that lets nearly all pass changes nothing."""
    monkeypatch.setattr(K, "MARK_BITS", mark_bits)
    texts, rows, terms = odd_texts_and_titles()
    pages, titles = spark.createDataFrame(list(enumerate(texts)), "i int, content string"), spark.createDataFrame(rows, "title string, target string")
    want = {i: brute(t or "", terms) for i, t in enumerate(texts)}
    for part_chars in (K.PART_CHARS, K._chars(K._terms(titles)) - 1, 50):
        got = {r.i: [tuple(p) for p in r.places] for r in K.title_matches(pages, titles, part_chars).collect()}
        assert got == want and sum(map(len, want.values())) > 100


def test_long_texts_are_read_by_windows(monkeypatch):
    import numpy as np

    texts, _, terms = odd_texts_and_titles()
    lengths = sorted(map(len, terms))

    def found():
        table = np.zeros(1 << 10, np.uint64)
        for words, marks in K._marks(list(terms), 1 << 16):
            np.bitwise_or.at(table, words, marks)
        return {(i, s, e) for i, f in K.standing(texts, table, sorted(set(lengths))) for s, e in f if texts[i][s:e] in terms}

    whole = found()
    monkeypatch.setattr(K, "AT_ONCE", 7)
    assert found() == whole and len(whole) > 500
