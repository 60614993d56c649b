"""The posting index against the scan of all pages, and against SQL for every user turn."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import text_index as T
from tessera.plans import SQL
from tessera.plans.corpus import document_pages
from tessera.session import shared_dir

PAGES = [
    ("wiki/attention.md", "attention.md", "# Attention\nAttention weighs tokens. attention, attention!\nAAAA aa"),
    ("wiki/cache.md", "kv-cache.md", "---\ntitle: The KV cache\n---\nkeys and values; ATTENTION again\nan"),
    ("wiki/han.md", "han.md", "注意力机制是什么，默会知识"),
    ("wiki/empty.md", "empty.md", ""),
    ("wiki/none.md", "none.md", None),
    ("wiki/twice.md", "twice.md", "some words stand here 😀 and there"),
    ("wiki/twice.md", "twice.md", "some other words 😀😀"),
    ("wiki/long.md", "long.md", "ab " * 3000 + "needle-in-hay" + " xyz" * 100),
    (None, None, "a page without a name"),
]
ASKED = ["attention", "Attention!", "the KV cache", "aa", "a", "注意力机制", "什么是 attention", "的 是", "", "  ", "needle-in-hay xyz", "😀 words", "twice", "İstanbul", "an.", "zz top", "a page without a name", "ab ab ab"]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(PAGES, "path string, file_name string, content string").repartition(3)
    return T.TextIndex.build(shared_dir(spark, "text"), df)


def test_answers_are_those_of_the_scan(spark, index):
    pages = spark.createDataFrame(PAGES, "path string, file_name string, content string")
    asked = spark.createDataFrame([*enumerate(ASKED), (99, None)], "qid int, text string")
    got = {}
    for r in index.search(asked).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.path, r.title, r.title_match, r.score, r.snippet))
    for i, q in enumerate(ASKED):
        want = sorted(((r.path, r.title, r.title_match, r.score, r.snippet) for r in R.score_pages(pages, q).collect()), key=lambda r: (-r[3], r[0] or "", r[1:]))
        have = [r[1:] for r in sorted(got.get(i, []), key=lambda r: r[0])]
        assert sorted(have, key=lambda r: (-r[3], r[0] or "", r[1:])) == want, q
        assert [r[0] for r in sorted(got.get(i, []))] == list(range(1, len(want) + 1))
    assert 99 not in got


def test_every_user_turn_and_small_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(T, "PART_QUESTIONS", 10)
    index = T.TextIndex.build(shared_dir(spark, "text"), document_pages(spark, sf), 40_000)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    got = sorted(map(tuple, index.search(turns).select("qid", "rank", "path", "title", "title_match", "score", "snippet").collect()))
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = SQL["search_questions"].replace("AND conv_id % 100 = 0", "")
    assert got == sorted(con.execute(f"SELECT qid, rank, path, title, title_match, score, snippet FROM ({sql})").fetchall())
    assert index.pages.select("shard").distinct().count() > 3


def test_columns_read_shrink_with_the_needles(spark, index, monkeypatch):
    asked, shards = [], index.shards
    monkeypatch.setattr(index, "shards", lambda buckets=None: asked.append(buckets) or shards(buckets))

    def columns(q):
        got = index.search(spark.createDataFrame([(1, q)], "qid int, text string")).orderBy("rank")
        return len(asked.pop()), [r.path for r in got.collect()], got._jdf.queryExecution().executedPlan().toString()

    few, found, plan = columns("xyz")
    many, _, _ = columns("attention weighs tokens, keys and values")
    assert found == ["wiki/long.md"] and 1 <= few < many < T.BUCKETS and columns("a.b c")[0] <= T.BUCKETS
    held = {c for c in T.COLUMNS if f"{c}:binary" in plan}
    assert len(held) <= few  # of the postings, the scan reads those columns alone


def test_empty_index_and_no_questions(spark, index):
    none = spark.createDataFrame([], "qid int, text string")
    assert index.search(none).collect() == []
    empty = T.TextIndex.build(shared_dir(spark, "text"), spark.createDataFrame([], "path string, file_name string, content string"))
    assert empty.search(spark.createDataFrame([(1, "a word")], "qid int, text string")).collect() == []


def test_postings_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for letters in ("ab", "abcdefgh é😀", [chr(c) for c in range(0x4E00, 0x8E00)]):
        texts = ["".join(rng.choice(list(letters), n)) for n in (0, 1, 2, 3, 400, 70_000)]
        runs, first, places, starts = T.inverted(texts)
        assert len(places) == sum(map(len, texts)) and starts[0] == 0 and (np.diff(runs) > 0).all()
        got = {}
        for data in T.bucketed(runs, first, places):
            for some, ends, steps in T.opened(data):
                got |= {int(r): np.cumsum(steps[a:b], dtype=np.int64) for r, a, b in zip(some, ends, ends[1:])}
        last = [*first[1:], len(places)]
        assert len(got) == len(runs) and all((got[int(r)] == places[a:b]).all() and (np.diff(places[a:b]) > 0).all() for r, a, b in zip(runs, first, last))
    assert [len(x) > 0 for x in T.bucketed(*T.inverted([])[:3])] == [True] * T.BUCKETS


def test_lists_are_fused_for_each_query(spark):
    a = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, "q", 1)], "query_id int, path string, rank int")
    b = spark.createDataFrame([(1, "q", 1), (2, "r", 1), (3, "p", 1)], "query_id int, path string, rank int")
    got = {(r.query_id, r.path): (r.lexical_rank, r.vector_rank, round(r.rrf, 9)) for r in R.fuse(a, b, "path", n=2, by="query_id").collect()}
    one, both = round(1 / 61, 9), round(1 / 62 + 1 / 61, 9)
    assert got == {(1, "q"): (2, 1, both), (1, "p"): (1, None, one), (2, "q"): (1, None, one), (2, "r"): (None, 1, one), (3, "p"): (None, 1, one)}
