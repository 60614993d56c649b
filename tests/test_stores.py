"""Keyed tables under concurrent writers, and journaled changes that are killed after every step."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest as N
from tessera.sources import journal as J
from tessera.sources.versions import Conflict, KeyedTable, Versions

def now():
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


def frame(spark, rows, schema="k string, v int"):
    return spark.createDataFrame(rows, schema)


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_versions_are_taken_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.newest() == 0 and v.read() == {}
    assert v.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        v.commit(0, {"a": 2})
    assert v.update(lambda s: {"a": s["a"] + 1}) == 2 and v.read() == {"a": 2} and v.read(1) == {"a": 1}
    assert v.update(lambda s: None) == 2


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v int")
    assert t.count() == 0 and t.upsert(frame(spark, [])) == 0
    t.upsert(frame(spark, [(f"k{i}", i) for i in range(40)] + [(None, -1), (None, -2)]))
    before = t.state()["folders"]
    v = t.upsert(frame(spark, [("k7", 70), ("k7", 71)]))
    after = t.state()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 10
    assert {r.v for r in t.read().where("k = 'k7'").collect()} == {70, 71} and t.count() == 43
    t.delete(frame(spark, [("k8",), ("none",), (None,)], "k string"))
    assert t.count() == 40 and t.read(v).count() == 43
    t.replace(frame(spark, [("x", 1)]))
    assert content(t) == [("x", 1)]
    assert t.vacuum(1, 0) > 0 and content(t) == [("x", 1)]


@pytest.mark.parametrize("same", [False, True])
def test_concurrent_upserts_both_land(spark, tmp_path, same):
    """Two writers start from one version; of other buckets both land, of the same key the second does its change again."""
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v int")
    t.upsert(frame(spark, [("a", 0), ("b", 0), ("c", 0)]))
    meet, writes = threading.Barrier(2), []

    class Slow(KeyedTable):
        def _write(self, rows, n, size):
            out = super()._write(rows, n, size)
            writes.append(self.name)
            if writes.count(self.name) == 1:
                meet.wait(60)  # both have written on the same base before either commits
            return out

    def run(name, key):
        table = Slow(spark, str(tmp_path / "t"), "k string, v int")
        table.name = name
        table.upsert(frame(spark, [(key, name)]))

    threads = [threading.Thread(target=run, args=(i + 1, "a" if same else k)) for i, k in enumerate("ab")]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    got = content(t)
    if same:
        assert len(writes) == 3 and got in ([("a", 1), ("b", 0), ("c", 0)], [("a", 2), ("b", 0), ("c", 0)])
    else:
        assert len(writes) == 2 and got == [("a", 1), ("b", 2), ("c", 0)]


class Killed(Exception):
    pass


def page(name, body, sources="[]", kind="concept", related="[]"):
    return (f"wiki/{name}.md", f"---\ntype: {kind}\ntitle: {name}\nsources: {sources}\nrelated: {related}\n---\n\n{body}")


PAGES = [page("a", "see [[b]] and [[c|text]]", '["x.pdf"]'), page("b", "the same as a", '["y.pdf", "x.pdf"]', related='["a"]'), page("c", "links to [[b|bee]]", '["z.pdf"]', related='["b", "a"]'), ("wiki/index.md", "# Index\n- [[a]]: one\n- [[b]]: two\n- [[c]]: three\n")]


def tables(spark, root):
    out = {"pages": KeyedTable(spark, f"{root}/pages", J.PAGES), "history": KeyedTable(spark, f"{root}/history", J.HISTORY), "vectors": KeyedTable(spark, f"{root}/vectors", "page_id string, v int"), "cache": KeyedTable(spark, f"{root}/cache", "name string")}
    out["pages"].upsert(spark.createDataFrame(PAGES, J.PAGES))
    out["vectors"].upsert(frame(spark, [(k, 1) for k in "abc"], "page_id string, v int"))
    out["cache"].upsert(frame(spark, [("x.pdf",), ("z.pdf",)], "name string"))
    return out


def merge(j):
    merges = j.spark.createDataFrame([(1, "a", ["a", "b"], "---\ntype: concept\ntitle: a\nsources: []\n---\n\nboth")], "group_id int, canonical string, slugs array<string>, merged string")
    J.execute_merges(j, merges, "2024-01-01", now())


CHANGES = {"merge": merge, "deletion": lambda j: J.execute_deletion(j, j.spark.createDataFrame([("wiki/b.md",)], "path string"), now()), "source": lambda j: J.execute_source_deletion(j, j.spark.createDataFrame([("z.pdf",)], "source string"), "2024-01-01", now())}


@pytest.mark.parametrize("kind", CHANGES)
def test_a_change_survives_a_crash_after_each_step(spark, tmp_path, monkeypatch, kind):
    clean = tables(spark, tmp_path / "clean")
    CHANGES[kind](J.Journal(spark, str(tmp_path / "clean/journal"), clean))
    want = {n: content(t) for n, t in clean.items()}
    assert want["pages"] != sorted(PAGES) and len(want["history"]) >= 2
    for when in ("before", "after"):
        for at in (0, 3) if kind == "merge" else (1,):
            root = tmp_path / f"{when}{at}"
            mine = tables(spark, root)
            j = J.Journal(spark, str(root / "journal"), mine)
            record = j._record

            def killed(name, done):
                if done == at + 1:
                    if when == "after":
                        record(name, done)
                    raise Killed
                record(name, done)

            monkeypatch.setattr(j, "_record", killed)
            with pytest.raises(Killed):
                CHANGES[kind](j)
            again = J.Journal(spark, str(root / "journal"), mine)
            assert [c["done"] for c in again.waiting()] == [at + (when == "after")]
            assert len(again.apply()) == 1 and again.waiting() == [] and again.apply() == []
            assert {n: content(t) for n, t in mine.items()} == want, (when, at)


def test_what_a_merge_leaves(spark, tmp_path):
    mine = tables(spark, tmp_path)
    merge(J.Journal(spark, str(tmp_path / "journal"), mine))
    pages = dict(content(mine["pages"]))
    assert set(pages) == {"wiki/a.md", "wiki/c.md", "wiki/index.md"} and "[[b" not in "".join(pages.values())
    assert "y.pdf" in pages["wiki/a.md"] and "updated: 2024-01-01" in pages["wiki/a.md"] and "[[a|bee]]" in pages["wiki/c.md"]
    assert "two" not in pages["wiki/index.md"] and "three" in pages["wiki/index.md"]
    assert {p for p, _ in content(mine["vectors"])} == {"a", "c"}
    assert {t for _, t in content(mine["history"])} == {t for p, t in PAGES}


def test_a_change_is_worked_out_again_when_a_page_moves_on(spark, tmp_path, monkeypatch):
    mine = tables(spark, tmp_path)
    j = J.Journal(spark, str(tmp_path / "journal"), mine)
    plan, ran = N.merge_duplicates, []

    def moved(*x):
        out = plan(*x)
        if not ran:
            mine["pages"].upsert(spark.createDataFrame([page("d", "new, and names [[b]]")], J.PAGES))
        ran.append(1)
        return out

    monkeypatch.setattr(N, "merge_duplicates", moved)
    merge(j)
    assert len(ran) == 2 and "[[a]]" in dict(content(mine["pages"]))["wiki/d.md"]


def test_nothing_is_recorded_before_all_is_staged(spark, tmp_path):
    mine = tables(spark, tmp_path)
    j = J.Journal(spark, str(tmp_path / "journal"), mine)
    bad = mine["pages"].read().select(F.raise_error(F.lit("stopped")).alias("path"))
    with pytest.raises(Exception, match="stopped"):
        j.begin("odd", [("pages", "delete", mine["pages"].read().select("path")), ("pages", "delete", bad)])
    assert j.waiting() == [] and j.apply() == [] and content(mine["pages"]) == sorted(PAGES)
