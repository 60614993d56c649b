"""Folders, state, streams and guards that the queries do not reach."""

import json
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import markdown as M
from tessera.operators import ingest as N
from tessera.operators import records as S
from tessera.operators.graph import has_active_filters, numbered
from tessera.operators.hygiene import related_pages
from tessera.sources import files, projects, stores, web
from tessera.streaming import queues as Q


def test_projects_are_made_copied_and_known(spark, tmp_path):
    a, b = (projects.Folder(spark, str(tmp_path / n)) for n in "ab")
    made = projects.scaffold(a, "Ropes", "2024-01-01")
    assert set(made) == set(a.files()) and a.exists("raw/sources") and "Ropes" in a.read("wiki/overview.md")
    with pytest.raises(FileExistsError):
        projects.scaffold(a, "Ropes", "2024-01-01")
    one = projects.project_id(a)
    assert projects.project_id(a) == one and set(a.files(hidden=True)) == {*made, projects.IDENTITY}
    a.write(projects.IDENTITY, b"{broken")
    assert projects.project_id(a) != one
    assert a.copy_to(b) == sorted(made) and b.read("wiki/index.md") == a.read("wiki/index.md") and not b.exists(projects.IDENTITY)
    assert b.delete("wiki") and not b.exists("wiki/index.md")


def test_images_are_saved_and_found_again(spark, tmp_path):
    images = spark.createDataFrame([("rope", i, "png", bytes([i, 255])) for i in range(3)], "slug string, index int, ext string, content binary")
    saved = projects.saved_images(images)
    folder = projects.Folder(spark, str(tmp_path / "p"))
    assert projects.export(saved, folder) == 3 and (tmp_path / "p/wiki/media/rope/img-3.png").read_bytes() == b"\x02\xff"
    src = spark.createDataFrame([("raw/sources/z/rope.pdf",), ("raw/sources/rope.docx",), ("raw/sources/x.pdf",)], "path string")
    urls = spark.createDataFrame([("media/rope/img-1.png",), ("/abs/wiki/media/none/i.png",), ("x.png",)], "url string")
    assert {r.url: r.path for r in projects.source_of_image(urls, src).collect()} == {"media/rope/img-1.png": "raw/sources/rope.docx", "/abs/wiki/media/none/i.png": None, "x.png": None}
    read = files.read_files(spark, str(tmp_path / "p"), "*.png")
    assert {(r.base64, r.mime) for r in files.encoded(read).collect()} == {("AP8=", "image/png"), ("Af8=", "image/png"), ("Av8=", "image/png")}


def test_trees_lose_hidden_and_empty_folders(spark):
    listed = spark.createDataFrame([("a", True), ("a/x.md", False), ("b", True), ("b/c", True), (".git", True), (".git/y", False), ("d", True), ("d/.z", False)], "path string, is_dir boolean")
    assert {r.path for r in projects.tree_without_empty(listed).collect()} == {"a", "a/x.md"}


def test_json_state(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"conv_id": c, "turn": t} for c in (1, 2) for t in range(150)]))
    got = stores.read_state(spark, str(tmp_path / "s.json"), "conv_id long, turn long", 100, "conv_id", "turn")
    assert got.groupBy("conv_id").agg(F.min("turn").alias("m"), F.count("*").alias("n")).select("m", "n").distinct().collect() == [(50, 100)]


def test_clips_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"clip_id": i, "title": "A page", "url": "u", "text": "t", "day": "2024-01-01"}))
    out = Q.replay(Q.clip_stream(spark, str(tmp_path / "in")), lambda c: c, str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.path for r in web.clip_files(out).collect()} == {f"raw/sources/a-page-20240101{x}.md" for x in ("", "-2", "-3")}


def test_sweep_follows_a_drained_queue(spark):
    left = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert Q.sweep_due(left("done", "failed"), 2) and not Q.sweep_due(left("done"), 0) and not Q.sweep_due(left("done", "pending"), 2)


def test_results_are_kept_by_version(spark):
    made = []
    v = S.Versioned(lambda: (made.append(1), spark.range(len(made)))[1])
    assert v.get(1).count() == 1 and v.get(1).count() == 1 and len(made) == 1
    assert v.get(2).count() == 2 and len(made) == 2
    S.reset_project(spark, [v])
    assert v.kept is None and v.get(2).count() == 3


def test_filters_and_numbers(spark):
    assert has_active_filters() and not has_active_filters(hide_structural=False) and has_active_filters(hide_structural=False, max_links=3)
    got = numbered(spark.range(1000).repartition(7).withColumn("k", -F.col("id")), [F.col("k")], "n").collect()
    assert all(r.n == 999 - r.id for r in got)


def test_reembedding_replaces_one_page(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), 16)
    page = lambda i, text: spark.createDataFrame([(i, "T", text)], "page_id string, title string, content string")
    for i, text in (("a", "one"), ("b", "two"), ("a", "three words now")):
        stores.reembed(store, page(i, text), stores.hash_embedding(16))
    assert {(r.page_id, r.chunk_text) for r in store.read().collect()} == {("a", "three words now"), ("b", "two")}


def test_related_pages_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["a.pdf", "ab.pdf", "b.txt", "A.md", "c"]
    rows = []
    for i in range(120):
        path = f"wiki/{rng.choice(['sources', 'x'])}/{rng.choice(['a', 'ab', 'Abc', 'b', 'zz', 'c'])}{i}.md"
        head = f"---\nsources: [{', '.join(rng.sample(['a.pdf', 'A.PDF', 'ab.pdf', 'zz', 'C'], 2))}]\n---\n" if rng.random() < 0.5 else ""
        rows.append((path, head + rng.choice(['say "a.pdf" now', 'say "ab.pdf" and "c"', "a.pdf", '"b.txt', 'x"c"y"A.md"z'])))
    got = {(r.path, r.source) for r in related_pages(spark.createDataFrame(rows, "path string, content string"), spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    want = set()
    for path, text in rows:
        listed = [x.strip().lower() for x in re.findall(r"sources: \[(.*?)\]", text)[0].split(",")] if text.startswith("---") else []
        for n in names:
            stem = n.rsplit(".", 1)[0].lower()
            if f'"{n}"' in text or "/sources/" in path and path.rsplit("/", 1)[1].lower().startswith(stem) or n.lower() in listed:
                want.add((path, n))
    assert got == want


def test_main_content(spark):
    words = "Plain words, and more of them, fill this paragraph of the text. " * 3
    page = f"<body><div class='x'><p>{'<a href=u>link, link, link, link</a> ' * 9}</p></div><div id=m><h2>T</h2><p>{words}</p><p>{words}</p></div><nav><p>{words * 9}</p></nav><div><p>short</p></div></body>"
    assert web.to_markdown(page) == f"## T\n\n{words.strip()}\n\n{words.strip()}"
    assert web.to_markdown("<p>only this</p>") == "only this" and web.to_markdown("") == "" and web.to_markdown(None) is None
    assert web.to_markdown(f"<main><p>{words}{words}</p></main><div>{'<p>' + words * 9 + '</p>'}</div>") == (words + words).strip()


def test_references_end_with_a_semicolon():
    """Titles are cut at a length, in the middle of a reference too; DuckDB's replacements know whole ones alone."""
    assert web.to_markdown("<article><h1>a&amp;&amp</h1><p>x&amp y&lt;&copy;&ampx;&#65;&#66 &amp;</p></article>") == "# a&&amp\n\nx&amp y<©&ampx;A&#66 &"
    assert web.to_markdown('<p><a href="?a=1&copy=2&amp;b">t</a></p>') == "[t](?a=1&copy=2&b)"


def test_chunks_hold_every_part_of_a_text_once():
    """Sections, sizes and places of chunks against what they must be, for texts of all kinds."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9)))
    o = M.ChunkOptions().settled()
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            text = " ".join(word() + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 400)))
            parts.append(f"{'#' * rng.randrange(1, 4)} {word()}" if kind < 0.3 else f"```\n{text}\n# no heading\n```" if kind < 0.4 else text)
        content = "\n\n".join(parts)
        found, at, path, levels, fence = M.chunk_markdown(content), 0, {}, [], False
        for line in content.split("\n"):  # the headings in force at each place
            if line.startswith("```"):
                fence = not fence
            elif not fence and (m := re.match(r"(#+) (.*)", line)):
                path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): m[2]}
            levels += [" > ".join(f"{'#' * k} {v}" for k, v in sorted(path.items()))] * (len(line) + 1)
        assert [c["index"] for c in found] == list(range(len(found)))
        bare, marks = "", []  # the text without white space, and where its characters stand
        for i, ch in enumerate(content):
            if not ch.isspace():
                bare, marks = bare + ch, [*marks, i]
        for k, c in enumerate(found):
            assert c["char_end"] - c["char_start"] == len(c["text"]) and c["oversized"] == (len(c["text"]) > o.most)
            text, n = c["text"], marks[at] - c["char_start"] if at < len(marks) else 0
            # what stands before the next part of the text is repeated from the chunk before, or white space
            assert n >= 0 and (not text[:n].strip() or k and found[k - 1]["text"].endswith(text[:n]) and n <= o.overlap)
            text = text[n:]
            body = "".join(text.split())
            assert bare[at : at + len(body)] == body and (not body or levels[marks[at]] == c["heading_path"])
            at += len(body)
        assert at == len(bare)


def test_a_cluster_needs_a_shared_folder():
    code = """
import types
from tessera import session
class Context:
    applicationId, master = "x", "spark://host:7077"
    def getConf(self): return {}
    class _jsc:
        @staticmethod
        def sc():
            none = types.SimpleNamespace(isDefined=lambda: False)
            return types.SimpleNamespace(getCheckpointDir=lambda: none)
try:
    session.shared_dir(types.SimpleNamespace(sparkContext=Context()), "t")
except ValueError as e:
    print("refused", e)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True)
    assert out.stdout.startswith("refused")


def test_entry_works_without_what_the_operators_need():
    code = "import sys; sys.modules['public_tokenizers'] = None; sys.modules['tokenizers'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True)
    n, ops, known = out.stdout.split()
    assert int(n) > 90 and ops == "False" and known == "True"


def test_failed_calls_are_tried_again(spark):
    sources = spark.createDataFrame([("a.txt", "x" * 10), ("b.txt", "bad")], "name string, content string")
    cache, none = spark.createDataFrame([], "name string, hash string, files_written array<string>"), spark.createDataFrame([], "path string, content string")

    def model(text):
        if text == "bad":
            raise ValueError("no")
        return "---FILE: wiki/concepts/c.md---\n# c\n---END FILE---"

    out = N.ingest(sources, cache, none, model, "2024-01-01")
    assert [r.name for r in out["failures"].collect()] == ["b.txt"] and [r.name for r in out["cache"].collect()] == ["a.txt"]
    again = N.ingest(sources, out["cache"], spark.createDataFrame([("wiki/concepts/c.md", "# c")], "path string, content string"), lambda t: "none", "2024-01-01")
    assert [r.path for r in again["writes"].collect()] == ["wiki/sources/b.md"]


def test_groups_are_declared_different_once(spark, tmp_path):
    table = stores.KeyedTable(spark, str(tmp_path / "n"), stores.NOT_DUPLICATES)
    groups = lambda *g: spark.createDataFrame([(list(x),) for x in g], "slugs array<string>")
    assert stores.declare_different(table, groups(("b", "a"), ("A", "b"), ("x",))) == 1 and stores.declare_different(table, groups(("B", "A"), ("c", "a"))) == 1
    assert {r.key for r in table.read().collect()} == {"a,b", "a,c"}
    table.upsert(spark.createDataFrame([("a,b", ["z"])], stores.NOT_DUPLICATES))
    assert {(r.key, tuple(r.slugs)) for r in table.read().collect()} == {("a,b", ("z",)), ("a,c", ("a", "c"))}


def test_replaced_texts_are_kept(spark):
    writes = spark.createDataFrame([("wiki/a b.md", "new", "old"), ("wiki/c.md", "new", None)], "path string, content string, backup string")
    got = N.backups(writes, F.lit("2024-05-06 07:08:09").cast("timestamp")).collect()
    assert [(r.path, r.content) for r in got] == [("history/wiki_a_b.md.2024-05-06T07-08-09.md", "old")]


def test_many_merges_into_one_page_are_those_one_by_one(monkeypatch):
    """Without a merger lists are gathered and written once, front matter is not parsed; the text is that of merging in turn."""
    import random

    from tessera.functions import markdown as M

    rng = random.Random(4)
    item = lambda: rng.choice(["a", "A", "b", "c d", "e,f", '"g', "h]", " i", "é", "[j"])
    heads = [lambda v: f"sources: [{', '.join(v)}]", lambda v: "sources:\n" + "\n".join(f"  - {x}" for x in v), lambda v: f"tags: [{', '.join(v)}]\nrelated: []", lambda v: "", lambda v: f"sources: [{v[0]},\n  {v[-1]}]\ntags: []", lambda v: f'related: ["{v[0]}"]\nrelated:\n  - z', lambda v: f"sources: [{v[0]}]\ntitle: x"]
    page = lambda k: f"---\ntype: concept\n{rng.choice(heads[:k])([item() for _ in range(rng.randrange(1, 4))])}\n---\n\n{rng.choice('xyz')}"

    def one_by_one(xs, old):
        for x in xs:
            old = M.merge_page(M.sanitized(x), old, None, "2024-01-01")
        return old

    for i in range(3000):
        xs, old = [page(1 if i % 2 else 7) for _ in range(rng.randrange(1, 6))] + ["no front matter"] * (i % 50 == 0), rng.choice([None, "", "# old", page(7)])
        assert M.merged_in_turn(xs, old, None, "2024-01-01") == one_by_one(xs, old), (xs, old)
    written = []
    monkeypatch.setattr(M, "write_list", lambda *a, f=M.write_list: written.append(a) or f(*a))
    monkeypatch.setattr(M, "parse_front_matter", None)
    many = [f'---\ntype: concept\nsources: ["{i}"]\n---\n\n# {i}' for i in range(2000)]
    assert M.read_list(M.merged_in_turn(many, None, None, "2024-01-01"), "sources") == [str(i) for i in range(2000)] and len(written) == 1
