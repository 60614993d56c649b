import io
import json
import os
import random
import zipfile
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators import graph as G
from tessera.operators import hygiene as H
from tessera.operators import ingest as N
from tessera.operators import insights as I
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import streams
from tessera.sources import files, office, stores, web
from tessera.streaming import queues as Q


def pages(spark, **contents):
    return spark.createDataFrame([(f"wiki/{k}.md", f"{k}.md", v) for k, v in contents.items()], "path string, file_name string, content string")


def test_search_order(spark):
    p = pages(spark, **{"attention": "x", "notes": "attention attention", "other": "---\ntitle: Attention heads\n---\nx", "none": "y"})
    got = [r.path for r in R.top_pages(R.score_pages(p, "attention。")).collect()]
    assert got == ["wiki/attention.md", "wiki/other.md", "wiki/notes.md"]


def test_fusion_arithmetic(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, rank int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "path string, rank int")
    got = {r.path: r.rrf for r in R.fuse(a, b, "path").collect()}
    assert got["x"] == 1 / 61 + 1 / 61 and got["y"] == got["z"] == 1 / 62


def test_image_hits(spark):
    p = pages(spark, a="![Attention map](m.png) ![x](n.png)", b="![other](m.png)")
    assert [(r.url, r.caption_match) for r in R.image_hits(p, "attention").collect()] == [("m.png", True), ("n.png", False)]


def test_page_scores(spark):
    hits = spark.createDataFrame([("p", "1", 0.9), ("p", "2", 0.8), ("q", "3", 0.9)], "page_id string, chunk_id string, score double")
    got = {r.page_id: round(r.score, 6) for r in V.page_scores(hits).collect()}
    assert got == {"p": 1.0, "q": 0.9}


def graph(spark):
    nodes = spark.createDataFrame([("a", "A", "entity", "wiki/a.md", ["s"]), ("b-c", "B", "concept", "wiki/b-c.md", ["s"]), ("C", "C", "source", "wiki/C.md", []), ("index", "I", "overview", "wiki/index.md", []), ("q", "Q", "query", "wiki/q.md", [])], "id string, title string, type string, path string, sources array<string>")
    links = spark.createDataFrame([("a", "B C"), ("a", "b-c"), ("b-c", "c"), ("a", "a"), ("C", "nowhere"), ("q", "a")], "src string, target string")
    return nodes, links


def test_links_resolve(spark):
    nodes, links = graph(spark)
    r = G.resolve_links(nodes, links)
    assert sorted((x.src, x.dst) for x in r.collect()) == [("a", "b-c"), ("a", "b-c"), ("b-c", "C"), ("q", "a")]
    assert {x.id: x.link_count for x in G.link_counts(nodes, r).collect()} == {"a": 3, "b-c": 3, "C": 1, "index": 0, "q": 1}
    rel = {(x.a, x.b): x.relevance for x in G.relevance(nodes, r).collect()}
    assert round(rel["a", "b-c"], 6) == round(3 + 4 + 1.2, 6)
    shown, edges = G.display_graph(nodes, links)
    assert {(e.a, e.b) for e in edges.collect()} == {("a", "b-c"), ("C", "b-c")} and shown.where("id = 'q'").count() == 0
    kept, _ = G.filter_graph(shown, edges, hide_isolated=True)
    assert {n.id for n in kept.collect()} == {"a", "b-c", "C"}


def test_communities_find_two_cliques(spark):
    clique = lambda ids: [(x, y, 1.0) for x in ids for y in ids if x < y]
    edges = spark.createDataFrame(clique("abcde") + clique("vwxyz") + [("e", "v", 1.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(c,) for c in "abcdevwxyz!"], "id string")
    got = {r.id: r.community for r in G.communities(nodes, edges).collect()}
    assert len({got[c] for c in "abcde"}) == 1 and len({got[c] for c in "vwxyz"}) == 1 and got["a"] != got["z"] and got["!"] == "!"
    gaps = I.bridges(spark.createDataFrame([("h", 0), ("x", 1), ("y", 2), ("z", 3)], "id string, community int"), spark.createDataFrame([("h", "x"), ("h", "y"), ("h", "z")], "a string, b string"))
    assert [(r.id, r.n) for r in gaps.collect()] == [("h", 3)]


def modularity(pairs, of):
    mass, inside = {}, 0
    for a, b in pairs:
        inside += of[a] == of[b]
        for x in (a, b):
            mass[of[x]] = mass.get(of[x], 0) + 1
    return inside / len(pairs) - sum(m * m for m in mass.values()) / (2 * len(pairs)) ** 2


def test_communities_are_merged_level_by_level(spark):
    """On a chain single moves stop at small pieces; the best pieces of n nodes are about sqrt(n) long."""
    pairs = [(f"x{i}", f"y{i}") for i in range(40)] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(100)]
    ids = sorted({x for p in pairs for x in p})
    got = {r.id: r.community for r in G.communities(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(*p, 1.0) for p in pairs], "a string, b string, weight double")).collect()}
    assert all(got[f"x{i}"] == got[f"y{i}"] for i in range(40)) and all(got[c] == c for c in set(got.values()))
    best = max(modularity(pairs, {i: i[1:] if i[0] in "xy" else f"z{int(i[1:]) // n}" for i in ids}) for n in range(2, 30))
    assert modularity(pairs, got) > 0.97 * best
    # no two linked communities gain by merging
    for a, b in pairs:
        if got[a] != got[b]:
            assert modularity(pairs, {i: got[a] if c == got[b] else c for i, c in got.items()}) <= modularity(pairs, got) + 1e-9


def test_reviews_and_cleanup(spark):
    items = spark.createDataFrame([("1", 1, "duplicate", "Possible duplicate: X", "old", None, ["a"], None), ("2", 2, "duplicate", "x", "", "s", ["b", "a"], ["q"])], "id string, seq long, type string, title string, description string, source_path string, affected_pages array<string>, search_queries array<string>")
    r = H.merge_reviews(items).first()
    assert (r.id, r.description, r.source_path, r.affected_pages, r.search_queries) == ("1", "old", "s", ["a", "b"], ["q"])
    keys = H.deleted_keys(spark.createDataFrame([("kv-cache", "KV Cache")], "slug string, title string"))
    p = pages(spark, x="[[KV_Cache|the cache]] [[ai]] [[kv cache]]")
    assert H.strip_dead_links(p, keys).first().content == "the cache [[ai]] kv cache"
    idx = pages(spark, i="# I\n- [[KV Cache]] a\n- [[b]] c")
    assert H.clean_index(idx, keys).first().content == "# I\n- [[b]] c"
    rel = H.related_pages(pages(spark, **{"sources/paper-1": "", "o": 'sources: "paper.pdf"', "n": "paper"}), spark.createDataFrame([("paper.pdf",)], "source string"))
    assert {r.path for r in rel.collect()} == {"wiki/sources/paper-1.md", "wiki/o.md"}


def test_valid_groups(spark):
    g = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, ["a", "c"]), (3, ["a", "zz"])], "group_id int, slugs array<string>")
    s, w = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"), spark.createDataFrame([(["C", "A"],)], "slugs array<string>")
    assert [(r.group_id, r.slugs) for r in H.valid_groups(g, s, w).collect()] == [(1, ["a", "b"])]


def test_greedy_pack_passes_over(spark):
    c = spark.createDataFrame([(1, 0, 1, "a", "x" * 60), (1, 1, 2, "b", "y" * 60), (1, 2, 3, "c", "z" * 30)], "query_id int, priority int, pos int, path string, content string")
    assert [(r.path, r.number) for r in C.pack_greedily(c, 100, 1000).collect()] == [("a", 1), ("c", 2)]
    assert C.trim_index(["## H", "long line with token", "token"], ["token"], 12) == ["## H", "token"]


def test_queue_transitions():
    s = (None, 0)
    for c in ("enqueue", "start", "fail", "start", "fail", "start", "fail"):
        s = Q.next_status(*s, c)
    assert s == ("failed", 3) and Q.next_status(*s, "retry") == ("pending", 0)
    assert Q.next_status("processing", 1, "restore") == ("pending", 1) and Q.next_status("pending", 0, "cancel") == (None, 0)
    assert Q.next_status("pending", 1, "enqueue") == ("pending", 1)


def test_streams_of_many_files_out_of_order(spark, tmp_path, monkeypatch):
    kinds = ["view", "click", "error", "purchase", "signup"]
    rows = [{"event_id": i, "ts": datetime(2024, 1, 1) + timedelta(minutes=i), "user_id": i * 7 % 11, "event_type": kinds[i * i % 13 % 5], "value": 1.0} for i in range(1005)]
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for r in rows:
        pq.write_table(pa.Table.from_pylist([r]), f := folder / f"{r['event_id']}.parquet")
        os.utime(f, (1.7e9 - r["event_id"],) * 2)  # the newest event is the oldest file
    state, command = {}, lambda k: streams.COMMANDS.get(k, "restore")
    for r in rows:
        state[r["user_id"]] = Q.next_status(*state.get(r["user_id"], (None, 0)), command(r["event_type"]))
    got = {r.task_id: (None if r.status == "done" else r.status, r.retries) for r in streams.queue_states(spark, str(tmp_path)).collect()}
    assert got == state
    for f in folder.iterdir():
        if int(f.stem) % 200:
            f.unlink()
    events = streams._events
    monkeypatch.setattr(streams, "_events", lambda s, d: events(s, d, 1))
    assert streams.stream_windows(spark, str(tmp_path)).agg({"n": "sum"}).first()[0] == 6


def test_files(spark, tmp_path):
    for name in ("a/x.md", "a/.hid/y.md", "b.pdf", "c.docx"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("# T")
    found = files.read_files(spark, str(tmp_path))
    assert [r.path for r in files.listing(found, str(tmp_path)).collect()] == ["a", "b.pdf", "c.docx", "a/x.md"]
    assert [r.path for r in files.pages(found, str(tmp_path)).collect()] == ["a/x.md"]
    text = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_text(found).collect()}
    assert text["b.pdf"] == "[pdf: b.pdf]" and text["c.docx"].startswith("[unreadable") and text["x.md"] == "# T"
    assert {r.path: r.breadcrumb for r in files.import_tasks(found, str(tmp_path)).collect()}["a/x.md"] == "a"


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/"), v)
    return b.getvalue()


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert office.docx(zipped(**{"word__document.xml": doc})) == "## H\n\n**bold**\n\n| a\\|b |\n| --- |"
    slide = lambda t: f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>'
    got = office.pptx(zipped(**{f"ppt__slides__slide{i}.xml": slide(i) for i in (10, 2)}))
    assert got.index("Slide 2") < got.index("Slide 10")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped(**{"xl__workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl___rels__workbook.xml.rels": '<R><r Id="r1" Target="worksheets/s.xml"/></R>', "xl__worksheets__s.xml": f'<worksheet {s}><sheetData><row><c r="A1"><v>3.0</v></c><c r="C1"><v>2.5</v></c></row></sheetData></worksheet>'})
    assert office.xlsx(book).split("\n")[0] == "| 3 |  | 2.50 |"
    assert office.odf(zipped(**{"content.xml": "<a><b>x &amp;lt; y</b> </a>"})) == "x < y"


def test_web(spark):
    html = '<head><title>t</title></head><nav>n</nav><h1>A</h1><p>b <b>c</b></p><div class="ad">no</div><table><tr><td>x</td></tr></table><img src="s.png" width="5"><img src="b.png">'
    md = web.to_markdown(html)
    assert md.startswith("# A\n\nb **c**") and "| x |" in md and "no" not in md and "s.png" not in md and "b.png" in md
    raw = spark.createDataFrame([(json.dumps({"results": [{"title": "T", "url": "https://www.x.org/a", "content": "c"}, {"title": "none"}]}),), (json.dumps({"organic_results": [{"title": "U", "link": "https://y.org", "snippet": "s", "source": "Y"}]}),)], "json string")
    assert sorted(tuple(r) for r in web.search_results(raw).collect()) == [("T", "https://www.x.org/a", "c", "x.org"), ("U", "https://y.org", "s", "Y")]


def test_ingest(spark):
    page = "---\ntype: source\ntitle: \"Paper\"\nsources: [\"paper.pdf\", \"b.pdf\"]\nrelated: [\"x\"]\n---\n\nfirst words\n\nmore"
    p = pages(spark, **{"paper": page, "index": "# I\n- [[paper]] a\n- [[x]] b", "o": '---\ntitle: "O"\nrelated: ["Paper", "x"]\n---\nsee [[paper|it]]'})
    e = {r.slug: r for r in N.entity_summaries(p).collect()}["paper"]
    assert (e.type, e.title, e.description, e.tags) == ("source", "Paper", "first words", [])
    out = N.cascade_delete(p, spark.createDataFrame([("wiki/paper.md",)], "path string"))
    left = {r.path: r.content for r in out["pages"].collect()}
    assert left == {"wiki/index.md": "# I\n- [[x]] b", "wiki/o.md": '---\ntitle: "O"\nrelated: ["x"]\n---\nsee it'}
    assert [r.folder for r in out["media"].collect()] == ["wiki/media/paper"]
    fate = N.delete_sources(p, spark.createDataFrame([("paper.pdf",)], "source string")).collect()
    assert [(r.path, r.action, r.sources) for r in fate] == [("wiki/paper.md", "keep", ["b.pdf"])]
    files = spark.createDataFrame([("wiki/log.md", "new"), ("wiki/index.md", "i"), ("wiki/concepts/c.md", "das ist und der die nicht ein Text auf Deutsch"), ("wiki/concepts/d.md", "这是一个相当长的中文页面它有足够多的字可以用来判断语言")], "path string, content string").withColumn("name", F.lit("s")).withColumn("i", F.lit(0))
    routed = {r.path: r.action for r in N.route(files, F.lit("English")).collect()}
    assert routed == {"wiki/log.md": "append", "wiki/index.md": "overwrite", "wiki/concepts/c.md": "merge"}
    old = spark.createDataFrame([("wiki/log.md", "old\n"), ("wiki/index.md", "i")], "path string, content string")
    written = {r.path: (r.content, r.backup) for r in N.merged_pages(N.route(files), old, "2024-01-01").collect()}
    assert written["wiki/log.md"] == ("old\n\nnew\n", "old\n") and "wiki/index.md" not in written


def test_images(spark):
    p = pages(spark, a="before ![x](u.png) after")
    r = N.image_references(p).first()
    assert (r.alt, r.url, r.before, r.after) == ("x", "u.png", "before ", " after")
    plan = N.caption_plan(spark.createDataFrame([("u", "h"), ("u", "h"), ("v", "g")], "url string, sha256 string"), spark.createDataFrame([("h", "cap")], "sha256 string, caption string"))
    assert {(x.url, x.caption, x.cached) for x in plan.collect()} == {("u", "cap", True), ("v", None, False)}
    once = p.select(N.with_image_section(F.col("content"), F.lit("S$1")).alias("c"))
    twice = once.select(N.with_image_section(F.col("c"), F.lit("T")).alias("c")).first().c
    assert once.first().c.endswith("S$1\n<!-- images:end -->\n") and twice.count("images:start") == 1 and "T\n<!-- images:end -->" in twice


def test_vector_store(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), 64)
    assert store.count() == 0
    chunks = spark.createDataFrame([("p1#0", "p1", 0, "alpha", "", "T"), ("p2#0", "p2", 0, "beta", "", "T")], "chunk_id string, page_id string, chunk_index long, chunk_text string, heading_path string, title string")
    store.upsert(stores.embed(chunks, stores.hash_embedding()))
    store.upsert(stores.embed(chunks.where("page_id = 'p1'"), stores.hash_embedding()))
    assert store.count() == 2
    store.upsert(store.read().limit(0))
    store.delete(spark.createDataFrame([("p2",)], "page_id string"))
    assert store.count() == 1
    try:
        store.upsert(store.read().withColumn("vector", F.array(F.lit(1.0).cast("float"))))
        raise AssertionError("a wrong dimension must be refused")
    except ValueError:
        pass
    calls = []

    def call(text):
        calls.append(len(text))
        if len(text) > 200:
            raise ValueError("too long")
        return [1.0]

    assert stores.embed_with_retries("x" * 700, call, lambda e: True) == [1.0] and calls == [700, 350, 175]


def test_relevance_of_given_pairs_is_that_of_all(spark):
    rng = random.Random(7)
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", rng.choice(["entity", "concept", "source", "x"]), f"wiki/n{i}.md", [f"s{rng.randrange(6)}" for _ in range(rng.randrange(4))]) for i in range(40)], "id string, title string, type string, path string, sources array<string>")
    links = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{int(40 * rng.random() ** 2)}") for _ in range(120)], "src string, dst string").where("src <> dst")
    every = {(r.a, r.b): round(r.relevance, 9) for r in G.relevance(nodes, links).collect()}
    asked = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(40) for j in range(40) if (i + 3 * j) % 4 == 0 and i != j] * 2, "a string, b string")
    got = {(r.a, r.b): round(r.relevance, 9) for r in G.relevance_between(nodes, links, asked).collect()}
    assert got == {p: every[p] for p in map(tuple, asked.distinct().collect()) if p in every} and len(got) > 50
