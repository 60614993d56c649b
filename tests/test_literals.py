"""Small functions on rows that try every branch, with what they must give."""

from pyspark.sql import functions as F

from tessera.functions import language as L
from tessera.functions import markdown as M
from tessera.functions import text as T
from tessera.operators import ingest as N
from tessera.operators import retrieval as R


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


LABELS = [("entity", "Entity"), (" Concept ", "Concept"), ("QUERY", "Query"), ("source", "Source"), ("thesis", "Thesis"), ("finding", "Finding"), ("event", "Event"), ("overview", "Overview"), ("other", "Page"), ("", "Page")]


IMAGES = [
    ("https://x.org/a.png", "https://x.org/a.png", None), ("DATA:image/png;base64,AA", "DATA:image/png;base64,AA", None), ("/abs/a.png", "/abs/a.png", None), ("C:\\d\\a.png", "C:\\d\\a.png", None),
    ("media/rope/img-1.png", "/w/p/wiki/media/rope/img-1.png", "rope"), ("./media/a b/i.png", "/w/p/wiki/media/a b/i.png", "a b"), ("../x.png", "/w/p/wiki/../x.png", None), ("/home/u/wiki/media/s/i.png", "/home/u/wiki/media/s/i.png", "s"), ("", "", None),
]


METADATA = [
    ("English", "English", "en", "ltr", "latin"), ("Arabic", "Arabic / العربية", "ar", "rtl", "arabic"), ("Persian", "Persian (Farsi / فارسی)", "fa", "rtl", "arabic"), ("Hebrew", "Hebrew / עברית", "he", "rtl", "other"),
    ("Japanese", "Japanese", "ja", "ltr", "cjk"), ("Traditional Chinese", "Traditional Chinese", "zh-Hant", "ltr", "cjk"), ("Russian", "Russian", None, "ltr", "latin"), ("", "English", None, "ltr", "latin"),
]
META_NAMES = ["language", "prompt_name", "html_lang", "direction", "script_family"]


LONG_EN, LONG_ZH, LONG_AR = "a page of plain words that is long enough to be judged", "这是一个相当长的中文页面它有足够多的字可以用来判断它是哪一种语言", "هذا نص طويل بما يكفي للحكم على لغته من دون أي شك"
MATCHES = [
    (LONG_EN, "English", True), (LONG_EN, "French", True), (LONG_EN, "Chinese", False), (LONG_ZH, "Japanese", True), (LONG_ZH, "English", False), (LONG_AR, "Arabic", True), (LONG_AR, "Persian", False),
    (LONG_AR, "English", False), (LONG_EN, "Arabic", False), ("short 短", "English", True), ("---\ntitle: x\n---\n" + LONG_ZH, "English", False), ("```" + LONG_ZH + "``` code", "English", True), ("$$" + LONG_ZH + "$$ " + LONG_EN, "English", True),
]


STREAM = [
    ('data: {"choices":[{"delta":{"reasoning_content":"a\\\\nb","reasoning":"c"}}]}', "a\nb|c", 5), ('data: {"delta":{"type":"thinking_delta","thinking":"t","text":"u"}}', "t|u", 0), ('data: {"delta":{"type":"text_delta","thinking":"t"}}', "", 0),
    ('data: {"candidates":[{"content":{"parts":[{"text":"x","thought":true},{"text":"y"}]}}]}', "x", 0), ("data: [DONE]", "", 0), ("event: ping", "", 0), ("data: {broken", "", 0), ('  data: {"choices":[]}  ', "", 0),
]
STREAM = [(a.replace("\\\\n", "\\n"), b, c) for a, b, c in STREAM]


SHOWN = [
    ("see [[a|the a]] and [[b]]", "see [the a](wikilink:a) and [b](wikilink:b)"), ("broken [[c] here", "broken [c](wikilink:c) here"), ("angle \\alpha, $\\alpha$", "angle \\alpha, $\\alpha$"),
    ("\\begin{x}1\\end{x}", "$$\n\\begin{x}1\\end{x}\n$$"), ("$$\\begin{x}1\\end{x}$$", "$$\\begin{x}1\\end{x}$$"), ("plain", "plain"),
]




#: Text functions: name, what it is given, what it must give. A function of several arguments has them here.
TEXTS = [
    ("linked_markdown", M.linked_markdown, [("a [[x|the x]] `[[y]]` [[z w]]", "a [the x](#x) `[[y]]` [z w](#z%20w)"), ("```\n[[q]]\n```", "```\n[[q]]\n```")]),
    ("latex_as_unicode", M.latex_as_unicode, [("so $\\alpha \\leq \\beta$.", "so α ≤ β."), ("$\\frac{1}{2}$ and $$\\infty$$", "/{1}{2} and ∞"), ("5$", "5$"), ("$\\longrightarrow$ $\\zzz$", "⟶ \\zzz")]),
    ("sanitized", M.sanitized, [("```markdown\n---\na: b\n---\nx\n```", "---\na: b\n---\nx"), ("frontmatter:\n---\nrelated: [[a]], [[b]]\n---\nx", '---\nrelated: ["[[a]]", "[[b]]"]\n---\nx'), ("plain", "plain")]),
    ("first_json_object", M.first_json_object, [('```json\n{"a": "}", "b": {"c": 1}} more', '{"a": "}", "b": {"c": 1}}'), ("none", ""), ('x {"a": 1} {"b": 2}', '{"a": 1}'), ('{"open": 1', "")]),
    ("set_scalar", lambda t: M.set_scalar(t, "updated", "d2"), [("---\ntitle: T\nupdated: d1\n---\nx", "---\ntitle: T\nupdated: d2\n---\nx"), ("---\ntitle: T\n---\nx", "---\ntitle: T\nupdated: d2\n---\nx"), ("x", "x")]),
    ("write_list", lambda t: M.write_list(t, "tags", ["a", "b"]), [("---\ntags:\n  - x\n  - y\nz: 1\n---\nt", '---\ntags: ["a", "b"]\nz: 1\n---\nt'), ("---\nz: 1\n---\nt", '---\nz: 1\ntags: ["a", "b"]\n---\nt'), ("t", "t")]),
    ("read_list", lambda t: "|".join(M.read_list(t, "tags")), [("---\ntags:\n  - x\n  - \"y z\"\n---\n", "x|y z"), ("---\ntags: [a, 'b']\n---\n", "a|b"), ("tags: [a]", "")]),
    ("union_lists", lambda t: M.union_lists(t, "---\ntags: [A, c]\n---\n"), [("---\ntags: [a, b]\n---\n", '---\ntags: ["A", "c", "b"]\n---\n')]),
    ("merge_page", lambda t: M.merge_page(t, "---\ntitle: Old\nsources: [a]\n---\nbody", lambda o, n: n.replace("new", "both"), "d"), [("---\ntitle: New\nsources: [b]\n---\nnew body", '---\ntitle: Old\nsources: ["a", "b"]\nupdated: d\n---\nboth body'), ("---\ntitle: New\nsources: [b]\n---\nbody", '---\ntitle: New\nsources: ["a", "b"]\n---\nbody')]),
    ("enriched", lambda t: M.enriched(t, [("rope", "rope"), ("KV cache", "kv-cache"), ("rope", "rope")]), [("a rope and a rope, KV cache", "a [[rope]] and a rope, [[kv-cache|KV cache]]"), ("[[rope]] rope", "[[rope]] [[rope]]"), ("---\nt: rope\n---\nx", "---\nt: rope\n---\nx")]),
    ("redirected", lambda t: M.redirected(t, {"a": "b"}), [("[[a]] [[a|x]] [[c]]", "[[b]] [[b|x]] [[c]]"), ("---\nrelated: [a, B]\n---\n", '---\nrelated: ["b"]\n---\n')]),
    ("without_entries", lambda t: M.without_entries(t, ["gone"]), [("- [[gone|x]]\n- [[stays]]\n- (a/gone.md)\n- begone.mdx", "- [[stays]]\n- begone.mdx")]),
    ("research_topic", lambda t: "|".join([M.research_topic(t, "d")[0], *M.research_topic(t, "d")[1]]), [("TOPIC: Ropes\nQUERY: a\nQUERY: b \nQUERY: c\nQUERY: e", "Ropes|a|b|c"), ("nothing", "d|d")]),
    ("lint_blocks", lambda t: "|".join(f"{b['type']},{b['severity']},{b['title']},{b['detail']},{'+'.join(b['pages'])}" for b in M.lint_blocks(t)), [("---LINT: stale | Warning | Old dates ---\nsee\nPAGES: a.md, b.md\n---END LINT---\nx\n---LINT: gap | info | No page---\ny---END LINT---", "stale,warning,Old dates,see,a.md+b.md|gap,info,No page,y,"), ("---LINT: open | info | x ---\n", "")]),
    ("review_blocks", lambda t: "|".join(f"{b['type']},{b['title']},{b['description']},{'+'.join(b['options'])}" for b in M.review_blocks(t)), [("---REVIEW: Duplicate | A | B ---\nboth\nOPTIONS: Merge | Keep\n---END REVIEW---", "duplicate,A | B,both,Merge+Keep"), ("---REVIEW: odd | T ---\n---END REVIEW---", "confirm,T,,Approve+Skip"), ("---REVIEW: x ---\n---END REVIEW---", "")]),
    ("sse_lines", lambda t: "|".join(M.sse_lines([t[:7], t[7:]])), [("data: {\"a\":1}\nevent: x\ndata: [DONE]\n", '{"a":1}|[DONE]'), ("data:tail", "tail")]),
]
TEXT_ROWS = [(name, given, want) for name, _, cases in TEXTS for given, want in cases]




COLUMNS = [
    ("strip_thinking", "<think>a\nb</think> c <thinking>d", "c"), ("thinking", "<think>a</think> b <thinking>c", "a|c"), ("entities", "&amp;lt; &quot;x&#39;s&apos; &#x27;", "< \"x's' '"), ("category", "a/b.TSX", "code"), ("category", "x.parquet", "unknown"),
    ("category", "r.PDF", "pdf"), ("category", "d.key", "document"), ("phrase", " 「默会知识」。 ", "「默会知识」"), ("phrase", "(Attention!?)", "attention!?"), ("terms", "the of", "the of"), ("terms", "Rope scaling", "rope|scaling"),
    ("action", "wiki/log.md", "append"), ("action", "wiki/index.md", "overwrite"), ("action", "wiki/concepts/a.md", "merge"), ("stem", "a/.hidden", ".hidden"), ("stem", "a/b.tar.gz", "b.tar"), ("crumbs", "raw//sources\\x.md", "raw > sources"), ("slug", "  Café & KV-Cache ②! ", "Café-KV-Cache-②".lower()),
]



PATHS = [
    "wiki/entities/a-b.md", "wiki/../x.md", "/etc/x", "C:\\\\docs\\\\r.pdf", "wiki/concepts/kv cache.md", "raw/sources/deck.pptx", "a//b///c.tar.gz", ".hidden", "wiki/media/p/img-1.png", "notes.txt", "data/table.csv", "clip.MP4", "",
]


def checked(df, names, rows):
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(rows, key=repr)


def test_columns_on_literal_rows(spark):
    x, src = F.col("x"), F.col("src")
    checked(frame(spark, [r[:1] for r in LABELS], ["x"]).select("x", T.type_label(x).alias("label")), ["x", "label"], LABELS)
    images = frame(spark, [r[:1] for r in IMAGES], ["src"]).select("src", T.image_src(src, F.lit("/w\\p")).alias("a"), T.media_slug(src).alias("b"), T.image_src(src, F.lit(None).cast("string")).alias("c"))
    checked(images, ["src", "a", "b", "c"], [(*r, r[0]) for r in IMAGES])
    checked(frame(spark, [r[:1] for r in METADATA], ["x"]).select("x", L.language_metadata(x).alias("m")).select("x", "m.*"), ["x", *META_NAMES[1:]], METADATA)
    checked(frame(spark, [r[:2] for r in MATCHES], ["x", "t"]).select("x", "t", L.language_matches(x, F.col("t")).alias("fits")), ["x", "t", "fits"], MATCHES)
    checked(frame(spark, [r[:1] for r in STREAM], ["x"]).select("x", F.array_join(N.reasoning_texts(x), "|").alias("t"), N.reasoning_chars(x).alias("n")), ["x", "t", "n"], STREAM)
    paths = [p.replace("\\\\", "\\") for p in PATHS]
    got = frame(spark, [(p,) for p in paths], ["x"]).select("x", T.is_safe_page_path(x).alias("safe"), T.is_page_id(x).alias("page"))
    safe = {"wiki/entities/a-b.md", "wiki/concepts/kv cache.md", "wiki/media/p/img-1.png"}
    checked(got, ["x", "safe", "page"], [(p, p in safe, p in {".hidden", "notes.txt", "clip.MP4"}) for p in paths])


def test_column_functions_on_literal_rows(spark):
    x = F.col("given")
    made = {
        "strip_thinking": T.strip_thinking(x), "thinking": F.array_join(T.thinking(x), "|"), "entities": T.decode_entities(x), "category": T.file_category(x), "phrase": R.query_phrase(x), "terms": F.array_join(R.query_terms(x), "|"),
        "stem": T.file_stem(x), "crumbs": T.breadcrumb(x), "slug": T.unicode_slug(x),
    }
    routed = N.route(frame(spark, [r[:2] for r in COLUMNS], ["f", "given"]).select("f", "given", x.alias("path"), F.lit("x").alias("content")))
    got = F.col("action")
    for name, c in made.items():
        got = F.when(F.col("f") == name, c).otherwise(got)
    checked(routed.select("f", "given", got.alias("got")), ["f", "given", "got"], COLUMNS)


def test_text_functions_on_literal_texts():
    for name, f, cases in TEXTS:
        for given, want in cases:
            assert f(given) == want, (name, given)
    for given, want in SHOWN:
        assert M.display_markdown(given) == want
