import pytest
from pyspark.sql import functions as F

from tessera.functions import language as L
from tessera.functions import markdown as M
from tessera.functions import text as T
from tessera.operators import hygiene as H
from tessera.operators import retrieval as R


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, language",
    [
        ("", "English"), ("The quick brown fox", "English"), ("Der Hund und die Katze", "German"), ("le chat est sur la table", "French"), ("el perro corre por las calles", "Spanish"),
        ("não é uma questão", "Portuguese"), ("это русский текст", "Russian"), ("注意力机制很重要", "Chinese"), ("これは漢字です", "Japanese"), ("안녕하세요 여러분", "Korean"), ("این کتاب است که می‌خوانم", "Persian"),
        ("هذا كتاب في البيت", "Arabic"), ("zażółć gęślą", "Polish"), ("tiếng Việt", "Vietnamese"), ("het is een mooie dag van dat jaar", "Dutch"), ("שלום עולם", "Hebrew"),
    ],
)
def test_language(spark, text, language):
    assert one(spark, L.detect_language(F.col("t")), t=text) == language


@pytest.mark.parametrize("text, yes", [("Hello!", True), ("hi there", True), ("你好啊", True), ("good morning。", True), ("hi, how do I fit a model", False), ("", False), ("привет", True)])
def test_greeting(spark, text, yes):
    assert one(spark, L.is_greeting(F.col("t")), t=text) is yes


def test_query_tokens(spark):
    tokens = lambda q: one(spark, R.query_tokens(F.col("q")), q=q)
    assert tokens("What is the kv-cache, really? kv") == ["kv", "cache", "really?"]
    assert tokens("默会知识") == ["默会", "会知", "知识", "默", "会", "知", "识", "默会知识"]
    assert tokens("the of") == []
    assert one(spark, R.query_terms(F.col("q")), q="The") == ["the"]
    assert one(spark, R.query_phrase(F.col("q")), q=" 总资产。 ") == "总资产"


def test_occurrences_and_budget(spark):
    assert one(spark, R.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert one(spark, R.occurrences(F.col("t"), F.lit("")), t="aaaaa") == 0
    assert one(spark, R.context_budget(F.lit(0)), t="").asDict() == {"max_ctx": 204800, "response_reserve": 30720, "index_budget": 10240, "page_budget": 102400, "max_page_size": 30720}
    assert one(spark, R.context_budget(F.lit(4000)), t="").max_page_size == 2000


def test_paths_and_keys(spark):
    p = F.col("p")
    assert one(spark, T.file_stem(p), p="a/b.tar.gz") == "b.tar" and one(spark, T.file_stem(p), p=".env") == ".env"
    assert one(spark, T.relative_path(p, F.lit("/x/y/")), p="/x/y/z.md") == "z.md"
    assert one(spark, T.is_safe_page_path(p), p="wiki/a/../../b") is False and one(spark, T.is_safe_page_path(p), p="wiki/a.md") is True
    assert one(spark, T.unicode_slug(p), p="  Émile & co!! ") == "émile-co" and one(spark, T.unicode_slug(p), p="!!") == "query"
    assert one(spark, T.review_title(p), p="缺失页面：注意力  机制") == "注意力 机制"
    assert one(spark, T.unwrap_wikilink(p), p="[[a-b|A B]]").asDict() == {"slug": "a-b", "label": "A B"}
    assert one(spark, T.strip_thinking(p), p="<think>x</think> hi <thinking>open") == "hi"
    assert one(spark, T.decode_entities(p), p="&amp;lt; &#39;") == "< '"
    assert one(spark, T.host_name(p), p="https://www.a.org/x") == "a.org"
    assert one(spark, T.file_category(p), p="x/Y.PDF") == "pdf"
    assert one(spark, T.wikilinks(p), p="[[a]] [[b|c]] [[a]]") == ["a", "b", "a"]


PAGE = '---\ntitle: "KV Cache"\ntype: Concept\nsources: ["a.pdf", \'b.pdf\']\ntags:\n  - x\n  - "y"\n---\n\n# Other\n\nbody [[link|alias]]'


def test_page_fields(spark):
    c = F.col("c")
    assert one(spark, T.page_title(c, F.lit("f.md")), c=PAGE) == "KV Cache"
    assert one(spark, T.page_title(c, F.lit("kv-cache.md")), c="text") == "kv cache"
    assert one(spark, T.page_title(c, F.lit("f.md")), c="x\n# Head \ny") == "Head"
    assert one(spark, T.page_type(c), c=PAGE) == "concept" and one(spark, T.page_type(c), c="x") == "other"
    assert one(spark, T.page_sources(c), c=PAGE) == ["a.pdf", "b.pdf"] and one(spark, T.list_field(c, "tags"), c=PAGE) == ["x", "y"]


def test_unions(spark):
    a, b = F.array(F.lit("A"), F.lit("b")), F.array(F.lit("B"), F.lit("c"), F.lit("a"))
    assert one(spark, H.union_ci(a, b)) == ["A", "b", "c"]
    assert one(spark, H.minus_ci(b, a)) == ["c"]
    assert one(spark, H.source_fate(a, F.lit("B"))) == "keep"


# chunks


def test_chunks_are_whole():
    text = "# A\n\n" + "word. " * 600 + "\n\n```\n" + "code\n" * 400 + "```\n\n## B\n\nshort\n"
    got = M.chunk_markdown(text)
    assert [c["index"] for c in got] == list(range(len(got)))
    code = [c for c in got if "code" in c["text"]]
    assert len(code) == 1 and code[0]["oversized"] and code[0]["text"].count("code\n") == 400
    assert got[-1]["heading_path"] == "# A > ## B"
    plain = M.chunk_markdown(text, M.ChunkOptions(overlap=0))
    assert all(text[c["char_start"] : c["char_start"] + 3] == c["text"][:3] for c in plain)
    assert all(len(c["text"]) <= 1500 for c in plain if not c["oversized"])


def test_paragraphs_are_cut_once():
    text = ("x" * 90 + " ") * 60
    got = M.chunk_markdown(text, M.ChunkOptions(overlap=0))
    assert "".join(c["text"] for c in got) == text


def test_no_headings_in_code_and_empty():
    assert M.chunk_markdown("---\na: b\n---\n") == [] and M.chunk_markdown(None) == []
    assert M.chunk_markdown("```\n# no\n```")[0]["heading_path"] == ""


# front matter, blocks, merges


def test_front_matter():
    got = M.parse_front_matter(PAGE)
    assert got["scalars"] == {"title": "KV Cache", "type": "Concept"} and got["lists"]["tags"] == ["x", "y"]
    assert M.parse_front_matter("---\nrelated: [[a]], [[b]]\nd: 2024-01-01\n---\nx")["lists"]["related"] == ["[[a]]", "[[b]]"]
    assert M.parse_front_matter("```yaml\n---\na: 1\n---\n```\nbody")["body"] == "body"
    assert M.parse_front_matter("a: [\n")["scalars"] is None
    assert M.parse_front_matter("---\na: [\n---\nx")["scalars"] is None


def test_lists_and_scalars():
    out = M.write_list(PAGE, "tags", ["q"])
    assert M.read_list(out, "tags") == ["q"] and M.read_list(out, "sources") == ["a.pdf", "b.pdf"]
    assert M.read_list(M.write_list(PAGE, "related", ["r"]), "related") == ["r"]
    assert M.set_scalar(PAGE, "title", "T").count("title: T\n") == 1 and M.write_list("plain", "a", ["b"]) == "plain"


def test_merge_page():
    new = PAGE.replace("a.pdf", "c.pdf")
    assert M.read_list(M.merge_page(new, PAGE, None, "2024-01-01"), "sources") == ["a.pdf", "b.pdf", "c.pdf"]
    other = new.replace("body", "body that is longer")
    good = M.merge_page(other, PAGE, lambda old, now: now.replace("KV Cache", "Renamed"), "2024-01-02")
    assert "title: KV Cache" in good and "updated: 2024-01-02" in good
    short = M.merge_page(other, PAGE, lambda old, now: "---\na: b\n---\nx", "2024-01-02")
    assert "body that is longer" in short and "updated" not in short
    assert M.merge_page(PAGE, PAGE, None, "d") == PAGE and M.merge_page(PAGE, None, None, "d") == PAGE


def test_file_blocks():
    text = "x\n---FILE: wiki/a.md---\none\n```\n---END FILE---\n```\ntwo\n---END FILE---\n---FILE: /etc/x---\nno\n---end file---\n---FILE: wiki/b.md---\nopen"
    got = M.file_blocks(text.replace("\n", "\r\n"))
    assert got.files == [("wiki/a.md", "one\n```\n---END FILE---\n```\ntwo")] and len(got.warnings) == 2


def test_review_and_lint_blocks():
    got = M.review_blocks("---REVIEW: Missing-Page | T ---\nBody\nPAGES: a, b\nSEARCH: q | r\n---END REVIEW---\n---REVIEW: odd | U ---\n\n---END REVIEW---")
    assert got[0] == {"type": "missing-page", "title": "T", "description": "Body", "options": ["Approve", "Skip"], "affected_pages": ["a", "b"], "search_queries": ["q", "r"]}
    assert got[1]["type"] == "confirm"
    assert M.lint_blocks("---LINT: contradiction | warning | Dates ---\nx\nPAGES: a.md\n---END LINT---")[0]["pages"] == ["a.md"]


def test_json_objects():
    assert M.first_json_object('say ```json\n{"a": "}", "b": {"c": "\\""}} and {"d": 1}') == '{"a": "}", "b": {"c": "\\""}}'
    assert M.first_json_object("{open") == "" and M.first_json_object(None) == ""


def test_links():
    assert M.enriched("---\na: KV\n---\nKV and [[KV]] KV", [("KV", "kv-cache"), ("KV", "kv-cache")]) == "---\na: KV\n---\n[[kv-cache|KV]] and [[KV]] KV"
    assert M.redirected('---\nrelated: ["old", "New"]\n---\n[[old|x]] [[older]]', {"old": "new"}) == '---\nrelated: ["new"]\n---\n[[new|x]] [[older]]'
    assert M.without_entries("- [[ai]]\n- [[openai]]\n- [x](p/ai.md)\nai.md\nnote", ["ai"]) == "- [[openai]]\nnote"
    assert M.linked_markdown("[[a b|c]] `[[x]]`") == "[c](#a%20b) `[[x]]`"
    plan = M.merge_plan([{"slug": "a", "path": "a.md", "content": PAGE}, {"slug": "b", "path": "b.md", "content": PAGE.replace("a.pdf", "z.pdf")}], "a", PAGE, [{"path": "c.md", "content": "[[b]]"}], "2024-01-01")
    assert plan["deletes"] == ["b.md"] and plan["rewrites"] == {"c.md": "[[a]]"} and set(plan["backup"]) == {"a.md", "b.md", "c.md"}


def test_sanitized_and_latex_and_stream():
    assert M.sanitized("```markdown\nfrontmatter:\n---\nr: [[a]], [[b]]\n---\nx\n```\n") == '---\nr: ["[[a]]", "[[b]]"]\n---\nx'
    assert M.latex_as_unicode(r"$\alpha \leq x$ and $\frac{1}{2}$") == "α ≤ x and /{1}{2}"
    assert list(M.sse_lines(["data: a\nda", "ta: b\n: c\ndata: d"])) == ["a", "b", "d"]
    assert M.research_topic("TOPIC: t\nQUERY: a\nQUERY: b\nQUERY: c\nQUERY: d", "x") == ("t", ["a", "b", "c"])
