"""Small functions over whole columns of the given tables: markup planted around each row's whole text, with what must come
out of it. Long results are compared by their hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import language as L
from tessera.functions import markdown as M
from tessera.functions import text as T
from tessera.operators import ingest as N
from tessera.operators import retrieval as R
from tessera.plans.corpus import table
from tessera.plans.registry import query
from tessera.plans.retrieval import PUNCT, _tokens_sql
from tessera.plans.text import _latin_sql

#: Characters that would be markup of their own; a text without them is the same to every function.
MARKUP = "`~[]{}$\"\\"
CLEAN_SQL = f"translate(coalesce(text, ''), '{MARKUP}', '{' ' * len(MARKUP)}')"


def _docs(spark, sf_dir):
    clean = F.translate(F.coalesce("text", F.lit("")), MARKUP, " " * len(MARKUP))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", clean.alias("c"))


TYPES = ("entity", "Concept", "QUERY", "source", "thesis", "finding", "event", "overview", "memo")


@query("type_labels", "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{T.TYPE_LABELS.get(t.lower(), 'Page')}'" for i, t in enumerate(TYPES)) + " END AS label FROM documents")
def type_labels(spark, sf_dir):
    """What the pages that hold each document are called."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    page = F.concat(F.lit("---\ntitle: x\ntype: "), kind, F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", T.type_label(T.page_type(page)).alias("label"))


SRC = "CASE doc_id % 5 WHEN 0 THEN 'https://' || source || '/a.png' WHEN 1 THEN '/abs/' || lang || '.png' WHEN 2 THEN 'media/' || source || '/i.png' WHEN 3 THEN './media/' || source || ' ' || lang || '/i.png' ELSE 'C:\\' || source || '.png' END"


@query(
    "image_sources",
    f"""SELECT doc_id, src, CASE doc_id % 5 WHEN 2 THEN '/w/p/wiki/' || src WHEN 3 THEN '/w/p/wiki/' || substr(src, 3) ELSE src END AS resolved,
  CASE doc_id % 5 WHEN 2 THEN source WHEN 3 THEN source || ' ' || lang END AS slug, src AS unbased FROM (SELECT *, {SRC} AS src FROM documents)""",
)
def image_sources(spark, sf_dir):
    """Where images lie, and which source's media folder holds them; without a project sources stay as they are."""
    src = F.col("src")
    named = _docs(spark, sf_dir).withColumn("src", F.expr(SRC.replace("\\", "\\\\")))
    return named.select("doc_id", "src", T.image_src(src, F.lit("/w\\p")).alias("resolved"), T.media_slug(src).alias("slug"), T.image_src(src, F.lit(None).cast("string")).alias("unbased"))


@query(
    "language_metadata",
    f"SELECT doc_id, language, language AS prompt_name, CASE WHEN language = 'English' THEN 'en' END AS html_lang, 'ltr' AS direction, 'latin' AS script_family FROM (SELECT doc_id, {_latin_sql()} AS language FROM (SELECT doc_id, lower(text) AS l FROM documents))",
)
def language_metadata(spark, sf_dir):
    """How the language of each document is named and written."""
    found = _docs(spark, sf_dir).select("doc_id", L.detect_language(F.col("text")).alias("language"))
    return found.select("doc_id", "language", L.language_metadata(F.col("language")).alias("m")).select("doc_id", "language", "m.*")


TARGETS = ("English", "French", "Chinese", "Arabic", "Japanese", "Persian")
SAMPLE_SQL = "substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\A[\\s\\S]{3}[\\s\\S]*?\\n---\\n', ''), '```[\\s\\S]*?```', '', 'g'), '\\$\\$[\\s\\S]*?\\$\\$', '', 'g'), '\\$[^$\\n]*\\$', '', 'g'), 1, 1500)"


@query("language_matches", f"SELECT doc_id, doc_id % 6 < 2 OR length(trim({SAMPLE_SQL})) < 20 AS fits FROM documents WHERE text IS NOT NULL")
def language_matches(spark, sf_dir):
    """Whether each document may be a page for one of six languages; the tables hold Latin scripts alone."""
    target = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", L.language_matches(F.col("text"), target).alias("fits"))


@query(
    "reasoning_of_streams",
    """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN md5(text || '|r') ELSE md5('') END AS texts, CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS least_chars FROM conversations WHERE text IS NOT NULL AND text <> ''""",
)
def reasoning_of_streams(spark, sf_dir):
    """Each turn as the reasoning of a streamed answer, in the three shapes that services give it, and as plain text."""
    text, none = F.col("text"), F.lit(None)
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("reasoning_content"), F.lit("r").alias("reasoning")).alias("delta"))).alias("choices")))
    thinking = F.to_json(F.struct(F.struct(F.lit("thinking_delta").alias("type"), text.alias("thinking"), F.lit("r").alias("text")).alias("delta")))
    part = lambda t, yes: F.struct(t.alias("text"), F.lit(yes).alias("thought"))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part(text, True), part(F.lit("said"), False), part(F.lit("r"), True)).alias("parts")).alias("content"))).alias("candidates")))
    plain = F.to_json(F.struct(F.struct(F.lit("text_delta").alias("type"), text.alias("text"), none.cast("string").alias("thinking")).alias("delta")))
    kind = F.col("turn") % 4
    line = F.concat(F.lit("  data: "), F.when(kind == 0, delta).when(kind == 1, thinking).when(kind == 2, parts).otherwise(plain), F.lit(" "))
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND text <> ''")
    return rows.select("conv_id", "turn", F.md5(F.array_join(N.reasoning_texts(line), "|")).alias("texts"), (N.reasoning_chars(line) > F.when(kind == 0, F.length(text)).otherwise(0)).cast("int").alias("least_chars"))


@query(
    "shown_markdown",
    f"""SELECT doc_id, md5({CLEAN_SQL} || ' [the ' || lang || '](wikilink:' || source || ') $\\alpha$ [a](wikilink:a) \\beta' || chr(10) || '$$' || chr(10) || '\\begin{{x}}1\\end{{x}}' || chr(10) || '$$ ' || chr(10) || 'α and ' || chr(10) || ' x') AS shown FROM documents""",
)
def shown_markdown(spark, sf_dir):
    """Whole texts with links, mended links, formulas and a bare environment, as they are shown."""
    shown = F.concat("c", F.lit(" [["), "source", F.lit("|the "), "lang", F.lit("]] $\\alpha$ [[a] \\beta\n\\begin{x}1\\end{x} $\n\\alpha$ and \n x"))
    # the formula over a line end is no formula of one line, so it becomes plain text
    return _docs(spark, sf_dir).select("doc_id", F.md5(M.apply_text(M.display_markdown)(shown)).alias("shown"))


def _page(head, body="c"):
    return F.concat(F.lit(f"---\n{head}\n---\n"), body)


#: Sequential functions: what each is given around the whole text, and the SQL of what it must give. `t` stands for the text.
GIVEN = [
    ("linked_markdown", M.linked_markdown, ["t", " [[", "source", "|the ", "lang", "]] `[[", "source", "]]` [[z w]]"], ["t", " [the ", "lang", "](#", "source", ") `[[", "source", "]]` [z w](#z%20w)"]),
    ("latex", M.latex_as_unicode, ["t", " $\\alpha$ $a \\leq \\beta$ $$x \\gamma$$ $\\", "lang", "$"], ["t", " α a ≤ β \nx \\gamma\n \\", "lang"]),
    ("sanitized", M.sanitized, ["```markdown\n---\nrelated: [[", "source", "]], [[b]]\n---\n", "t", "\n```"], ['---\nrelated: ["[[', "source", ']]", "[[b]]"]\n---\n', "t"]),
    ("json_object", M.first_json_object, ["t", ' {"text": "', "t", '}", "more": {"lang": "', "lang", '"}} {"tail": 1}'], ['{"text": "', "t", '}", "more": {"lang": "', "lang", '"}}']),
    ("set_scalar", lambda t: M.set_scalar(t, "updated", "d2"), ["---\ntitle: ", "source", "\nupdated: d1\n---\n", "t"], ["---\ntitle: ", "source", "\nupdated: d2\n---\n", "t"]),
    ("write_list", lambda t: M.write_list(t, "tags", ["a", "b"]), ["---\ntags:\n  - ", "source", "\nz: ", "lang", "\n---\n", "t"], ['---\ntags: ["a", "b"]\nz: ', "lang", "\n---\n", "t"]),
    ("read_list", lambda t: "|".join(M.read_list(t, "tags")), ["---\ntags:\n  - ", "source", '\n  - "x ', "lang", '"\n---\n', "t"], ["source", "|x ", "lang"]),
    ("enriched", lambda t: M.enriched(t, [("Zq rope", "zq"), ("QZ", "qz")]), ["---\nt: Zq rope\n---\n", "t", " a Zq rope, a Zq rope and QZ"], ["---\nt: Zq rope\n---\n", "t", " a [[zq|Zq rope]], a Zq rope and [[QZ]]"]),
    ("redirected", lambda t: M.redirected(t, {"a": "b"}), ["t", " [[a]] [[a|", "source", "]] [[c|a]]"], ["t", " [[b]] [[b|", "source", "]] [[c|a]]"]),
    ("without_entries", lambda t: M.without_entries(t, ["zq-gone"]), ["t", "\n- [[zq-gone|", "source", "]]\n- [[stays]]\n- (a/zq-gone.md) x\n", "t"], ["t", "\n- [[stays]]\n", "t"]),
    ("research_topic", lambda t: "|".join([M.research_topic(t, "d")[0], *M.research_topic(t, "d")[1]]), ["t", "\nTOPIC: Ropes of ", "source", "\nQUERY: ", "lang", "\nQUERY: b \nQUERY: c\nQUERY: e"], ["Ropes of ", "source", "|", "lang", "|b|c"]),
    ("lint_blocks", lambda t: "|".join(f"{b['type']},{b['severity']},{b['title']},{b['detail']},{'+'.join(b['pages'])}" for b in M.lint_blocks(t)), ["t", "\n---LINT: stale | Warning | ", "source", " ---\nsee ", "lang", "\nPAGES: a.md, b.md\n---END LINT---\n", "t"], ["stale,warning,", "source", ",see ", "lang", ",a.md+b.md"]),
    ("sse_lines", lambda t: "|".join(M.sse_lines([t[:7], t[7:]])), ["data: {", "source", "}\nevent: ", "t", "\ndata: [DONE]\n"], ["{", "source", "}|[DONE]"]),
]
COLUMNS = ("source", "lang")


def _cell(x: str) -> str:
    """A piece in SQL."""
    if x == "t":
        return "t"
    return x if x in COLUMNS else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("text_functions", "SELECT doc_id, " + ", ".join(f"md5({' || '.join(map(_cell, want))}) AS {name}" for name, _, _, want in GIVEN) + f" FROM (SELECT doc_id, source, lang, {CLEAN_SQL} AS t FROM documents)")
def text_functions(spark, sf_dir):
    """What the sequential text functions make of each document, through Arrow batches."""
    piece = lambda x: F.col("c") if x == "t" else F.col(x) if x in COLUMNS else F.lit(x)
    return _docs(spark, sf_dir).select("doc_id", *(F.md5(M.apply_text(f)(F.concat(*map(piece, given)))).alias(name) for name, f, given, _ in GIVEN))


EXTENSIONS = (("TSX", "code"), ("parquet", "unknown"), ("PDF", "pdf"), ("key", "document"), ("csv", "data"), ("jpeg", "image"), ("mkv", "video"), ("flac", "audio"))
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x27;", "''"))


def _decoded_sql(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(
    "column_functions",
    f"""SELECT doc_id, md5('x ' || t || 'y') AS strip_thinking, md5(t || '|' || lang) AS thinking, md5({_decoded_sql("'&amp;lt;&quot;' || text || '&#x27;'")}) AS entities,
  CASE doc_id % 8 {' '.join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(EXTENSIONS))} END AS category,
  md5(regexp_replace(lower(trim(text)), '^{PUNCT}|{PUNCT}$', '', 'g')) AS phrase, md5(array_to_string(list_sort(list_distinct({_tokens_sql('text')})), ' ')) AS tokens,
  CASE doc_id % 4 WHEN 0 THEN 'append' WHEN 1 THEN 'overwrite' ELSE 'merge' END AS action, source || '.' || doc_id AS stem, 'raw > ' || source || ' > ' || lang AS crumbs
FROM (SELECT *, {CLEAN_SQL} AS t FROM documents WHERE text IS NOT NULL)""",
)
def column_functions(spark, sf_dir):
    """What column expressions make of each document."""
    i = F.col("doc_id").cast("string")
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    ext = F.element_at(F.array(*(F.lit(e) for e, _ in EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 4 == 0, F.lit("wiki/log.md")).when(F.col("doc_id") % 4 == 1, F.lit("wiki/index.md")).otherwise(F.concat(F.lit("wiki/concepts/"), i, F.lit(".md")))
    routed = N.route(docs.select("*", path.alias("path"), F.col("text").alias("content")))
    none = F.array().cast("array<string>")
    return routed.select(
        "doc_id", F.md5(T.strip_thinking(F.concat(F.lit("x <think>a\nb</think>  "), "c", F.lit("y<THINKING>d"), "c"))).alias("strip_thinking"),
        F.md5(F.array_join(T.thinking(F.concat(F.lit("a <think>"), "c", F.lit("</think> b <thinking>"), "lang")), "|")).alias("thinking"),
        F.md5(T.decode_entities(F.concat(F.lit("&amp;lt;&quot;"), "text", F.lit("&#x27;")))).alias("entities"), T.file_category(F.concat(F.lit("a/"), "source", F.lit("."), ext)).alias("category"),
        F.md5(R.query_phrase(F.col("text"))).alias("phrase"), F.md5(F.array_join(F.array_sort(F.coalesce(R.query_tokens(F.col("text")), none)), " ")).alias("tokens"),
        "action", T.file_stem(F.concat(F.lit("a/"), "source", F.lit("."), i, F.lit(".gz"))).alias("stem"), T.breadcrumb(F.concat(F.lit("raw//"), "source", F.lit("\\"), "lang", F.lit("/x.md"))).alias("crumbs"),
    )


ADDRESS = "CASE page_id % 4 WHEN 0 THEN 'wiki/' || url WHEN 1 THEN 'wiki/../' || url WHEN 2 THEN replace(url, '/', '\\') ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END"


@query(
    "path_functions",
    f"""SELECT page_id, p, regexp_replace(replace(p, '\\', '/'), '/{{2,}}', '/', 'g') AS path, regexp_matches(replace(p, '\\', '/'), '^wiki/.') AND NOT regexp_matches(replace(p, '\\', '/'), '(^|/)\\.\\.(/|$)') AS safe,
  regexp_matches(p, '^[\\p{{L}}\\p{{N}}_.-]{{1,256}}$') AS page_id_like FROM (SELECT page_id, {ADDRESS} AS p FROM pages WHERE html IS NOT NULL AND url IS NOT NULL)""",
)
def path_functions(spark, sf_dir):
    """Addresses and titles of web pages as paths and page ids."""
    p = F.col("p")
    named = table(spark, sf_dir, "pages").where("html IS NOT NULL AND url IS NOT NULL").select("page_id", F.expr(ADDRESS.replace("\\", "\\\\")).alias("p"))
    return named.select("page_id", "p", T.normalize_path(p).alias("path"), T.is_safe_page_path(p).alias("safe"), T.is_page_id(p).alias("page_id_like"))
