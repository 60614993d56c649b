"""String, path and language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import language as L
from tessera.functions import text as T
from tessera.plans.corpus import table
from tessera.plans.registry import query
from tessera.sources.web import plain_text


def _latin_sql() -> str:
    """The Latin cascade as a CASE, with the word ends of DuckDB's regular expressions (ASCII)."""
    out = "CASE "
    for name, tests in L.LATIN:
        conds = []
        for letters, words in tests:
            parts = [f"regexp_matches(l, '[{letters}]')"] * bool(letters)
            if words:
                parts.append(f"regexp_matches(l, '\\b({'|'.join(words.split())})\\b')")
            conds.append("(" + " OR ".join(parts) + ")")
        out += f"WHEN {' AND '.join(conds)} THEN '{name}' "
    return out + "ELSE 'English' END"


#: Texts in scripts that the tables lack, each with its language: every script, mixtures, and letters or words that decide.
SPOKEN = [
    ("机器学习是人工智能的分支", "Chinese"), ("これは日本語の文です", "Japanese"), ("漢字とかな", "Japanese"), ("한국어 문장입니다", "Korean"), ("هذا نص عربي في المكتبة", "Arabic"), ("این یک متن فارسی است که برای آزمایش است", "Persian"),
    ("זהו משפט בעברית", "Hebrew"), ("นี่คือประโยคภาษาไทย", "Thai"), ("यह हिन्दी वाक्य है", "Hindi"), ("এটি একটি বাক্য", "Bengali"), ("இது ஒரு வாக்கியம்", "Tamil"), ("ఇది ఒక వాక్యం", "Telugu"), ("ಇದು ಒಂದು ವಾಕ್ಯ", "Kannada"),
    ("ഇതൊരു വാക്യമാണ്", "Malayalam"), ("આ એક વાક્ય છે", "Gujarati"), ("ਇਹ ਇੱਕ ਵਾਕ ਹੈ", "Punjabi"), ("ဒါက စာကြောင်း", "Burmese"), ("នេះជាប្រយោគ", "Khmer"), ("ນີ້ແມ່ນປະໂຫຍກ", "Lao"), ("ეს არის წინადადება", "Georgian"),
    ("Սա նախադասություն է", "Armenian"), ("ይህ ዓረፍተ ነገር ነው", "Amharic"), ("འདི་ཚིག་གྲུབ་ཡིན", "Tibetan"), ("මෙය වාක්‍යයකි", "Sinhala"), ("Это предложение на русском", "Russian"), ("Αυτή είναι μια πρόταση", "Greek"),
    ("一 word alone", "English"), ("", "English"), ("12345 !?", "English"), ("Đây là tiếng Việt", "Vietnamese"), ("Zażółć gęślą jaźń", "Polish"), ("Příliš žluťoučký kůň", "Czech"),
]
SPOKEN_SQL = ", ".join(f"({-1 - i}, '{t}', '{name}')" for i, (t, name) in enumerate(SPOKEN))


def _spoken(spark):
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1 - i).cast("long").alias("doc_id"), F.lit("").alias("lang"), F.lit(t).alias("text")) for i, (t, _) in enumerate(SPOKEN)))).alias("x")).select("x.*")


@query("detect_language", f"SELECT doc_id, lang, {_latin_sql()} AS language FROM (SELECT doc_id, lang, lower(text) AS l FROM documents) UNION ALL SELECT id, '', name FROM (VALUES {SPOKEN_SQL}) v(id, t, name)")
def detect_language(spark, sf_dir):
    """Language of every document, and of texts in all scripts; the SQL has the Latin cascade for the tables, which hold no
    other script, and the languages of the added texts as they are known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").union(_spoken(spark))
    return docs.select("doc_id", "lang", L.detect_language(F.col("text")).alias("language"))


@query("language_confusion", f"SELECT lang, {_latin_sql()} AS language, count(*) AS n FROM (SELECT lang, lower(text) AS l FROM documents) GROUP BY 1, 2")
def language_confusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", L.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


SCRIPT_SQL = ", ".join(f"len(regexp_extract_all(text, '[{cls}]'))::INT AS \"{name.lower()}\"" for name, cls in L.SCRIPTS)


@query("script_counts", f"SELECT doc_id, {SCRIPT_SQL} FROM (SELECT doc_id, text FROM documents UNION ALL SELECT id, t FROM (VALUES {SPOKEN_SQL}) v(id, t, name))")
def script_counts(spark, sf_dir):
    """Characters of each of the 24 scripts in every document and in texts that hold them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(_spoken(spark).select("doc_id", "text"))
    c = docs.select("doc_id", L.script_counts(F.col("text")).alias("m"))
    return c.select("doc_id", *(F.col("m")[name].cast("int").alias(name.lower()) for name, _ in L.SCRIPTS))


@query(
    "url_parts",
    """SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host, regexp_extract(url, '([^/]*)$', 1) AS name,
  regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, regexp_matches(url, '^(/|[A-Za-z]:[/])') AS absolute,
  substr(regexp_replace(regexp_replace(trim(lower(t)), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), 1, 50) AS slug FROM (SELECT *, 'a ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' z' AS t FROM pages)""",
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    title = F.concat(F.lit("a "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" z"))
    return table(spark, sf_dir, "pages").select("page_id", T.host_name(url).alias("host"), T.file_name(url).alias("name"), T.file_stem(url).alias("stem"), T.is_absolute_path(url).alias("absolute"), T.title_slug(title).alias("slug"))


@query(
    "page_plain_text",
    """SELECT page_id, left(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10) || chr(10)), 50000) AS text FROM (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<!--.*?-->', '', 'gs'), '<script\\b.*?</script\\s*>', '', 'gsi'), '<style\\b.*?</style\\s*>', '', 'gsi'), '<nav\\b.*?</nav\\s*>', '', 'gsi'), '<header\\b.*?</header\\s*>', '', 'gsi'), '<footer\\b.*?</footer\\s*>', '', 'gsi'), '<head\\b.*?</head\\s*>', '', 'gsi'),
      '<[a-z]+[^>]*\\bclass="(?:sidebar|ad|comments)"[^>]*>.*?</[a-z]+\\s*>', '', 'gsi'),
    '<(?:br|/p|/div|/li|/h[1-6]|/tr|/article|/section|/ul)\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&#x27;', '''') AS t FROM pages)""",
)
def page_plain_text(spark, sf_dir):
    """Web pages as text without scripts, navigation and boilerplate."""
    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


#: Openers of every family, and what only looks like one.
OPENERS = [
    ("hi", True), ("Hello there!", True), ("hey everyone", True), ("Good evening.", True), ("what's up?", True), ("WASSUP", True), ("greetings", True), ("你好呀！", True), ("早上好", True), ("在吗？", True), ("こんにちは。", True), ("안녕하세요", True),
    ("Hola!!", True), ("привет", True), ("olá ~", True), ("hi hello", False), ("hello, what is attention?", False), ("good", False), ("", False), ("?!", False), ("你好，什么是注意力", False), ("this", False),
]
OPENERS_SQL = ", ".join("({}, '{}', {})".format(-1 - i, t.replace("'", "''"), ok) for i, (t, ok) in enumerate(OPENERS))


@query("greetings", f"SELECT conv_id, turn, FALSE AS greeting FROM conversations UNION ALL SELECT id, 0, ok FROM (VALUES {OPENERS_SQL}) v(id, t, ok)")
def greetings(spark, sf_dir):
    """Turns, none of which is a greeting, and openers."""
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1 - i).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(t).alias("text")) for i, (t, _) in enumerate(OPENERS)))).alias("x")).select("x.*")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").union(more)
    return every.select("conv_id", "turn", L.is_greeting(F.col("text")).alias("greeting"))


@query(
    "normalised_keys",
    """SELECT doc_id, md5(trim(lower(regexp_replace(regexp_replace('Missing page: ' || text, '^(?i)missing[\\s-]?page[:：]\\s*', ''), '\\s+', ' ', 'g')))) AS review_title,
  md5(regexp_replace(lower(text), '[\\s\\-_]+', '', 'g')) AS link_key, array_to_string(list_sort([lower(source), lower(lang), 'b']), ',') AS group_key,
  CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS summary, sha256(text) AS hash FROM documents""",
)
def normalised_keys(spark, sf_dir):
    """Keys of whole texts; the summary is cut because that is what it is."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.review_title(F.concat(F.lit("Missing page: "), t))).alias("review_title"), F.md5(T.link_key(t)).alias("link_key"),
        T.group_key(F.array("source", "lang", F.lit("B"))).alias("group_key"), T.truncated(t, 60).alias("summary"), F.sha2("text", 256).alias("hash"),
    )
