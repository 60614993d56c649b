"""Column expressions over strings: paths, slugs, keys, links, titles. All stay inside the JVM.

Lengths and positions count code points. Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a link: a fixed value.
WIKILINK = r"\[\[([^\]|]+?)(?:\|[^\]]+?)?\]\]"
#: Punctuation that separates or surrounds query terms: a fixed value.
QUERY_PUNCTUATION = r"\s,，。！？、；：\"'（）()\-_/\\·~～…"
#: Prefixes of review titles, by kind: fixed values.
REVIEW_PREFIXES = r"(?i)^(missing[\s-]?page[:：]\s*|duplicate[\s-]?page[:：]\s*|possible[\s-]?duplicate[:：]\s*|缺失页面[:：]\s*|缺少页面[:：]\s*|重复页面[:：]\s*|疑似重复[:：]\s*)"


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes, runs of slashes one."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")


def join_path(*parts: Column) -> Column:
    return normalize_path(F.concat_ws("/", *parts))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def file_stem(path: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def relative_path(path: Column, base: Column) -> Column:
    p, b = normalize_path(path), F.regexp_replace(normalize_path(base), "/$", "")
    return F.when(F.startswith(p, F.concat(b, F.lit("/"))), F.substring(p, F.length(b) + 2, F.length(p))).otherwise(p)


def is_absolute_path(path: Column) -> Column:
    return path.rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def is_safe_page_path(path: Column) -> Column:
    """Under ``wiki/``, no parent steps, not absolute, no control characters."""
    p = F.translate(path, "\\", "/")
    return F.coalesce(p.rlike("^wiki/.") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~is_absolute_path(path) & ~path.rlike(r"[\x00-\x1f]"), F.lit(False))


def is_page_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[\p{L}\p{N}_.-]{1,256}$"), F.lit(False))


def title_slug(title: Column, most: int = 50) -> Column:
    """ASCII slug: other characters go, white space becomes a hyphen."""
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.trim(kept), r"\s+", "-"), 1, most)


def unicode_slug(title: Column, most: int = 50) -> Column:
    """Slug of letters and digits of any script; ``query`` where nothing is left. Compatibility forms (NFKC) are
    expected to be normalised before."""
    s = F.regexp_replace(F.trim(title), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}-]", ""), "-+", "-")
    s = F.substring(F.lower(F.regexp_replace(s, "^-|-$", "")), 1, most)
    return F.when(F.length(s) > 0, s).otherwise(F.lit("query"))


def query_file_name(title: Column, now: Column) -> Column:
    return F.concat(unicode_slug(title), F.lit("-"), F.date_format(now, "yyyy-MM-dd-HHmmss"), F.lit(".md"))


def review_title(title: Column) -> Column:
    """Title without its kind's prefix, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, REVIEW_PREFIXES, ""), r"\s+", " ")))


def link_key(value: Column) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(value), r"[\s\-_]+", "")


def group_key(slugs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(slugs, F.lower)), ",")


def link_id(value: Column) -> Column:
    """Lower case, white space as hyphens: how link targets name pages."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", "-")


def wikilinks(content: Column) -> Column:
    """Targets of all links in order, repeats kept."""
    return F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def unwrap_wikilink(value: Column) -> Column:
    """``slug`` and ``label`` of a link, or of plain text."""
    slug = F.regexp_extract(value, r"^\s*\[\[([^\]|]+?)(?:\|([^\]]+))?\]\]\s*$", 1)
    label = F.regexp_extract(value, r"^\s*\[\[([^\]|]+?)(?:\|([^\]]+))?\]\]\s*$", 2)
    plain = F.trim(value)
    s = F.when(F.length(slug) > 0, F.trim(slug)).otherwise(plain)
    return F.struct(s.alias("slug"), F.when(F.length(label) > 0, F.trim(label)).otherwise(s).alias("label"))


def strip_thinking(text: Column) -> Column:
    """Without complete and unclosed reasoning blocks."""
    closed = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>\s*", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think(?:ing)?>.*$", ""))


def thinking(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<think(?:ing)?>(.*?)(?:</think(?:ing)?>|$)"), F.lit(1))


def host_name(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def decode_entities(text: Column) -> Column:
    """Seven entities, the ampersand first (so a doubly escaped one is decoded twice)."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def caption_text(text: Column) -> Column:
    """A caption that can stand as an image's alternative text: line ends become spaces, closing brackets round ones."""
    return F.trim(F.translate(F.regexp_replace(text, r"[\r\n]+", " "), "]", ")"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def image_src(src: Column, base: Column) -> Column:
    """Web, data and absolute sources stay; relative ones are put under the pages' folder of the project at ``base``. Where
    there is no project (null), or no source, it stays as it is."""
    free = src.rlike(r"^(?i)(https?|data|blob|file|tauri):") | src.rlike(r"^(/|\\\\|[A-Za-z]:)")
    return F.when(free | base.isNull() | (src == ""), src).otherwise(F.concat(normalize_path(base), F.lit("/wiki/"), F.regexp_replace(src, r"^\./", "")))


def media_slug(url: Column) -> Column:
    """The folder below ``media`` that an image lies in; it bears the stem of the image's source. Null for others."""
    return F.nullif(F.regexp_extract(F.translate(url, "\\", "/"), "(?:^|/)media/([^/]+)/", 1), F.lit(""))


def quoted_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def front_matter(content: Column) -> Column:
    return F.regexp_extract(content, r"\A---\r?\n([\s\S]*?)\r?\n---", 1)


def without_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, r"\A---\r?\n[\s\S]*?(?:^|\n)---[ \t]*(?:\n|\z)", "")


def front_matter_value(content: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(front_matter(content), rf"(?m)^{name}:[ \t]*[\"']?(.+?)[\"']?[ \t]*$", 1))


def page_title(content: Column, name: Column) -> Column:
    """Title of the front matter, else the first heading, else the file name with spaces for hyphens."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#[ \t]+(.+)$", 1))
    return F.coalesce(F.nullif(front_matter_value(content, "title"), F.lit("")), F.nullif(heading, F.lit("")), F.translate(F.regexp_replace(name, r"\.md$", ""), "-", " "))


def page_type(content: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(front_matter_value(content, "type")), F.lit("")), F.lit("other"))


def list_field(content: Column, name: str) -> Column:
    """A list of the front matter, written inline or as a block; quotes are stripped, empty entries dropped."""
    fm = front_matter(content)
    inline = F.split(F.regexp_extract(fm, rf"(?m)^{name}:[ \t]*\[([^\]]*)\]", 1), ",")
    block = F.split(F.regexp_extract(fm, rf"(?m)^{name}:[ \t]*\n((?:[ \t]+-[^\n]*(?:\n|\z))+)", 1), "\n")
    raw = F.concat(inline, F.transform(block, lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]*", "")))
    clean = F.transform(raw, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return F.filter(clean, lambda x: F.length(x) > 0)


def page_sources(content: Column) -> Column:
    return list_field(content, "sources")


#: Extensions of the file categories: fixed values.
CATEGORIES = {
    "markdown": "md mdx markdown",
    "text": "txt log rst",
    "code": "ts tsx js jsx py rs go java c cpp h hpp cs rb php swift kt sh css html sql",
    "data": "json yaml yml toml csv tsv xml jsonl ndjson",
    "pdf": "pdf",
    "document": "doc docx xls xlsx ppt pptx odt ods odp rtf pages numbers key",
    "image": "png jpg jpeg gif webp bmp svg ico avif tiff",
    "video": "mp4 webm mov avi mkv",
    "audio": "mp3 wav ogg flac m4a aac",
}


def file_category(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("unknown")
    for kind, exts in reversed(CATEGORIES.items()):
        out = F.when(ext.isin(*exts.split()), kind).otherwise(out)
    return out


#: Labels of page types: fixed values.
TYPE_LABELS = {"entity": "Entity", "concept": "Concept", "query": "Query", "source": "Source", "thesis": "Thesis", "finding": "Finding", "event": "Event", "overview": "Overview"}


def type_label(type_: Column) -> Column:
    """What a page of a type is called; ``Page`` for other types and none."""
    out = F.lit("Page")
    for kind, label in TYPE_LABELS.items():
        out = F.when(F.lower(F.trim(type_)) == kind, label).otherwise(out)
    return out


#: Folders whose pages without a type have that of the folder: fixed values.
TYPE_FOLDERS = {"entities": "entity", "concepts": "concept", "sources": "source", "queries": "query", "comparisons": "comparison", "synthesis": "synthesis"}


def page_type_or_folder(content: Column, path: Column) -> Column:
    """The type of the front matter, else that of the first known folder of the path, else ``other``."""
    out = F.when(file_name(path) == "overview.md", "overview").otherwise("other")
    for folder, kind in reversed(TYPE_FOLDERS.items()):
        out = F.when(F.contains(path, F.lit(f"/{folder}/")), kind).otherwise(out)
    return F.when(page_type(content) != "other", page_type(content)).otherwise(out)


def breadcrumb(path: Column) -> Column:
    """Folders of a path joined by ``>``."""
    parts = F.split(normalize_path(path), "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), " > ")
