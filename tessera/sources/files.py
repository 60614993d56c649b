"""Files as tables: listings, typed reads, extraction caches and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import breadcrumb, file_category, file_name, normalize_path
from tessera.operators.hygiene import stale_extractions
from tessera.sources.office import as_markdown

MAX_DEPTH = 30
#: Extensions that an import takes: fixed values.
IMPORTED = ("md", "mdx", "txt", "pdf", "docx", "pptx", "xlsx", "xls", "csv", "json", "html", "htm", "rtf", "xml", "yaml", "yml")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of all files below a folder, read where they are needed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def visible(path: Column) -> Column:
    """No part of the path starts with a dot."""
    return ~path.rlike(r"(^|/)\.[^/]")


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, with or without a file-system scheme."""
    plain = F.regexp_replace(normalize_path(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")), "/$", "")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, F.length(plain))).otherwise(plain)


def listing(files: DataFrame, root: str) -> DataFrame:
    """Files and their folders as rows ``path, name, is_dir, depth``: hidden entries left out, folders first."""
    rel = files.select(relative_to(F.col("path"), root).alias("path")).where(visible(F.col("path")))
    parts = F.split("path", "/")
    folders = rel.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    every = folders.withColumn("is_dir", F.lit(True)).union(rel.withColumn("is_dir", F.lit(False)))
    out = every.select("path", file_name(F.col("path")).alias("name"), "is_dir", F.size(F.split("path", "/")).alias("depth"))
    return out.where(F.col("depth") <= MAX_DEPTH).orderBy(F.desc("is_dir"), "name", "path")


def pages(files: DataFrame, root: str) -> DataFrame:
    """``path, file_name, content`` of markdown files."""
    path = relative_to(F.col("path"), root)
    md = files.where(F.col("path").rlike(r"\.md$") & visible(relative_to(F.col("path"), root)))
    return md.select(path.alias("path"), file_name(path).alias("file_name"), F.col("content").cast("string").alias("content"))


def read_text(files: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """``path, category, text``: an extraction at least as new as the file (``path, modificationTime, text``), office files
    as markdown, media by name, and all else as UTF-8. PDF needs an extractor that is not part of this library."""
    todo = files
    done = None
    if cached is not None:
        stale = stale_extractions(files, cached)
        done = files.join(stale.select("path"), "path", "left_anti").select("path").join(cached.select("path", "text"), "path")
        todo = stale
    kind = file_category(F.col("path"))
    office = F.col("path").rlike(r"(?i)\.(docx|pptx|xlsx|odt|ods|odp)$")
    media = kind.isin("image", "video", "audio", "pdf", "document") & ~office
    text = F.when(office, as_markdown("path", "content")).when(media, F.format_string("[%s: %s]", kind, file_name(F.col("path")))).otherwise(F.col("content").cast("string"))
    fresh = todo.select("path", text.alias("text"))
    out = fresh.unionByName(done) if done is not None else fresh
    return out.withColumn("category", file_category(F.col("path")))


def encoded(files: DataFrame) -> DataFrame:
    mime = F.lit("application/octet-stream")
    for exts, m in (("png", "image/png"), ("jpg|jpeg", "image/jpeg"), ("gif", "image/gif"), ("webp", "image/webp"), ("svg", "image/svg+xml"), ("pdf", "application/pdf")):
        mime = F.when(F.col("path").rlike(rf"(?i)\.({exts})$"), m).otherwise(mime)
    return files.select("path", F.base64("content").alias("base64"), mime.alias("mime"))


def import_tasks(files: DataFrame, root: str) -> DataFrame:
    """One task per file of a known kind, with its folders as a breadcrumb."""
    rel = relative_to(F.col("path"), root)
    known = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMPORTED))
    return known.select(rel.alias("path"), breadcrumb(rel).alias("breadcrumb")).where(visible(F.col("path")))


def file_counts(listed: DataFrame) -> DataFrame:
    """Files below each folder; folders without any are not part of the result."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return listed.where(~F.col("is_dir") & (F.size(parts) > 1)).select(F.explode(up).alias("path")).groupBy("path").agg(F.count("*").alias("n_files"))
