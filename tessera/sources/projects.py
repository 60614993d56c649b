"""Project folders: scaffolds, copies and exports through Spark's file systems, wherever they lie.

The driver makes these calls; what it moves is streamed or taken a partition at a time, never held as a whole. Large
results stay tables; an export is for folders that people open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a new project: fixed values.
FOLDERS = ("raw/sources", "raw/assets", "wiki/entities", "wiki/concepts", "wiki/sources", "wiki/queries", "wiki/comparisons", "wiki/synthesis")
IDENTITY = ".project.json"


class Folder:
    """A folder on any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def write(self, name: str, content: bytes) -> None:
        """A file with its folders, replaced if it was there."""
        out = self._fs.create(self.at(name), True)
        out.write(bytearray(content))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self.at(name), True)

    def files(self, name: str = "", hidden: bool = False) -> Iterator[str]:
        """Paths of all files below, relative to the folder; entries whose name begins with a dot only if asked for."""
        for f in sorted(self._fs.listStatus(self.at(name)), key=lambda f: f.getPath().getName()):
            own = f.getPath().getName()
            if own.startswith(".") and not hidden:
                continue
            rel = f"{name}/{own}".lstrip("/")
            if f.isDirectory():
                yield from self.files(rel, hidden)
            else:
                yield rel

    def copy_to(self, other: Folder) -> list[str]:
        """All files copied, but for those that begin with a dot; returns their relative paths."""
        done, copy = [], self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy
        for name in self.files():
            other._fs.mkdirs(other.at(name).getParent())
            copy(self._fs, self.at(name), other._fs, other.at(name), False, self._conf)
            done.append(name)
        return done


def scaffold(folder: Folder, name: str, day: str) -> list[str]:
    """The folders and first pages of a project; returns the pages. A project that exists is an error."""
    if folder.exists("wiki"):
        raise FileExistsError(folder.root)
    for f in FOLDERS:
        folder.make(f)
    types = "\n".join(f"- {f.split('/')[1]}" for f in FOLDERS if f.startswith("wiki/"))
    pages = {
        "schema.md": f"# Schema of {name}\n\nPages are markdown files in these folders of `wiki`:\n\n{types}\n",
        "purpose.md": f"# Purpose of {name}\n\nWhat is this collection for?\n",
        "wiki/index.md": "# Index\n",
        "wiki/log.md": f"# Log\n\n## {day}\n\n- Project created\n",
        "wiki/overview.md": f"---\ntype: overview\ntitle: {name}\ncreated: {day}\n---\n\n# {name}\n",
    }
    for path, text in pages.items():
        folder.write(path, text.encode())
    return sorted(pages)


def project_id(folder: Folder) -> str:
    """The identity that a project keeps in its folder; made where it is missing or unreadable."""
    if folder.exists(IDENTITY):
        try:
            found = json.loads(folder.read(IDENTITY)).get("id")
            if isinstance(found, str) and found:
                return found
        except (ValueError, AttributeError):
            pass
    new = str(uuid.uuid4())
    folder.write(IDENTITY, json.dumps({"id": new}).encode())
    return new


def export(files: DataFrame, folder: Folder) -> int:
    """Write rows (``path, content`` as bytes) as files, one partition after the other; returns how many."""
    n = 0
    for r in files.select("path", "content").toLocalIterator():
        folder.write(r.path, bytes(r.content))
        n += 1
    return n


def saved_images(images: DataFrame) -> DataFrame:
    """``path, rel_path, sha256, content`` of extracted images (``slug, index, ext, content``): where they are saved, and how
    pages name them. Numbers start from one."""
    rel = F.concat(F.lit("media/"), "slug", F.lit("/img-"), (F.col("index") + 1).cast("string"), F.lit("."), "ext")
    return images.select(F.concat(F.lit("wiki/"), rel).alias("path"), rel.alias("rel_path"), F.sha2("content", 256).alias("sha256"), "content")


def tree_without_empty(listed: DataFrame) -> DataFrame:
    """A listing (``path, is_dir``) without hidden entries, and without folders that hold no file below."""
    from tessera.sources.files import file_counts, visible

    shown = listed.where(visible(F.col("path")))
    full = file_counts(shown).select("path")
    return shown.where(~F.col("is_dir")).unionByName(shown.where("is_dir").join(full, "path", "left_semi").select(*shown.columns))


def source_of_image(images: DataFrame, sources: DataFrame) -> DataFrame:
    """``url, path``: the first source file (path order) whose stem names the media folder that an image lies in, or null."""
    from tessera.functions.text import file_stem, media_slug

    first = sources.groupBy(file_stem(F.col("path")).alias("slug")).agg(F.min("path").alias("path"))
    return images.select("url", media_slug(F.col("url")).alias("slug")).join(first, "slug", "left").select("url", "path")
