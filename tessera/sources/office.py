"""Office documents as markdown, and the images inside them, with the standard library alone."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd

from tessera.functions.arrow import arrow

MOST_IMAGES, LEAST_SIDE = 500, 100
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def _run(run) -> str:
    text = "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else "" for t in run.iter())
    style = run.find(_W + "rPr")
    if style is None or not text.strip():
        return text
    for tag, mark in (("b", "**"), ("i", "*")):
        if (on := style.find(_W + tag)) is not None and on.get(_W + "val") not in ("0", "false"):
            text = f"{mark}{text}{mark}"
    return text


def _paragraph(p) -> str:
    text = "".join(_run(r) for r in p.iter(_W + "r")).strip()
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = style.get(_W + "val", "") if style is not None else ""
    if text and (m := re.fullmatch(r"(?i)heading\s*([1-6])|title", name)):
        return "#" * int(m[1] or 1) + " " + text
    return "- " + text if text and p.find(f"{_W}pPr/{_W}numPr") is not None else text


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    out = []
    for block in body if body is not None else ():
        if block.tag == _W + "p":
            out.append(_paragraph(block))
        elif block.tag == _W + "tbl":
            out.append(_table([[" ".join(filter(None, map(_paragraph, c.iter(_W + "p")))) for c in r.findall(_W + "tc")] for r in block.findall(_W + "tr")]))
    return "\n\n".join(filter(None, out))


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


def pptx(data: bytes) -> str:
    """Slides in numeric order; a slide's first paragraph is bold, the others are bullets."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, name in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"):
            texts = ["".join(t.text or "" for t in p.iter(_A + "t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(_A + "p")]
            texts = list(filter(None, texts))
            out.append(f"## Slide {k}\n\n" + "\n".join(f"**{t}**\n" if i == 0 else f"- {t}" for i, t in enumerate(texts)))
    return "\n\n".join(x.rstrip() for x in out)


def _cell(c, shared: list[str]) -> str:
    kind, v = c.get("t"), c.find(_S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_S + "t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    try:
        x = float(v.text)
        return v.text if kind else str(int(x)) if x.is_integer() else f"{x:.2f}"
    except ValueError:
        return v.text


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx(data: bytes) -> str:
    """A table per sheet; integral numbers print as integers, others with two decimals; sheets are named if many."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in s.iter(_S + "t")) for s in read("xl/sharedStrings.xml").findall(_S + "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        sheets = [(s.get("name"), targets.get(s.get(_R + "id"), "")) for s in read("xl/workbook.xml").iter(_S + "sheet")]
        out = []
        for name, target in sheets:
            rows = []
            for r in read(f"xl/{target}").iter(_S + "row") if f"xl/{target}" in names else ():
                row: list[str] = []
                for c in r.findall(_S + "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(row)
                    row += [""] * (at - len(row)) + [_cell(c, shared)]
                rows.append(row)
            if table := _table(rows):
                out.append((f"## {name}\n\n" if len(sheets) > 1 else "") + table)
    return "\n\n".join(out)


def odf(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = z.read("content.xml").decode("utf-8", "replace")
    text = re.sub(r"<[^>]+>", "\n", text)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'")):
        text = text.replace(entity, char)
    return "\n\n".join(x.strip() for x in text.split("\n") if x.strip())


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": odf, "ods": odf, "odp": odf}


def document_markdown(path: str, data: bytes | None) -> str | None:
    """Markdown of an office file; a broken one gives a note instead of failing the job."""
    if data is None:
        return None
    try:
        return READERS[path.rsplit(".", 1)[-1].lower()](bytes(data))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, IndexError, ValueError) as e:
        return f"[unreadable: {type(e).__name__}]"


@arrow("string")
def as_markdown(path: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([document_markdown(p, c) for p, c in zip(path, content)])


def _size(data: bytes) -> tuple[int, int]:
    """Width and height of PNG, GIF and JPEG headers; zeros for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"GIF":
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def images(data: bytes | None) -> list[dict]:
    """Pictures of an office file: ``index, name, mime, page, width, height, sha256, content``; small ones are skipped,
    slides name the page of presentations."""
    out, pages = [], {}
    try:
        z = zipfile.ZipFile(io.BytesIO(bytes(data or b"")))
    except zipfile.BadZipFile:
        return []
    with z:
        for k, name in _numbered(z.namelist(), r"ppt/slides/_rels/slide(\d+)\.xml\.rels"):
            for target in re.findall(r'Target="\.\./media/([^"]+)"', z.read(name).decode("utf-8", "replace")):
                pages.setdefault(target, k)
        for name in sorted(z.namelist()):
            m = re.search(r"(?i)(?:^|/)(?:media|Pictures)/([^/]+\.(png|jpe?g|gif))$", name)
            if not m or len(out) >= MOST_IMAGES:
                continue
            raw = z.read(name)
            w, h = _size(raw)
            if min(w, h) >= LEAST_SIDE:
                out.append({"index": len(out) + 1, "name": m[1], "mime": "image/" + m[2].lower().replace("jpg", "jpeg"), "page": pages.get(m[1]), "width": w, "height": h, "sha256": hashlib.sha256(raw).hexdigest(), "content": raw})
    return out


@arrow("array<struct<index:int,name:string,mime:string,page:int,width:int,height:int,sha256:string,content:binary>>")
def extracted_images(content: pd.Series) -> pd.Series:
    return content.map(images)
