"""Documents in files as sections: text, markdown and slide decks; and staged uploads."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import clean, pack_paragraphs, sections_of
from .tables import MAX_BYTES, check_uploads

SECTIONS = "file string, section_no int, section_title string, page_no int, chunk_text string"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _paragraph_text(node: ElementTree.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p")).strip()


def _shapes(node: ElementTree.Element) -> Iterator[tuple[bool, str]]:
    """(is title, text) of shapes, groups included; a table is one text of piped rows."""
    for s in node:
        if s.tag == f"{_P}grpSp":
            yield from _shapes(s)
        elif s.tag == f"{_P}graphicFrame":
            rows = [" | ".join(_paragraph_text(c) for c in r.iter(f"{_A}tc")) for r in s.iter(f"{_A}tr")]
            if rows:
                yield False, "\n".join(rows)
        elif s.tag == f"{_P}sp":
            ph = s.find(f".//{_P}ph")
            yield ph is not None and ph.get("type") in ("title", "ctrTitle"), _paragraph_text(s)


def deck(data: bytes, notes: bool = False) -> list[tuple[str | None, int, str]]:
    """(title, slide from 1, body with the title first) of each slide that has text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for k, name in enumerate(names, 1):
            tree = ElementTree.fromstring(z.read(name)).find(f".//{_P}spTree")
            parts = [x for x in _shapes(tree) if x[1]] if tree is not None else []
            title = next((t for is_title, t in parts if is_title), None)
            body = [t for is_title, t in parts if not is_title]
            side = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes and side in z.namelist():
                body += [t for _, t in _shapes(ElementTree.fromstring(z.read(side)).find(f".//{_P}spTree")) if t]
            text = "\n".join(filter(None, [title, *body]))
            if text.strip():
                out.append((title, k, text))
    return out


def plain(data: bytes) -> list[tuple[str | None, int | None, str]]:
    """Sections under header lines if there is one, else paragraphs."""
    text = data.decode("utf-8", "replace")
    if re.search(r"^#{1,6}\s+", text, re.M):
        return [(t, None, b) for t, b in sections_of(text)]
    return [(None, None, p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]


def read_chunks(spark: SparkSession, path: str, glob: str = "*", size: int = 1500, overlap: int = 200, notes: bool = False) -> DataFrame:
    """Cleaned chunks of the files under ``path``, numbered in each file; sections that cleaning empties go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                found = deck(data, notes) if name.lower().endswith(".pptx") else plain(data)
                rows = []
                for title, page, body in found:
                    body = clean(body)
                    rows += [(clean(title) if title else None, page, piece) for piece in pack_paragraphs(body, size, overlap)] if body else []
                out = pd.DataFrame([(name.rsplit("/", 1)[-1], k, *r) for k, r in enumerate(rows)], columns=["file", "section_no", "section_title", "page_no", "chunk_text"])
                yield out.astype({"section_no": "int32", "page_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SECTIONS)


def under(root: str, path: str) -> str:
    """The folder or file ``path`` under ``root``; an error if it lies outside.

    Folders are taken apart by name, so a path can't climb out; on a local
    file system links are followed first, so none can lead out either.
    """
    parts: list[str] = []
    for p in (path or "").strip("/").split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"{path} lies outside the root")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    full = "/".join([root.rstrip("/"), *parts])
    local = full.removeprefix("file://").removeprefix("file:")
    if "://" not in local:
        top, real = os.path.realpath(root.removeprefix("file://").removeprefix("file:")), os.path.realpath(local)
        if real != top and not real.startswith(top.rstrip(os.sep) + os.sep):
            raise ValueError(f"{path} lies outside the root")
    return full


def listing(spark: SparkSession, root: str, path: str = "", glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under a folder of the root; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(under(root, path))
    return files.select("path", "length", "modificationTime")


def read_under(spark: SparkSession, root: str, path: str, extensions: tuple[str, ...], most: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows of files under a folder of the root, with the problem that an upload of each would have."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(under(root, path))
    return check_uploads(files, extensions, most)


def stage(uploads: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Staging table after new uploads: expired rows go, the rest stays."""
    return existing.filter(F.col("expires_at") > now).unionByName(uploads)


def staged(staging: DataFrame, upload_id: str, owner: str, kind: str, now: Column) -> DataFrame:
    """The row of an upload if it is its owner's, of the kind, and live."""
    return staging.filter((F.col("upload_id") == upload_id) & (F.col("owner") == owner) & (F.col("kind") == kind) & (F.col("expires_at") > now))
