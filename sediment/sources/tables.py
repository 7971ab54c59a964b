"""Tables in files: delimited text of unknown encoding, spreadsheets; and checks of uploads.

Files are uploads with a cap on their size; each is read whole inside a task,
many files in parallel. Where encoding and separator are known, Spark's own
CSV reader is the better source.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in the order in which they are tried, and separators that are looked for.
ENCODINGS = ("utf-8-sig", "cp949", "utf-8", "latin-1")
SEPARATORS = ",;\t|"
MAX_BYTES = 64 << 20
ROWS = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def decode(data: bytes) -> str:
    for e in ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes anything")


def delimited(data: bytes, name: str) -> list[list[str]]:
    text = decode(data)
    if name.lower().endswith(".tsv"):
        sep = "\t"
    else:
        try:
            sep = csv.Sniffer().sniff(text[:8192], SEPARATORS).delimiter
        except csv.Error:
            sep = ","
    csv.field_size_limit(MAX_BYTES)
    return [[c.strip() for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep)]


def _unescaped(value: str) -> str:
    """Characters that XML can't hold stand as _xHHHH_ in cells of text."""
    return re.sub("_x(?![dD][89a-fA-F])([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), value) if "_x" in value else value


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet, read as a stream; rows left out of the file come empty, so that numbers match the sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_unescaped("".join(t.text or "" for t in si.iter(f"{_NS}t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        n, inside = 0, []
        with z.open(sheets[0]) as sheet:
            for event, row in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start":
                    inside.append(row)
                    continue
                inside.pop()
                if row.tag != f"{_NS}row":
                    continue
                for _ in range(n, int(row.get("r", n + 1)) - 1):
                    n += 1
                    yield []
                n += 1
                yield _cells(row, shared)
                inside[-1].remove(row)  # what was read goes


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for c in row.iter(f"{_NS}c"):
        at = 0
        for ch in re.match("[A-Z]*", c.get("r", "")).group():
            at = at * 26 + ord(ch) - 64
        cells += [""] * (max(at, len(cells) + 1) - len(cells))
        v = c.find(f"{_NS}v")
        value = _unescaped("".join(t.text or "" for t in c.iter(f"{_NS}t"))) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
        cells[max(at, 1) - 1] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
    return cells


def spreadsheet(data: bytes) -> list[list[str]]:
    """Values of the first sheet; rows left out of the file come back empty, so that numbers match the sheet."""
    return list(_sheet_rows(data))


#: Rows of a file that a reader holds at once.
HELD = 2048


def read_tables(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, row_no, cells) of delimited files and spreadsheets under ``path``; every cell is trimmed text.

    A task holds the bytes of one file (a spreadsheet's are compressed) and ``HELD`` rows of it.
    """

    def read(name: str, data: bytes) -> Iterator[pd.DataFrame]:
        rows = iter(_sheet_rows(data) if name.lower().endswith((".xlsx", ".xlsm")) else delimited(data, name))
        no = 0
        while some := list(islice(rows, HELD)):
            yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "row_no": range(no, no + len(some)), "cells": some}).astype({"row_no": "int32"})
            no += len(some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                yield from read(name, data)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, ROWS)


def preview(rows: DataFrame, file: str, header: int, n: int = 5) -> DataFrame:
    """The header and the first ``n`` rows below it."""
    own = rows.filter((F.col("file") == file) & (F.col("row_no") >= header))
    return own.orderBy("row_no").limit(n + 1)


def check_uploads(files: DataFrame, extensions: tuple[str, ...], most: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows with ``problem``: extension, empty, size, or a content that its extension belies; null if all is well."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    head = F.substring("content", 1, 4)
    zipped = ext.isin(".xlsx", ".xlsm", ".pptx", ".docx") & (head != F.lit(b"PK\x03\x04"))
    pdf = (ext == ".pdf") & (head != F.lit(b"%PDF"))
    why = F.when(~ext.isin(*extensions), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > most, "size").when(zipped | pdf, "content")
    return files.withColumn("problem", why)
