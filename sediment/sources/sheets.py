"""Spreadsheets as a sink: ``df.write.format("sheet")``, one workbook a task, with drop-down lists.

Rows stream from Arrow batches through XML into a zip on a file system that
pyarrow opens (local or NFS paths, s3, gs, hdfs), so a task holds one batch.
Workbooks are written under a hidden folder of the job and moved when the job
commits; an aborted job deletes that folder, and with it what failed, lost or
repeated tasks left.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: rows a sheet holds, characters of a list in a formula, namespaces and fixed parts.
MOST_ROWS = 1_048_576
MOST_LIST = 255
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>'
)
#: What XML can't hold or changes, and what would be read as such an escape.
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def column_letters(k: int) -> str:
    """Name of the column ``k``, from 0."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(value: str) -> str:
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))


def _row(n: int, cells: list[str | None], style: int) -> str:
    """One row; null and empty cells are left out."""
    own = "".join(f'<c r="{column_letters(k)}{n}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>' for k, v in enumerate(cells) if v)
    return f'<row r="{n}">{own}</row>'


def _validations(names: list[str], dropdowns: dict[str, list[str]], free: set[str], last: int) -> str:
    """Lists of values for the named columns from the second row to ``last``; a free column only warns."""
    out = []
    for k, name in enumerate(names):
        if name not in dropdowns:
            continue
        formula = '"' + ",".join(v.replace('"', '""') for v in dropdowns[name]) + '"'
        if len(formula) > MOST_LIST or any("," in v for v in dropdowns[name]):
            raise ValueError(f"the list of {name} is longer than {MOST_LIST} characters or has a comma in a value")
        c = column_letters(k)
        out.append(f'<dataValidation type="list" allowBlank="1" showInputMessage="1" showErrorMessage="1" errorStyle="{"warning" if name in free else "stop"}" sqref="{c}2:{c}{last}"><formula1>{escape(formula)}</formula1></dataValidation>')
    return f'<dataValidations count="{len(out)}">{"".join(out)}</dataValidations>' if out else ""


class _Out:
    """A stream that can only be written, which is all that object stores offer; zip then states sizes after each part."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream = stream

    def write(self, data: bytes) -> int:
        return self.stream.write(data)

    def flush(self) -> None:
        self.stream.flush()


def _workbook(stream: pa.NativeFile, sheet: str, names: list[str], rows: Iterator[list[str | None]], dropdowns: dict, free: set[str], notes: list[str]) -> int:
    """Writes one workbook and returns its number of rows below the header."""
    titles = [sheet, *(["Notes"] if notes else [])]
    with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name={quoteattr(t)} sheetId="{k}" r:id="rId{k}"/>' for k, t in enumerate(titles, 1))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in range(1, len(titles) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(titles) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(titles) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        n = 1
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{_row(1, names, 1)}'.encode())
            for cells in rows:
                n += 1
                out.write(_row(n, cells, 2).encode())
            out.write(f"</sheetData>{_validations(names, dropdowns, free, max(n, 400))}</worksheet>".encode())
        if notes:
            z.writestr("xl/worksheets/sheet2.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{"".join(_row(k, [line], 0) for k, line in enumerate(notes, 1))}</sheetData></worksheet>')
    return n - 1


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    if re.match("file:/(?!/)", path):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Workbooks that a task has finished."""

    files: list[str]


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), names, overwrite
        self.sheet, self.rows = options.get("sheet", "Sheet1"), min(int(options.get("rows", MOST_ROWS - 1)), MOST_ROWS - 1)
        self.dropdowns, self.free, self.notes = json.loads(options.get("dropdowns", "{}")), set(json.loads(options.get("free", "[]"))), json.loads(options.get("notes", "[]"))
        _validations(names, self.dropdowns, self.free, 2)  # fails before a task starts
        self.hidden = f"{self.path}/_sheets-{uuid.uuid4().hex}"

    def _file(self, tag: str, rows: Iterator[list[str | None]]) -> str:
        name = f"part-{tag}-{uuid.uuid4().hex}.xlsx"
        system, folder = file_system(self.hidden)
        system.create_dir(folder, recursive=True)
        try:
            with system.open_output_stream(f"{folder}/{name}") as stream:
                _workbook(stream, self.sheet, self.names, rows, self.dropdowns, self.free, self.notes)
        except BaseException:
            system.delete_file(f"{folder}/{name}")
            raise
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = (list(r) for b in iterator for r in zip(*(c.cast(pa.string()).to_pylist() for c in b.columns), strict=True))
        context, files = TaskContext.get(), []
        tag = f"{context.partitionId() if context else 0:05d}"
        # a workbook takes rows up to its limit; the next row, if there is one, begins another
        while (first := next(rows, None)) is not None:
            files.append(self._file(f"{tag}-{len(files):03d}", self._some(first, rows)))
        return Written(files)

    def _some(self, first: list[str | None], rows: Iterator[list[str | None]]) -> Iterator[list[str | None]]:
        yield first
        for _ in range(self.rows - 1):
            if (r := next(rows, None)) is None:
                return
            yield r

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if isinstance(m, Written) for f in m.files] or [self._file("00000-000", iter(()))]
        system, folder = file_system(self.path)
        old = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".xlsx")] if self.overwrite else []
        hidden = f"{folder}/{self.hidden.rsplit('/', 1)[1]}"
        for f in files:
            system.move(f"{hidden}/{f}", f"{folder}/{f}")
        for f in old:
            system.delete_file(f)
        system.delete_dir(hidden)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = file_system(self.hidden)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class SheetSource(DataSource):
    """Options: path, sheet (its title), rows (most in a workbook), dropdowns (JSON: column to values), free (JSON: columns whose list only warns), notes (JSON: lines of a second sheet)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options), schema.names, overwrite)


def write_sheets(rows: DataFrame, path: str, dropdowns: dict[str, list[str]] | None = None, free: tuple[str, ...] = (), notes: tuple[str, ...] = (), sheet: str = "Sheet1", mode: str = "append", most: int = MOST_ROWS - 1) -> None:
    """Writes ``rows`` as workbooks under ``path``, the first row of each naming the columns.

    Values are written as text, as Spark casts them; nulls and empty texts are
    empty cells. A table without rows gives one workbook with the header. More
    rows than a sheet holds go on in another workbook. The order is that of
    the partitions, so sort before if it matters.
    """
    rows.sparkSession.dataSource.register(SheetSource)
    writer = rows.select(*[rows[f"`{c}`"].cast("string").alias(c) for c in rows.columns]).write.format("sheet").mode(mode)
    writer.options(sheet=sheet, rows=str(most), dropdowns=json.dumps(dropdowns or {}), free=json.dumps(list(free)), notes=json.dumps(list(notes))).save(path)
