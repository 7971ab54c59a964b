"""Operator 5: WARC archives written by Spark's text sink and read back as chunk rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow, materialize, scratch_path

#: Bytes of payload in one written record; longer payloads go on in continuation records. Bytes of a chunk row.
SEGMENT, CHUNK = 1 << 20, 1 << 18
#: Bytes of a record's header at most.
HEADER = 1 << 20
#: Equal payloads shorter than this are all stored.
LEAST_REVISIT = 100
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNK_SCHEMA = "record_id string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean, record_type string, page_id string, refers_to string, payload_bytes long, payload_digest string, problem string"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def with_roles(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, body, bytes, digest, first): ``first`` is the smallest id among equal payloads of ``least`` bytes or more.

    Only digests are grouped; a payload that very many pages share is counted
    map-side, and the join back on digests has plain exchanges that adaptive
    execution can split. A null payload is empty.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"bytes": F.length("body").cast("long"), "digest": F.sha2("body", 256)})
    firsts = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "first")
    firsts = materialize(firsts, "payloads")
    return rows.join(firsts, (F.col("digest") == F.col("of")) & (F.col("bytes") >= least), "left").drop("of")


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT, least: int = LEAST_REVISIT, compression: str = "gzip") -> None:
    """Writes one record per row: a response, or a revisit that refers to the response with the same payload.

    Records are strings of bytes that end as WARC records do, which is what
    the text sink writes between rows, so files go through Spark's committer
    to any store that Spark writes. Payloads over ``segment`` bytes become a
    first segment and continuation records right after it.

    Of equal payloads of at least ``least`` bytes the smallest id is the
    response; rows that repeat that id are responses too. A null payload is
    empty; a null id is written without X-Page-Id, counts as larger than all
    ids, and is stored as a response if all equal payloads have null ids. Ids
    are written URL-encoded, so that no id breaks a header.
    """
    rows = with_roles(pages, id, url, payload, least)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    own = _uuid(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest"))
    parts = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / segment))).cast("int")
    rows = rows.withColumns({"revisit": revisit, "own": own, "parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.expr(f"substring(body, (part - 1) * {int(segment)} + 1, {int(segment)})"))
    first = F.col("part") == 1
    block = F.when(first, F.concat(F.lit(_HTTP.encode()), body)).otherwise(body)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    split = F.col("parts") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(first, F.col("own")).otherwise(_uuid(F.col("own"), F.col("part").cast("string")))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.when(F.col("id").isNotNull(), line("X-Page-Id", F.url_encode(F.col("id").cast("string")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(first & F.col("revisit"), F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _uuid(F.col("first").cast("string"), F.col("digest"))), line("X-Refers-To-Page", F.url_encode(F.col("first").cast("string"))))).otherwise(""),
        F.when(split, line("WARC-Segment-Number", F.col("part").cast("string"))).otherwise(""),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("own"))).otherwise(""),
        F.when(split & (F.col("part") == F.col("parts")), line("WARC-Segment-Total-Length", (F.col("bytes") + len(_HTTP)).cast("string"))).otherwise(""),
        F.when(first, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(""),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class Problem(ValueError):
    """An archive that is cut, damaged or not what its headers say."""


class _Reader:
    """Parses one archive, fed in pieces, into chunk rows; holds no more than a chunk, a piece and a header."""

    def __init__(self, file: str, chunk: int, data: bool) -> None:
        self.file, self.chunk, self.data = file, chunk, data
        self.rest, self.left, self.in_http = b"", 0, False
        self.rec: dict[str, str] = {}
        self.segments, self.open = 0, False
        self._fresh()

    def _fresh(self) -> None:
        self.buf, self.total, self.no, self.sha = bytearray(), 0, 0, hashlib.sha256()

    def _row(self, last: bool, problem: str | None = None) -> tuple:
        r, kind = self.rec, self.rec.get("warc-type", "")
        whole, page = kind == "response", r.get("x-page-id")
        out = (
            r.get("warc-record-id"), self.no, bytes(self.buf) if self.data else None, self.total, self.sha.hexdigest(), last, kind, None if page is None else unquote_plus(page), unquote_plus(r["x-refers-to-page"]) if "x-refers-to-page" in r else None,
            self.total if whole else int(r.get("x-payload-length", "0")), self.sha.hexdigest() if whole else r.get("warc-payload-digest", "").removeprefix("sha256:"), problem,
        )
        self.buf, self.no = bytearray(), self.no + 1
        return out

    def _problem(self) -> str | None:
        """What is wrong with the record that is open, given all that was read of it."""
        r = self.rec
        if self.left:
            return f"{self.left} bytes missing"
        if self.in_http:
            return "no end of the HTTP header"
        if r.get("warc-type") != "response":
            return None
        if "x-payload-length" in r and int(r["x-payload-length"]) != self.total:
            return f"payload of {self.total} bytes instead of {r['x-payload-length']}"
        digest = r.get("warc-payload-digest", "")
        if digest.startswith("sha256:") and digest[7:] != self.sha.hexdigest():
            return "payload differs from its digest"
        return None

    def end(self) -> Iterator[tuple]:
        """The record that is open is complete."""
        if self.open:
            self.open = False
            yield self._row(True, self._problem())

    def _payload(self, b: memoryview) -> Iterator[tuple]:
        at = 0
        while at < len(b):
            if len(self.buf) >= self.chunk:
                yield self._row(False)
            part = b[at : at + self.chunk - len(self.buf)]
            self.buf += part
            self.sha.update(part)
            self.total, at = self.total + len(part), at + len(part)

    def feed(self, piece: bytes) -> Iterator[tuple]:
        b, at = self.rest + piece if self.rest else piece, 0
        view = memoryview(b)
        while at < len(b):
            if self.left and self.in_http:
                # the HTTP header ends at an empty line
                cut = b.find(b"\r\n\r\n", at, at + self.left)
                if cut < 0:
                    if len(b) - at >= self.left:
                        at, self.left = at + self.left, 0
                        continue
                    keep = max(at, len(b) - 3)
                    self.left -= keep - at
                    at = keep
                    break
                self.left, at, self.in_http = self.left - (cut + 4 - at), cut + 4, False
            elif self.left:
                part = view[at : at + self.left]
                if self.open:
                    yield from self._payload(part)
                at, self.left = at + len(part), self.left - len(part)
            else:
                # blank lines between records, then a header up to an empty line
                start = re.compile(rb"[\r\n]*").match(b, at).end()
                stop = b.find(b"\r\n\r\n", start)
                if stop < 0:
                    at = start
                    break
                yield from self._header(b[start:stop])
                at = stop + 4
        self.rest = b[at:]
        if len(self.rest) > HEADER:
            raise Problem(f"{self.file}: no record header in {len(self.rest)} bytes")

    def _header(self, lines: bytes) -> Iterator[tuple]:
        first, *fields = lines.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise Problem(f"{self.file}: a record starts with {first[:40]!r}")
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in fields)}
        if not head.get("content-length", "").isdigit():
            raise Problem(f"{self.file}: a record without Content-Length")
        if head.get("warc-type") == "continuation":
            follows, self.segments = self.open and head.get("warc-segment-origin-id") == self.rec.get("warc-record-id"), self.segments + 1
            if not follows or head.get("warc-segment-number") != str(self.segments):
                raise Problem(f"{self.file}: a continuation that does not follow its origin")
            self.left = int(head["content-length"])
            return
        yield from self.end()
        self.left, self.rec, self.open, self.segments = int(head["content-length"]), head, head.get("warc-type") in ("response", "revisit"), 1
        self.in_http = self.open and self.left > 0 and head.get("content-type", "").startswith("application/http")
        self._fresh()

    def close(self) -> Iterator[tuple]:
        """The file has ended."""
        yield from self.end()
        if self.left and self.rec.get("warc-type") not in ("response", "revisit") or self.rest.strip(b"\r\n"):
            raise Problem(f"{self.file}: cut inside a record")


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK, data: bool = True, strict: bool = True) -> DataFrame:
    """The archives under ``path`` as chunk rows: record_id, chunk_no, chunk, bytes_so_far, digest_so_far, last, the record's fields, and problem.

    Files are streamed through Spark's text source, cut at line feeds, and
    framed by Content-Length; a payload is cut into chunks of at most
    ``chunk`` bytes with a running SHA-256, so that neither a record nor a
    file is ever held whole. The ``last`` row of a response has the length and
    digest of all its payload as read; a revisit has one row, with those of
    its header. ``data`` false leaves the bytes out.

    At the end of each record what was read is compared with its headers:
    Content-Length, X-Payload-Length and a SHA-256 in WARC-Payload-Digest. A
    record that is cut or differs is an error, or with ``strict`` false has
    the reason in ``problem`` of its last row. What leaves no way to find the
    next record (no header where one should be, continuations without their
    origin) is always an error. Other record types are passed over.

    Compressed archives are read by one task each. Files that Spark splits,
    such as uncompressed ones, are put together by file and place first, in a
    shuffle that spills, so a record never depends on where a split fell. The
    longest run of bytes without a line feed is held at once; in archives of
    ``write_warc`` that is a segment at most, in others whatever they hold.
    """
    bound_arrow(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("v"), meta["file_path"].alias("f"), meta["file_block_start"].alias("s"))
    if not all(f.endswith((".gz", ".deflate", ".zst")) for f in lines.inputFiles()):
        lines = lines.withColumn("n", F.monotonically_increasing_id()).repartition("f").sortWithinPartitions("f", "s", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        reader: _Reader | None = None
        rows: list[tuple] = []
        held = 0

        def checked(found: Iterator[tuple]) -> Iterator[tuple]:
            for row in found:
                if strict and row[-1]:
                    raise Problem(f"{reader.file}: record {row[0]}: {row[-1]}")
                yield row

        for pdf in batches:
            values, files = pdf["v"].tolist(), pdf["f"].to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)] if len(files) else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                if reader is None or files[x] != reader.file:
                    rows += checked(reader.close()) if reader else []
                    reader = _Reader(files[x], chunk, data)
                for row in checked(reader.feed(b"\n".join(values[x:y]) + b"\n")):
                    rows.append(row)
                    held += len(row[2] or b"") + 256
                    if held > 16 * CHUNK:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        rows += checked(reader.close()) if reader else []
        yield pd.DataFrame(rows, columns=names)

    return lines.select("v", "f").mapInPandas(run, CHUNK_SCHEMA)


def archive_and_read(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder, reads them back and returns one row per record."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, id, url, payload)
    kind = pages.select(id).schema[0].dataType
    return (
        read_warc(pages.sparkSession, path, data=False)
        .filter("last")
        .select(F.col("page_id").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
    )
