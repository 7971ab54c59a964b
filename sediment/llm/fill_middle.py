"""Operator 11: rewrites documents for fill-in-middle training with pyarrow.compute, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow

#: The marks of prefix, suffix and middle, and a pattern of any of them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = "<[PSM]>"
#: A unit in UTF-8 read byte by byte: a run of ASCII letters, or one other character. No byte of UTF-8 is END.
UNIT, END = rb"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*", b"\xff"
#: Bytes of text whose units are held at once; a longer text is worked on alone.
SLICE = 1 << 20


def draws(id: Column) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of "1:" and the decimal id, as longs; a null id counts as empty."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Lists of so many of the values each, joined to one piece a list."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), values), b"")


def split_roles(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units of each text, and its prefix, middle and suffix: cut after ``one`` mod (n + 1) and ``two`` mod (n + 1) units, the smaller first.

    ``texts`` are binary. A mark after each unit makes lists by splitting;
    flattened units know their text by parent index and their place by
    ordinal, which tells their role, and each role's units are put back into
    lists and joined.
    """
    units = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\0" + END), pattern=END)
    held = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    n = held - 1  # what follows the last mark is no unit
    parent = pc.list_parent_indices(units).to_numpy()
    place = np.arange(len(parent)) - (np.cumsum(held) - held)[parent]
    cut = np.stack((one % (n + 1), two % (n + 1)))
    first, last = cut.min(0), cut.max(0)
    flat = units.flatten()
    role = (place >= first[parent]).astype(np.int8) + (place >= last[parent]) + (place >= n[parent])
    return n, [_lists(flat.filter(pa.array(role == k)), size) for k, size in enumerate((first, last - first, n - last))]


def _rewritten(b: pa.RecordBatch, plain_from: int, spm_below: int) -> pa.RecordBatch:
    texts = pc.fill_null(b.column("t"), "").cast(pa.binary())
    h1, h2, h3, h4 = (b.column(f"h{k}").to_numpy() for k in range(1, 5))
    n, (prefix, middle, suffix) = split_roles(texts, h1, h2)
    marked = pc.match_substring_regex(texts, MARK).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= plain_from)
    spm = ~plain & (h4 % 100 < spm_below)
    mark = {k: pa.scalar(k, pa.binary()) for k in (PREFIX, SUFFIX, MIDDLE, b"")}
    joined = [pc.binary_join_element_wise(*parts, mark[MIDDLE], middle, mark[b""]) for parts in ((mark[PREFIX], prefix, mark[SUFFIX], suffix), (mark[SUFFIX], suffix, mark[PREFIX], prefix))]
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), joined[1], joined[0]))
    chars = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), form, *chars, output.cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _slices(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``size`` bytes of text at most; a longer text makes one of its own."""
    at = np.cumsum(pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        done = int(at[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(at, done + size, "right")))
        yield b.slice(start, stop - start)
        start = stop


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", plain_share: int = 10, spm_share: int = 20, size: int = SLICE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``; other columns are not read.

    A text is cut into units, a prefix, a middle and a suffix of units by
    draws from its id, and written as prefix, suffix, middle (psm), as suffix,
    prefix, middle (spm, ``spm_share`` percent of those cut) or as it stands
    (plain, ``plain_share`` percent). A text that is null or empty, or holds
    one of the marks, is plain; then the counts of characters are null. n
    counts the units of every text. Rows that repeat an id are cut alike as
    far as their texts agree; a null id draws as an empty one.

    Nothing is shuffled. A task holds the units of ``size`` bytes of texts, or
    of one longer text, about 30 bytes a unit.
    """
    bound_arrow(docs.sparkSession, rows=256, size=4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _slices(b, size):
                yield _rewritten(own, 100 - plain_share, spm_share)

    kind = docs.select(id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("t"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id)), 1)])
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: no part of a text that is not plain holds a mark, so the marks bound the parts."""
    part = F.split(output, MARK)
    at = lambda *k: F.concat(*[part[i] for i in k])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
