"""Operator 4: packs documents into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, materialize

#: Tokens in a window, in the longest piece that shares one, pieces that one task differences, words that a task remembers.
WINDOW, PIECE, GROUP, REMEMBERED = 2048, 512, 2048, 1 << 19

#: Characters for which white space bounds words and case is one letter for one: printable ASCII but the apostrophe, and the letters of Latin-1.
_ODD = re.compile(r"[^ \t-\r!-&(-~À-ÖØ-öø-ÿ]|<\|")
_PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")


class Remembered(dict):
    """Results of ``make`` by key, in two generations of ``most`` keys: one that is full becomes the older, and what is asked for again moves up."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, w: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.pop(w, None)
        self[w] = out = self.make(w) if out is None else out
        return out


class WordIds:
    """Token ids of whole texts by a tokenizer whose words don't cross white space.

    Each distinct part of a word is encoded once and remembered, up to a
    bound; parts with characters outside the plain set go to the tokenizer as
    they stand between white space. The ids equal those of encoding the text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.chunks = Remembered(self._part), Remembered(self._chunk)

    def _encode(self, w: str) -> bytes:
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def _part(self, w: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(w)]).tobytes() if w.isascii() else self._encode(w)

    def _chunk(self, w: str) -> bytes:
        return self._encode(w) if _ODD.search(w) else self._plain(w)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PART.findall(text.lower())))

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.chunks.__getitem__, re.split(r"[ \t-\r]+", text))) if _ODD.search(text) else self._plain(text)


#: Encoders of this worker process, by tokenizer file: what one task has encoded serves the next.
_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def piece_bounds(n: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then what is left in parts of ``piece``."""
    full = n // window * window
    return [(k, window) for k in range(0, full, window)] + [(k, min(piece, n - k)) for k in range(full, n, piece)]


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """One row per piece of each row of ``docs``: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens.

    Texts are encoded whole and get ``end_id`` at the end; a null text is empty.
    """
    bound_arrow(docs.sparkSession, rows=256, size=8 << 20)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            doc, start, length, ids, total = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = encode(t or "") + end
                n = len(data) // 4
                for s, k in piece_bounds(n, window, piece):
                    doc.append(i), start.append(s), length.append(k), ids.append(data[4 * s : 4 * (s + k)]), total.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["id", "start", "length", "ids", "doc_tokens"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long").withColumnRenamed("id", id)


def difference(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Karmarkar-Karp differencing into ``k`` windows: (sums, first item of each, last, next item of each item).

    Every item starts as a partition with one filled window. The two
    partitions of the widest spread merge, the fullest windows of one with the
    emptiest of the other, until one is left. Windows hold their items as
    chains, so a merge costs no more than sorting k sums.
    """
    n = len(lengths)
    nxt = np.full(n, -1)
    heap = [(-int(x), i, np.array([x]), np.array([i]), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, sa, fa, la = heapq.heappop(heap)
        _, _, sb, fb, lb = heapq.heappop(heap)
        m, over = len(sa), max(0, len(sa) + len(sb) - k)
        if over:
            x, y = len(sa) - over, len(sb) - over
            nxt[la[x:]] = fb[y:][::-1]
            s = np.concatenate((sa[:x], sa[x:] + sb[y:][::-1], sb[:y]))
            f, last = np.concatenate((fa[:m], fb[:y])), np.concatenate((la[:x], lb[y:][::-1], lb[:y]))
        else:
            s, f, last = np.concatenate((sa, sb)), np.concatenate((fa, fb)), np.concatenate((la, lb))
        o = np.argsort(-s, kind="stable")
        s, f, last = s[o], f[o], last[o]
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), made, s, f, last))
        made += 1
    _, _, s, f, last = heap[0]
    return s, f, last, nxt


def windows(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each piece, and the number of windows; pieces of a whole window have their own.

    The number of windows starts at what the sum needs and rises while
    differencing leaves one above capacity.
    """
    slot, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full, part = np.flatnonzero(lengths >= window), np.flatnonzero(lengths < window)
    slot[full] = np.arange(len(full))
    if not len(part):
        return slot, offset, len(full)
    own = lengths[part]
    k = max(1, -(-int(own.sum()) // window))
    while True:
        sums, first, _, nxt = difference(own, k)
        if sums[0] <= window:
            break
        k += max(1, k // 400)
    for w, i in enumerate(first.tolist()):
        at = 0
        while i >= 0:
            slot[part[i]], offset[part[i]] = len(full) + w, at
            at, i = at + int(own[i]), int(nxt[i])
    return slot, offset, len(full) + len(first)


def pack(rows: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``rows`` (with a column length, other columns kept) with sequence_id and offset.

    Pieces are written, numbered by their place in the files and dealt in
    groups of about ``group`` by a hash of that place, whatever they hold, so
    that copies of one document spread like any others; each group is packed
    by itself, and sequence ids carry the group's number.

    Every window holds at most ``window`` tokens, its pieces one after the
    other from 0. An empty input gives an empty result; repeated rows are
    pieces of their own.
    """
    names = rows.columns
    held = materialize(rows, "pieces")
    n = max(1, -(-held.count() // group))
    place = F.xxhash64(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1), F.col("_metadata.row_index"))
    dealt = held.select(*names, place.alias("__place")).withColumn("__group", F.pmod("__place", F.lit(n)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__place")
        slot, offset, _ = windows(t.column("length").to_numpy(), window)
        base = t.column("__group")[0].as_py() << 24
        return t.drop_columns(["__place", "__group"]).append_column("sequence_id", pa.array(slot + base)).append_column("offset", pa.array(offset))

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("__group").applyInArrow(run, schema)
