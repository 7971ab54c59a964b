"""Operator 12: packs whole documents into as few token sequences as it can: exact complements by hashed sums, then best fit."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow, materialize
from .packing import Remembered

#: Tokens in a sequence.
WINDOW = 1024

#: Parts that the tokenizer never merges across, for texts of ASCII and Latin-1: contractions, words, numbers and other characters with a blank before, white space.
_L, _N, _W = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r "
_PART = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: Characters beyond those, and what may be a special token.
_ODD = re.compile(r"[^\t-\r -~¡-ÿ]|<\|")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteIds:
    """Token ids of whole texts by a byte-level tokenizer, each distinct part encoded once and remembered, up to a bound.

    Texts of ASCII and Latin-1 are cut into the parts that the tokenizer cuts
    them into. Other texts, and those that may hold a special token, go to
    the tokenizer whole. The ids equal those of encoding each text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.parts = Remembered(self._part)

    def _part(self, w: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, _PART.findall(text)))


#: Encoders of this worker process, by tokenizer file.
_ENCODERS: dict[str, ByteIds] = {}


def encoder(path: str) -> ByteIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteIds(path)
    return _ENCODERS[path]


def piece_bounds(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: what whole windows leave comes first."""
    head = n % window
    return [(0, head)] * (head > 0) + [(k, window) for k in range(head, n, window)]


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece of each row of ``docs``: id, piece, start, length, ids (little-endian unsigned 32-bit).

    Texts are encoded whole and get ``end_id`` at the end, so a text that is
    null or empty has one token. Documents within the window stay whole.
    """
    bound_arrow(docs.sparkSession, rows=256, size=8 << 20)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = encode(t or "") + end
                for k, (s, n) in enumerate(piece_bounds(len(data) // 4, window)):
                    row.append(i), piece.append(k), start.append(s), length.append(n), ids.append(data[4 * s : 4 * (s + n)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id)


class Stock:
    """How many pieces of each length are left, and how many pairs of lengths have each sum.

    The index of pair sums follows every length that runs out or comes back.
    A triple is a length whose rest is the sum of a pair, so the two indexes
    together answer for singles, pairs and triples.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.window = len(counts) - 1
        self.left = np.zeros(len(counts), np.int64)
        self.have = np.zeros(len(counts), bool)
        self.pairs = np.zeros(len(counts), np.int64)
        for n in np.flatnonzero(counts).tolist():
            self.add(n, int(counts[n]))

    def add(self, n: int, by: int) -> None:
        """``by`` pieces of length ``n`` come, or go where it is negative."""
        before = int(self.left[n])
        after = before + by
        self.left[n] = after
        if (before > 0) != (after > 0):
            self.have[n] = False
            others = np.flatnonzero(self.have[: max(0, self.window - n) + 1])
            self.pairs[others + n] += 1 if after > 0 else -1
            self.have[n] = after > 0
        if 2 * n <= self.window and (before > 1) != (after > 1):
            self.pairs[2 * n] += 1 if after > 1 else -1

    def pair(self, gap: int) -> list[int]:
        """Two pieces that fill the gap, the longest such first; none if there are none."""
        if gap < 2 or not self.pairs[gap]:
            return []
        longer = np.arange((gap + 1) // 2, gap)
        fits = np.flatnonzero(self.have[longer] & self.have[gap - longer] & ((2 * longer != gap) | (self.left[longer] > 1)))
        return [int(longer[fits[-1]]), int(gap - longer[fits[-1]])] if len(fits) else []

    def exact(self, gap: int) -> list[int]:
        """One, two or three pieces that fill the gap exactly, as few as can be; none if there are none."""
        if self.have[gap]:
            return [gap]
        if two := self.pair(gap):
            return two
        lengths = np.arange(1, max(1, gap - 1))
        for n in lengths[self.have[lengths] & (self.pairs[gap - lengths] > 0)][::-1].tolist():
            self.add(n, -1)
            two = self.pair(gap - n)
            self.add(n, 1)
            if two:
                return [n, *two]
        return []

    def fitting(self, gap: int) -> int:
        """The longest length within the gap, 0 if none is left."""
        at = np.flatnonzero(self.have[: gap + 1])
        return int(at[-1]) if len(at) else 0


def plan(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Sequences for ``counts[n]`` pieces of length n: (pieces of each length, number of such sequences).

    The longest piece left opens a sequence. Its gap is looked up among the
    sums of one, two and three pieces; where none fits exactly, the longest
    piece that fits goes in and the smaller gap is looked up again. A
    combination is used as often as the counts allow at once, so that each
    step uses up one of its lengths, whatever the number of pieces.
    """
    window, stock, out = len(counts) - 1, Stock(counts), []
    while first := stock.fitting(window):
        before = stock.left.copy()
        used, gap = Counter([first]), window - first
        stock.add(first, -1)
        while gap:
            more = stock.exact(gap) or [n for n in (stock.fitting(gap),) if n]
            for n in more:
                stock.add(n, -1)
                used[n] += 1
                gap -= n
            if not more:
                break
        times = min(int(before[n]) // k for n, k in used.items())
        for n, k in used.items():
            stock.add(n, -k * (times - 1))
        out.append((used, times))
    return out


def places(combinations: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their number among those of that length: one entry per length and combination.

    key is the length and the first number of the entry in one long, in order;
    the piece numbered first + j is in sequence ``base`` + j mod ``times``, at
    ``offset`` + (j div times) * length.
    """
    given: Counter = Counter()
    rows, base = [], 0
    for used, times in combinations:
        at = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n << 40 | given[n], base, times, at))
            given[n] += k * times
            at += k * n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "base", "times", "offset"), table.T.copy(), strict=True))


def numbered(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows`` with __part, the task that wrote them, and __nth, their number from 0 among its pieces of the same length; written and read again."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        at = names.index("length")
        for b in batches:
            own = b.column(at).to_numpy()
            order = np.argsort(own, kind="stable")
            lengths, first, n = np.unique(own[order], return_index=True, return_counts=True)
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(first - seen[lengths], n)
            seen[lengths] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(own), part, np.int64)), pa.array(nth)], [*names, "__part", "__nth"])

    schema = T.StructType([*rows.schema, T.StructField("__part", T.LongType()), T.StructField("__nth", T.LongType())])
    return materialize(rows.mapInArrow(run, schema), "numbered")


def pack(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows`` (with a column length from 1 to ``window``, other columns kept) with sequence_id and offset.

    One plan serves all pieces: only how many there are of each length goes
    to the driver, ``window`` numbers at most, and what comes back is a table
    of combinations whose size depends on ``window`` alone. Pieces are
    numbered within their length by task and place in it, tasks one after the
    other, and each finds its sequence by its number. Only rows as given are
    shuffled, once, on task and length, so no length is one key. Rows that
    repeat are pieces of their own; an empty input gives an empty result.
    """
    names = rows.columns
    held = numbered(rows, window)
    per = held.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(per.select("__part", "length", "n", before.alias("__before")), "bases")
    counts = np.zeros(window + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    table = rows.sparkSession.sparkContext.broadcast(places(plan(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            n, number = b.column("length").to_numpy(), b.column("__number").to_numpy()
            i = np.searchsorted(t["key"], n << 40 | number, "right") - 1
            j = number - (t["key"][i] & ((1 << 40) - 1))
            where = [t["base"][i] + j % t["times"][i], t["offset"][i] + j // t["times"][i] * n]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, where)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    numbers = held.join(bases.drop("n"), ["__part", "length"]).select(*names, (F.col("__before") + F.col("__nth")).alias("__number"))
    return numbers.mapInArrow(run, schema)
