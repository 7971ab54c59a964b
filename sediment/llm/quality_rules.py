"""Operator 10: quality rules as a short-circuit cascade in order of rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, hash_sample

_SYMBOLS = "#*$%&|<>"


class Doc:
    """One text and the counts that rules ask for, each made once, when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self._made: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        if name.startswith("_") or name not in COUNTS:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = COUNTS[name](self)
        return self._made[name]

    @property
    def words(self) -> list[bytes]:
        """Runs of anything but white space; splitting bytes takes the six ASCII characters only."""
        if "_words" not in self.__dict__:
            self.__dict__["_words"] = self.text.encode("utf-8", "surrogatepass").split()
        return self.__dict__["_words"]


def _word_chars(d: Doc) -> int:
    return len(d.text) - sum(map(d.text.count, " \t\n\x0b\x0c\r"))


def _dup_lines(d: Doc) -> int:
    lines = [x for x in d.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeat_words(d: Doc) -> int:
    """Words that lie in some window of three words found twice or more."""
    if len(d.words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in d.words), np.int64, len(d.words))
    if len(number) == len(ids):
        return 0
    pair = ids[:-1] * len(number) + ids[1:]
    # pairs are numbered before the third word is joined on, so that no product overflows
    first = np.unique(pair, return_inverse=True)[1] if len(number) > 2_000_000 else pair
    _, which, times = np.unique(first[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


COUNTS: dict[str, Callable[[Doc], int]] = {
    "n_words": lambda d: len(d.words),
    "word_chars": _word_chars,
    "n_symbols": lambda d: sum(map(d.text.count, _SYMBOLS)),
    "n_lines": lambda d: sum(1 for x in d.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``fails`` is true of a document to be rejected."""

    name: str
    fails: Callable[[Doc], bool]


BASE_RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
#: Words of odd length on average, more than a symbol to ten words, three or more repeated lines that are 0.3 of all.
RULES = BASE_RULES + (
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * d.n_lines),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample: int = 2000) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on about ``sample`` rows, best first.

    The rows are chosen by a hash of id and text, so the sample is the same at
    each run and its size does not grow with the input. Every rule is timed on
    a fresh document, counts that it needs included. The order goes by
    rejections per second; only the total cost of the cascade depends on it,
    never a verdict. The estimates are made on the executors and a few numbers
    a task come to the driver.
    """
    bound_arrow(docs.sparkSession)
    picked = hash_sample(docs.select(F.col(id).alias("i"), F.col(text).alias("t")), sample, F.col("i"), F.col("t")).select("t")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in rules:
                began = time.perf_counter()
                failed = sum(bool(r.fails(Doc(t))) for t in pdf["t"])
                rows.append((r.name, len(pdf), time.perf_counter() - began, failed))
            yield pd.DataFrame(rows, columns=["name", "n", "s", "failed"])

    found = {r["name"]: r for r in picked.mapInPandas(measure, "name string, n long, s double, failed long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("failed").alias("failed")).collect()}
    out = []
    for r in rules:
        n, s, failed = (found[r.name][k] for k in ("n", "s", "failed")) if r.name in found else (0, 0.0, 0)
        out.append((r.name, s / max(n, 1), failed / max(n, 1)))
    return sorted(out, key=lambda x: -x[2] / max(x[1], 1e-9))


def quality_cascade(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, counts: tuple[str, ...] = (), sample: int = 2000, order: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, kept, and ``counts``; with a given ``order`` also failed_rule (the first that failed, null if none).

    Rules run in the order that ``cascade_order`` estimates, or in ``order``
    (their names); the first one that fails ends a document's cascade, and
    counts that no rule reached are not made unless ``counts`` asks for them.
    A document is kept if no rule fails, whatever the order. Which rule
    stopped a document does depend on the order, and an estimate rests on
    measured times, so failed_rule is given for a stated order only; one that
    was estimated once can be stated from then on.

    A null or empty text has no words and fails by its length. Texts of any
    length are read whole. Repeated rows repeat their result, null ids are
    kept, and no other column is read. Nothing but the sample is shuffled.
    """
    bound_arrow(docs.sparkSession)
    by_name = {r.name: r for r in rules}
    stated = order is not None
    run_order = [by_name[x] for x in (order if stated else [x for x, _, _ in cascade_order(docs, rules, id, text, sample)])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                d = Doc(t)
                bad = next((r.name for r in run_order if r.fails(d)), None)
                rows.append((bad is None, *[getattr(d, c) for c in counts], bad))
            out = pd.DataFrame(rows, columns=["kept", *counts, "failed_rule"])
            out.insert(0, "id", pdf["id"])
            yield out

    kind = docs.select(id).schema[0].dataType.simpleString()
    schema = "id string, kept boolean" + "".join(f", {c} long" for c in counts) + ", failed_rule string"
    # ids of whole numbers would become floats in pandas beside a null; strings carry any of them
    out = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("t")).mapInPandas(run, schema)
    return out.select(F.col("id").cast(kind).alias(id), "kept", *counts, *(["failed_rule"] if stated else []))
