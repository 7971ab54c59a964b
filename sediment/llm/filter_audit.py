"""Operator 13: what five filters remove in every order, from counters that a stream keeps and corrects as smaller ids arrive."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import scratch_path
from ..streaming.state import rocksdb
from .common import bound_arrow

#: The filters; filter k is bit k of a mask of what a document fails.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Micro-batches that the files are read in, texts that a task combines before it hands them on, rows of the input to a bucket of state.
BATCHES, HELD, BUCKET = 4, 1 << 15, 64

COUNTED = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone: under 200 words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(r"([^ \t\n\x0B\f\r]+)"), F.lit(1))
    n = F.size(words)
    fails = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"))
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out.cast("int")


def _after(a: int | None, b: int | None) -> bool:
    """Whether id ``a`` comes after ``b``; null comes last."""
    return b is not None and (a is None or a > b)


def combined(rows: DataFrame, held: int = HELD) -> DataFrame:
    """(key, mask, id, part, n, place) from (key, mask, id, part): a task's rows of one text as its smallest id, and those after it as copies.

    Rows with the smallest id that a task has met of a text keep their key;
    any other row of the text fails E whatever comes, so it goes on with that
    bit and without a key. place numbers what a task hands on. A task holds
    ``held`` texts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, int | None]] = {}
        own: dict[bytes, dict[str, int]] = {}
        copies: dict[tuple, int] = defaultdict(int)

        sent = 0

        def flush() -> pa.RecordBatch:
            nonlocal sent
            out = [(key, *least[key], part, n) for key, parts in own.items() for part, n in parts.items()]
            out += [(None, mask | COPY, id, part, n) for (mask, id, part), n in copies.items()]
            least.clear(), own.clear(), copies.clear()
            columns = list(zip(*out, strict=True)) or [()] * 5
            place = pa.array(range(sent, sent + len(out)), pa.int64())
            sent += len(out)
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], place], ["key", "mask", "id", "part", "n", "place"])

        for b in batches:
            for key, mask, id, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in least or _after(least[key][1], id):
                    for p, n in own.get(key, {}).items():
                        copies[mask, least[key][1], p] += n
                    least[key], own[key] = (mask, id), {part: 1}
                elif least[key][1] == id:
                    own[key][part] = own[key].get(part, 0) + 1
                else:
                    copies[mask, id, part] += 1
            if len(least) + len(copies) >= held:
                yield flush()
        yield flush()

    return rows.select("key", "mask", "id", "part").mapInArrow(run, "key binary, mask int, id long, part string, n long, place long")


class LeastIds(StatefulProcessor):
    """State of a bucket of texts: the smallest id of each so far, and how many rows with it count without E, by part and labels.

    When a smaller id arrives, those rows are taken from the counters of
    their mask and added to those of the mask with E.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getValueState("texts", "least string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        out: dict[tuple, int] = defaultdict(int)
        least, touched = None, False
        for r in rows:
            own = (r.part, r.good, r.toxic)
            if r.key is None:  # a copy, whatever comes
                out[r.mask, own] += r.n
                continue
            if least is None:
                # text: [smallest id, [part, good, toxic, rows]...]
                least = json.loads(old[0]) if (old := self.texts.get()) else {}
            touched, at = True, r.key.hex()
            if at not in least:
                least[at] = [r.id]
            elif _after(least[at][0], r.id):
                for *held, n in least[at][1:]:
                    out[r.mask, tuple(held)] -= n
                    out[r.mask | COPY, tuple(held)] += n
                least[at] = [r.id]
            if r.id == least[at][0]:
                out[r.mask, own] += r.n
                held = {tuple(k): n for *k, n in least[at][1:]}
                held[own] = held.get(own, 0) + r.n
                least[at] = [r.id, *([*k, n] for k, n in held.items())]
            else:
                out[r.mask | COPY, own] += r.n
        if touched:
            self.texts.update((json.dumps(least, separators=(",", ":")),))
        for (mask, (part, good, toxic)), n in out.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(part, mask, good, toxic, n) of all documents in the Parquet files at ``path``, by a stream that ends when all are read.

    The files come in about ``batches`` micro-batches. Texts meet in buckets
    of about ``BUCKET``, as many as the row count asks for, so that state is
    read and written once a bucket and not once a text. A micro-batch's changes
    of the counters are written under its number, so that one which is done
    again after a failure replaces its own; state and progress are kept in
    the shared folder, as are the changes.
    """
    bound_arrow(spark)
    files = spark.read.parquet(path)
    # as a pattern, since the stream takes no path of a single file otherwise
    named = re.sub(r"/*$", "", path)
    named = f"{named[:-1]}[{named[-1]}]"
    into, log = scratch_path(spark, "audit-counts"), scratch_path(spark, "audit-progress")
    text = F.coalesce("text", F.lit(""))
    docs = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max(1, -(-len(files.inputFiles()) // batches))).parquet(named)
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), text_mask(text).alias("mask"), F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id have no label; they meet none, each under a number of its own
    met = combined(rows).withColumns({"has": F.col("id").isNotNull(), "to": F.coalesce("id", "place")}).join(known.withColumn("has", F.lit(True)).withColumnRenamed("l_id", "to"), ["has", "to"], "left")
    buckets = max(1, files.count() // BUCKET)
    # copies need no state and go to any bucket
    bucket = F.pmod(F.when(F.col("key").isNull(), F.col("place")).otherwise(F.xxhash64("key")), F.lit(buckets))
    keyed = met.select(bucket.alias("bucket"), "key", "mask", "id", "part", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    changes = keyed.groupBy("bucket").transformWithState(LeastIds(), COUNTED, "Append", "None")

    def write(df: DataFrame, batch: int) -> None:
        df.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{into}/batch={batch}")

    with rocksdb(spark):
        stream = changes.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
        stream.awaitTermination()
    written = spark.read.schema(COUNTED).parquet(f"{into}/batch=*") if stream.lastProgress else spark.createDataFrame([], COUNTED)
    return written.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters by mask.

    A filter and the set of those before it decide a row, so counters meet 80
    such pairs, and the rows of a part are dealt to the orders afterwards.
    """
    orders = defaultdict(list)
    for order in permutations(range(5)):
        for step, f in enumerate(order):
            orders[f, sum(1 << k for k in order[:step])].append(("".join(FILTERS[k] for k in order), step + 1))
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(before).alias("before")) for f, before in sorted(orders)]))
    met = counts.select("part", "mask", "good", "toxic", "n", pair.alias("p")).select("*", "p.f", "p.before")
    own, gone = F.expr("mask & shiftleft(1, f)") != 0, F.expr("mask & before") != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    # a document that fails k filters is removed by each of them in 120 / k orders
    share = F.sum(F.when(own, F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")).otherwise(0)).alias("shapley")
    per = met.groupBy("part", "f", "before").agg(
        total(~gone & ~own)("kept"), total(~gone & own)("removed"), total(gone & own)("redundant"), total(own & (F.bit_count("mask") == 1))("unique_fails"),
        total(~gone & own & F.col("good"))("good_lost"), total(~gone & own & F.col("toxic"))("toxic_lost"), share,
    )
    dealt = _dealt(counts.sparkSession, orders)
    return per.join(F.broadcast(dealt), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _dealt(spark: SparkSession, orders: dict) -> DataFrame:
    """The 600 (order, step), by filter and set before it: a fixed table."""
    return spark.createDataFrame([(f, before, name, step) for (f, before), own in orders.items() for name, step in own], "f int, before int, filter_order string, step int")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What each filter removes at each step of each of the 120 orders, per part (lang, null as an empty string).

    path: Parquet files of documents (doc_id, text, lang). labels: doc_id,
    quality, toxic; of several rows of an id any 1 counts, and a document
    without a row is neither good nor toxic. A null text is empty. E fails a
    document if a smaller id has the same text anywhere; rows that repeat the
    smallest id don't fail it, and null ids come after all others. No
    documents, no rows. The stream has ended when this returns.
    """
    return report(counters(spark, path, labels, batches))
