"""Upserts, deletes, paging and budgets over DataFrames without mutable storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str = "__order") -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with the same keys; the last of several in ``delta`` by ``order`` wins.

    One aggregation over the union: map-side partial maxima absorb hot keys.
    """
    rest = [c for c in base.columns if c not in keys]
    tagged = base.withColumn("__rank", F.struct(F.lit(0).alias("s"), F.lit(None).cast("long").alias("o"))).unionByName(
        delta.withColumn("__rank", F.struct(F.lit(1).alias("s"), F.col(order).cast("long").alias("o"))).select(*base.columns, "__rank")
    )
    best = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("__rank")).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in base.columns])


def upsert_outcome(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``delta``, each with the outcome inserted or updated."""
    have = base.select(*keys).distinct().withColumn("__have", F.lit(True))
    return delta.select(*keys).distinct().join(have, keys, "left").select(*keys, F.when(F.col("__have"), "updated").otherwise("inserted").alias("outcome"))


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def number_rows(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """``df`` with a column that numbers its rows from 0 in ``order``, without gaps.

    Rows are written once in ranges of ``order``, each file sorted; a row's
    number is its place in its file after the rows of all files before it. So
    no task numbers all rows, and partitions that adaptive execution merges
    can't disagree with those that were counted. Rows that tie in ``order``
    follow each other in any order.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranges")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    placed = rows.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__at"))
    # one row a file
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__start"))
    return placed.join(start, "__file").withColumn(into, F.col("__start") + F.col("__at")).drop("__file", "__at", "__start")


def append_with_ids(base: DataFrame, new: DataFrame, id: str, order: list[str]) -> DataFrame:
    """``new`` after ``base`` with ids that follow the largest one, in ``order``: unique and without gaps. An empty ``new`` adds nothing."""
    top = base.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
    numbered = number_rows(new, [F.col(c) for c in order], "__no")
    return base.unionByName(numbered.withColumn(id, (F.lit(top) + F.col("__no") + 1).cast(base.schema[id].dataType)).select(*base.columns))


def retained(stored: DataFrame, modified: str, now: Column, hours: int) -> DataFrame:
    """What a purge leaves of a store: rows changed in the last ``hours``; 0 or less keeps all. Rows without a time stay."""
    return stored if hours <= 0 else stored.filter(F.col(modified).isNull() | (F.col(modified) >= now - F.make_dt_interval(hours=F.lit(hours))))


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """One page in a total order; offset at least 0, limit from 1 to ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def first_rows(df: DataFrame, order: list[Column], limit: int = 0) -> DataFrame:
    """The first ``limit`` rows in a total order; 0 or less means all rows, which are then not sorted."""
    return df.orderBy(*order).limit(limit) if limit > 0 else df


def envelope(df: DataFrame, returned: DataFrame, offset: int) -> DataFrame:
    """total, offset, returned, has_more and next_offset of a page."""
    total, n = df.agg(F.count(F.lit(1)).alias("total")), returned.agg(F.count(F.lit(1)).alias("returned"))
    # two one-row frames
    return total.join(F.broadcast(n)).select(
        "total", F.lit(offset).cast("long").alias("offset"), "returned", (F.lit(offset) + F.col("returned") < F.col("total")).alias("has_more"), (F.lit(offset) + F.col("returned")).cast("long").alias("next_offset")
    )


def newest_within(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose sizes fit the budget together; the newest always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    used, n = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w)
    out = df.withColumn("__used", used).withColumn("__n", n)
    return (out if budget <= 0 else out.filter((F.col("__used") <= budget) | (F.col("__n") == 1))).drop("__used", "__n")


def last_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def line_budget(text: Column, budget: int) -> Column:
    """(shown, total, truncated, text): whole lines from the top that fit, each counted with its line feed; the first stays.

    A text no longer than the budget stays whole.
    """
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).cast("int").alias("used"), F.lit(0).cast("int").alias("kept"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & ((a["used"] + F.length(x) + 1 <= budget) | (a["kept"] == 0))
        return F.struct(F.when(fits, a["used"] + F.length(x) + 1).otherwise(a["used"]).alias("used"), (a["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    kept = F.aggregate(lines, start, step)["kept"]
    whole = F.lit(budget <= 0) | (F.length(text) <= budget)
    return F.struct(
        F.when(whole, F.size(lines)).otherwise(kept).alias("shown"), F.size(lines).alias("total"), (~whole).alias("truncated"),
        F.when(whole, text).otherwise(F.array_join(F.slice(lines, 1, F.greatest(kept, F.lit(1))), "\n")).alias("text"),
    )
