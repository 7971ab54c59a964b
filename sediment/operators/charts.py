"""Chart data: validation, ticks, stacks, shares, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("line", "area", "bar", "hbar", "stacked", "pie", "donut", "scatter")


def problems(labels: Column, series: Column, kind: Column, most: int = 200) -> Column:
    """Why a chart can't be drawn: kind, empty, points, lengths or values (which must be numbers or null); null if it can.

    series: array of (name, values as strings).
    """
    n = F.size(labels)
    odd = F.exists(series, lambda s: F.size(s["values"]) != n)
    bad = F.exists(series, lambda s: F.exists(s["values"], lambda v: v.isNotNull() & v.try_cast("double").isNull()))
    return F.when(~kind.isin(*KINDS), "kind").when((n == 0) | (F.size(series) == 0), "empty").when(n > most, "points").when(odd, "lengths").when(bad, "values")


def stack_bases(points: DataFrame) -> DataFrame:
    """Points (label, series_no, value) with value as at least 0, base (the sum below it) and total of the label."""
    v = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy("label").orderBy("series_no").rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumn("v", v).withColumn("base", F.sum("v").over(w) - F.col("v"))
    return out.withColumn("total", F.sum("v").over(Window.partitionBy("label")))


def pie_shares(points: DataFrame, group: str = "chart") -> DataFrame:
    """Share of absolute values in each chart, and whether its slice is wide enough (18 degrees) for a label."""
    total = points.groupBy(group).agg(F.sum(F.abs("value")).alias("__t"))
    share = F.coalesce(F.abs("value") / F.nullif("__t", F.lit(0.0)), F.lit(0.0))
    return points.join(total, group).withColumn("share", share).withColumn("labelled", F.col("share") * 360 >= 18).drop("__t")


def y_range(low: Column, high: Column, zero: bool) -> tuple[Column, Column]:
    """The axis range: with 0 if asked, and a tenth of the value (1 for 0) to either side if all values are one."""
    lo, hi = (F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))) if zero else (low, high)
    pad = F.when(lo == 0, F.lit(1.0)).otherwise(F.abs(lo) * 0.1)
    flat = lo == hi
    return F.coalesce(F.when(flat, lo - pad).otherwise(lo), F.lit(0.0)), F.coalesce(F.when(flat, hi + pad).otherwise(hi), F.lit(1.0))


def tick_step(low: Column, high: Column, count: int = 5) -> Column:
    """1, 2, 5 or 10 times a power of ten: the least step that needs ``count`` or fewer."""
    raw = F.when(high <= low, F.lit(1.0)).otherwise(high - low) / count
    mag = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= mag, mag).when(raw <= 2 * mag, 2 * mag).when(raw <= 5 * mag, 5 * mag).otherwise(10 * mag)


def ticks(low: Column, high: Column, count: int = 5) -> Column:
    step = tick_step(low, high, count)
    top = F.when(high <= low, low + 1).otherwise(high)
    first = F.floor(low / step)
    return F.transform(F.sequence(first.cast("long"), F.floor(top / step + 0.5).cast("long")), lambda k: k * step)


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def axis_text(v: Column) -> Column:
    """Short text of a tick: M from a million, k from ten thousand, else whole numbers with commas or two places."""
    a = F.abs(v)
    return (
        F.when(v.isNull(), "")
        .when(a >= 1_000_000, F.regexp_replace(F.format_string("%.1fM", v / 1_000_000), r"\.0M$", "M"))
        .when(a >= 10_000, F.format_string("%.0fk", v / 1000))
        .when(v == F.floor(v), F.format_number(v, 0))
        .otherwise(_trimmed(F.format_string("%.2f", v)))
    )


def value_text(v: Column) -> Column:
    """Text of a value that is read off: not rounded below ten million."""
    return (
        F.when(v.isNull(), "")
        .when(F.abs(v) >= 10_000_000, F.concat(_trimmed(F.format_string("%.2f", v / 1_000_000)), F.lit("M")))
        .when(v == F.floor(v), F.format_number(v, 0))
        .otherwise(_trimmed(F.format_number(v, 2)))
    )


def thin_labels(points: DataFrame, group: str = "chart", most: int = 12) -> DataFrame:
    """Points (chart, pos from 0) with ``shown``: every ceil(n / most)-th."""
    n = points.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return points.join(n, group).withColumn("shown", F.col("pos") % F.greatest(F.lit(1), F.ceil(F.col("__n") / most)) == 0).drop("__n")


def last_values(points: DataFrame, group: list[str]) -> DataFrame:
    """The last value that is not null of each group, with its position."""
    return points.filter("value is not null").groupBy(*group).agg(F.max("pos").alias("pos"), F.max_by("value", "pos").alias("value"))
