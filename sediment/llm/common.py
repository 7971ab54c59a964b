"""What the corpus operators share: text constants, scratch tables, Arrow bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, scratch_path  # noqa: F401
from ..session import spread

#: The white space of every operator here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bound_arrow(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds the batches that Python workers get, by rows and by bytes.

    Texts may be long; Spark's default of 10,000 rows sets no bound in bytes.
    Values that the session has already lowered are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= most:
            spark.conf.set(key, str(most))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds: together an identifier of 128 bits."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(20111), *cols)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def in_share(share: Column, *by: Column) -> Column:
    """True for about ``share`` (0 to 1) of all values of ``by``, by their hash."""
    return F.xxhash64(*by).cast("double") / F.lit(2.0**64) + 0.5 < share


def hash_sample(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """About ``n`` rows: those whose hash of ``by`` lies under a bound set from the row count.

    Rows are chosen where they are read; only chosen ones move. Rows that
    repeat their values of ``by`` are all chosen or none.
    """
    rows = df.count()
    return df if rows <= n else df.filter(in_share(F.lit(n / rows), *by))


def row_place() -> Column:
    """A number for each row of a table that ``materialize`` has just read: task, file of the task and row in one long."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("long")
    piece = F.coalesce(F.nullif(F.regexp_extract(name, r"-c(\d+)", 1), F.lit("")), F.lit("0")).cast("long")
    return F.shiftleft(part, 42) + F.shiftleft(piece, 32) + F.col("_metadata.row_index")
