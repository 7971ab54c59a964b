"""Tables in files that are changed in place: rows lie in partitions by the hash of their key, and a change rewrites only those that it meets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

#: The partition column, and how many partitions there may be: the numbers of those that a change meets reach the driver.
PART = "__part"
MOST_PARTS = 4096


@dataclass(frozen=True)
class KeyedTable:
    """A table under ``path`` with one row a key; null is a key like any other.

    ``parts`` says in how many partitions rows lie (choose it for some
    gigabytes each, and so that a usual change meets few), ``splits`` in how
    many files a partition is written. Both belong to the table and don't
    change. A change reads the partitions that it meets, writes them beside
    the old ones and swaps them when all tasks are done; files of the others
    keep their names. Writers of one table have to take turns.
    """

    path: str
    key: tuple[str, ...]
    schema: T.StructType
    parts: int = 256
    splits: int = 1
    #: Columns of the table that are no key.
    rest: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        if not 1 <= self.parts <= MOST_PARTS or self.splits < 1:
            raise ValueError(f"1 to {MOST_PARTS} partitions, and 1 file or more in each")
        object.__setattr__(self, "rest", tuple(c for c in self.schema.names if c not in self.key))

    def create(self, rows: DataFrame, newest: Sequence[str] = ()) -> None:
        """Writes the table anew; of rows with one key the greatest by ``newest``, then by the other columns, stays."""
        self._write(self._placed(rows, newest), self.parts, "static")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._raw(spark).select(*self.schema.names)

    def upsert(self, delta: DataFrame, newest: Sequence[str] = ()) -> None:
        """Rows of ``delta`` replace those of their keys or are added; among themselves they are settled as by ``create``.

        Columns that the table does not have are left out.
        """
        new = materialize(self._placed(delta, newest), "upsert")
        met = self._met(new)
        if met:
            old = self._raw(delta.sparkSession).filter(F.col(PART).isin(met))
            keys = new.select(*[F.col(c).alias(f"__new{k}") for k, c in enumerate(self.key)])
            same = [F.col(c).eqNullSafe(F.col(f"__new{k}")) for k, c in enumerate(self.key)]
            self._write(old.join(keys, same, "left_anti").unionByName(new), len(met), "dynamic")

    def update(self, spark: SparkSession, where: Column, values: dict[str, Column]) -> None:
        """Sets ``values`` (of columns that are no key) in the rows for which ``where`` is true."""
        if set(values) - set(self.rest):
            raise ValueError("only columns of the table that are no key can be set")
        rows = self._raw(spark)
        met = self._met(rows.filter(where))
        if met:
            new = {c: F.when(where, v).otherwise(F.col(c)).cast(self.schema[c].dataType) for c, v in values.items()}
            self._write(rows.filter(F.col(PART).isin(met)).withColumns(new), len(met), "dynamic")

    def _raw(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(self.path)

    def _placed(self, rows: DataFrame, newest: Sequence[str]) -> DataFrame:
        """One row a key, counted before it is shuffled, with its partition."""
        order = [*newest, *(c for c in self.rest if c not in newest)]
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*order)).alias("__r")) if self.rest else rows.select(*self.key).distinct()
        cells = [(F.col(f.name) if f.name in self.key else F.col("__r").getField(f.name)).cast(f.dataType).alias(f.name) for f in self.schema]
        return one.select(*cells).withColumn(PART, F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))

    def _met(self, rows: DataFrame) -> list[int]:
        """Numbers of the partitions in which ``rows`` lie: MOST_PARTS at most."""
        return sorted(r[0] for r in rows.select(PART).distinct().collect())

    def _write(self, rows: DataFrame, parts: int, how: str) -> None:
        # which file of its partition a row is in is told by other bits of the hash
        split = F.pmod(F.shiftright(F.xxhash64(*self.key), 32), F.lit(self.splits))
        dealt = rows.repartition(parts * self.splits, F.col(PART), split)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(PART).parquet(self.path)
