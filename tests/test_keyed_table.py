"""Changes in place against the same changes of a dict; untouched files stay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.keyed_table import KeyedTable

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("w", T.StringType())])


def names(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def rows_of(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=repr)


def test_upserts_equal_a_dict(spark, tmp_path):
    rng = random.Random(1)
    table = KeyedTable(str(tmp_path / "t"), ("a", "b"), SCHEMA, 16, 2)
    make = lambda n: [(rng.choice([None, *range(40)]), rng.choice([None, "", "x"]), rng.choice([None, 1, 2, 3]), rng.choice("pq")) for _ in range(n)]
    want = {}

    def settle(rows):
        best = {}
        for a, b, v, w in rows:
            new = (-1 if v is None else v, w)
            if (a, b) not in best or new > best[a, b][0]:
                best[a, b] = (new, (a, b, v, w))
        want.update({k: r for k, (_, r) in best.items()})

    for n in (200, 30, 1, 0):
        rows = make(n)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("__part", F.lit("clash"))
        table.create(df, ["v"]) if n == 200 else table.upsert(df, ["v"])
        settle(rows)
        assert rows_of(table, spark) == sorted(want.values(), key=repr)
    assert table.read(spark).columns == SCHEMA.names


def test_only_met_partitions_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    table = KeyedTable(str(path), ("a",), SCHEMA, 32)
    table.create(spark.range(1000).select(F.col("id").alias("a"), F.lit("b").alias("b"), F.lit(0).alias("v"), F.lit("w").alias("w")))
    before = names(path)
    table.upsert(spark.createDataFrame([(5, "new", 1, None), (5000, "new", 1, None)], SCHEMA))
    after = names(path)
    gone = {f.split("/")[0] for f in before - after}
    assert 1 <= len(gone) <= 2 and {f.split("/")[0] for f in after - before} == gone and len(before & after) >= 30
    got = {r.a: r.b for r in table.read(spark).collect()}
    assert len(got) == 1001 and got[5] == got[5000] == "new" and sum(b == "new" for b in got.values()) == 2
    before = names(path)
    table.update(spark, F.col("b") == "new", {"v": F.col("v") + 9, "w": F.lit("set")})
    assert {f.split("/")[0] for f in before - names(path)} == gone
    assert sorted((r.a, r.v, r.w) for r in table.read(spark).filter("v <> 0").collect()) == [(5, 10, "set"), (5000, 10, "set")]
    before = names(path)
    table.update(spark, F.col("b") == "none such", {"v": F.lit(1)})
    assert names(path) == before


def test_empty_tables_and_refusals(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("a",), SCHEMA, 4)
    table.create(spark.createDataFrame([], SCHEMA))
    assert rows_of(table, spark) == []
    table.upsert(spark.createDataFrame([(1, "b", None, "w")], SCHEMA))
    assert rows_of(table, spark) == [(1, "b", None, "w")]
    with pytest.raises(ValueError, match="no key"):
        table.update(spark, F.lit(True), {"a": F.lit(1)})
    with pytest.raises(ValueError, match="partitions"):
        KeyedTable("x", ("a",), SCHEMA, 0)
