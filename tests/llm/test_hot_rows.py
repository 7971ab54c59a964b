"""Repeated rows that fill a third of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.llm import language_id, source_mix
from sediment.llm.common import hash128, materialize


def test_equal_rows_spread_over_the_blocks_of_a_mix(spark):
    k1, k2 = hash128("id")
    rows = spark.range(10_010).select("id").unionByName(spark.range(20_000).select(F.lit(-1).cast("long").alias("id"))).repartition(6)
    sizes = materialize(rows.select("id", k1.alias("k1"), k2.alias("k2")), "sizes")
    out = source_mix.salted(sizes, 4096).withColumn("blocks", F.lit(8))
    for level in (0, 1):
        groups = [r["count"] for r in out.groupBy(source_mix.block_of(level)).count().collect()]
        assert sum(groups) == 30_010 and max(groups) < 4300
    assert out.filter("salt <> 0").count() == 20_000 and out.columns.count("h1") == 0
    assert source_mix.salted(sizes.filter("id >= 0"), 4096).agg(F.sum("salt")).first()[0] == 0


def test_a_mix_of_repeated_rows_reaches_its_targets(spark):
    rows = [(k, f"w{k} " * (1 + k % 7), "a") for k in range(700)] + [(5000, "one two three", "b")] * 1400 + [(9000 + k, "x y", None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    per = {r.source: r for r in source_mix.mix(docs, block=64).groupBy(F.col("target").alias("source")).agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()}
    assert sum(r.n for r in per.values()) == len(rows)
    assert all(abs(target - r.taken) <= 6 for target, r in per.items())


def test_a_label_of_three_texts_is_learned_beside_many(spark):
    rows = [(k, f"the house number {k} is on the long road near the river and has {k % 9} windows", "en") for k in range(6000)]
    few = ["la maison est près de la rivière et de la route", "les enfants jouent dans le jardin avec le chien", "nous avons mangé du pain et du fromage hier soir"]
    for wording in (few, [t.replace("a", "o") + " bien sûr" for t in few]):
        own = rows + [(10_000 + k, wording[k % 3], "fr") for k in range(4000)]
        model = language_id.fit(spark.createDataFrame(own, "doc_id long, text string, lang string").repartition(4))
        assert set(model.langs) == {"en", "fr"}
        asked = spark.createDataFrame([(1, wording[0]), (2, "the house is on the road")], "doc_id long, text string")
        assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {1: "fr", 2: "en"}
