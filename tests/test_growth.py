"""What queries hold and repeat as tables grow."""

from __future__ import annotations

import io
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from sediment.functions import grams, text, udfs
from sediment.operators import retrieval as R
from sediment.plans import QUERIES
from sediment.sources import sheets, tables
from test_functions import brute_similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stage_counts_search_the_corpus_once(spark, sf):
    p = plan(QUERIES["search_stage_counts"](spark, sf))
    assert "MapInPandas" not in p and "MapInArrow" not in p


def test_paragraphs_are_packed_without_python(spark, sf):
    assert "Python" not in plan(QUERIES["packed_chunks"](spark, sf))
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a" * 25, "\n\n" + "b " * 30, "x" * 12 + "\n\n"] + ["".join(rng.choice("ab é\n\n서") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size, overlap in ((10, 4), (20, 0), (7, 20)):
        got = {r.id: r.p for r in rows.select("id", text.packed(F.col("t"), size, overlap).alias("p")).collect()}
        assert got == {i: udfs.pack_paragraphs(t, size, overlap) for i, t in enumerate(texts)}


def test_a_long_sheet_is_read_as_a_stream():
    out = io.BytesIO()
    sheets._workbook(out, "s", ["a", "b"], ([f"x{k}", "y" * 40] for k in range(60_000)), {}, set(), [])
    data = out.getvalue()
    tracemalloc.start()
    try:
        n = 0
        for k, cells in enumerate(tables._sheet_rows(data)):
            n += 1
            assert cells == (["a", "b"] if k == 0 else [f"x{k - 1}", "y" * 40])
        assert n == 60_001 and tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_words_of_a_batch_are_never_all_python_texts(spark):
    """The keyword axis cuts Arrow batches and remembers few words."""
    q = spark.createDataFrame([(1, "alpha w12"), (2, "beta")], "qid long, query string")
    c = spark.createDataFrame([(k, f"alpha{k} w{k} w{k + 1} beta" if k % 3 else f"w{k}") for k in range(300)], "chunk_id long, chunk_text string").coalesce(1)
    want = sorted(map(tuple, R.keyword_axis(q, c).collect()))
    assert "MapInArrow" in plan(R.keyword_axis(q, c)) and len(want) == 100
    assert R.SEEN <= 1 << 16


def test_texts_to_clean_stay_in_arrow(spark):
    raw = [None, "", "<p>ａ&amp;b</p>"] + [f"<b>{k}</b> `<i>`" for k in range(1000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "id int, t string").coalesce(1)
    got = rows.select("id", udfs.clean_text("t").alias("c"))
    assert udfs.clean_text.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert {r.id: r.c for r in got.collect()} == {k: udfs.clean(t) for k, t in enumerate(raw)}


def test_best_stretches_of_many_queries_hold_narrow_tables_and_repeats_end_them():
    """A text's bounds for many queries take few megabytes, and repeats are no stretches to search."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    asked = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(100)]
    index = grams.Index([np.unique(grams.word_trigrams(q)) for q in asked])
    long = " ".join(rng.choice(words) for _ in range(700))
    tracemalloc.start()
    try:
        list(grams.Extents(long, index).runs(np.arange(100), np.full(100, 0.5)))
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    repeats = "for " * 40 + asked[0][:60] + " for" * 40 + " oftiorly" * 30 + asked[1][20:80] + " x for" * 20
    got = dict(grams.Extents(repeats, index).best(np.arange(8), np.full(8, 0.05)))
    for i in range(8):
        want = brute_similarity(asked[i], repeats)
        assert abs(got.get(i, 0) - (want if want >= 0.05 else 0)) < 1e-9


def test_best_runs_of_blocks_come_close_to_the_best_stretches():
    """What the first chunks tell is a lower bound, near the best, also where repeats make stretches longer than any run."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    asked = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    index = grams.Index([np.unique(grams.word_trigrams(q)) for q in asked])
    for t in (" ".join(rng.choice(words) for _ in range(300)), " ".join(words[:5] * 600 + words[5:12] + words[:5] * 200), "", "ab"):
        own = grams.Extents(t, index)
        low, best = own.shares(np.arange(6)), dict(own.best(np.arange(6), np.full(6, 1e-9)))
        for i, q in enumerate(asked):
            assert best.get(i, 0) * 0.5 <= low[i] <= best.get(i, 0) + 1e-9
            if len(t) < 3000:
                assert abs(best.get(i, 0) - brute_similarity(q, t)) < 1e-9


def test_chunks_are_dealt_evenly_to_the_search_for_best_stretches(spark, monkeypatch):
    """A table in one part is searched by all cores, once for what rows have to reach and once for the rows."""
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon")], "qid long, query string")
    c = spark.createDataFrame([(k, f"alpha beta w{k} delta" + " epsilon" * (k % 3)) for k in range(400)], "chunk_id long, chunk_text string").coalesce(1)
    found = R.trigram_axis(q, c)
    want = [sorted((-round(brute_similarity(a, f"alpha beta w{k} delta" + " epsilon" * (k % 3)), 6), k) for k in range(400))[:50] for a in ("alpha beta gamma", "delta epsilon")]
    got = [[(-r.sim, r.chunk_id) for r in sorted(found.filter(f"qid = {i}").collect(), key=lambda r: r.rn)] for i in (1, 2)]
    assert got == want
    p = plan(found)
    assert "hashpartitioning(chunk_id" in p[p.index("MapInPandas") :]
    # a first wave and the rest are the whole table, each chunk once
    monkeypatch.setattr(R, "WAVED", 100)
    waved = R.trigram_axis(q, c)
    assert sorted(map(tuple, waved.collect())) == sorted(map(tuple, found.collect())) and "Union" in plan(waved)


def test_the_third_axis_of_the_fused_search_is_dealt_evenly(spark, sf):
    assert "hashpartitioning(chunk_id" in plan(QUERIES["rrf_three_axis"](spark, sf))
