"""The three axes against brute force: ranks, positional index, inverted file of vectors, best stretches."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.config import DEFAULT, Options
from sediment.operators import retrieval as R
from sediment.operators import vector_index as V
from test_functions import brute_similarity

QUERIES = "qid long, query string, qvec array<float>"
CHUNKS = "chunk_id long, chunk_text string, embedding array<float>"


def read_files(df):
    """What the physical plan says of its scans."""
    return df._jdf.queryExecution().executedPlan().toString()


def published_rank(terms, text):
    """The rank of alternatives, each a prefix, with the weights of words without labels."""
    at = defaultdict(set)
    for k, w in enumerate(re.findall("[0-9a-z가-힣_]+", text.lower()), 1):
        at[w].add(min(k, 16383))
    total, met = 0.0, 0
    for t in terms:
        own = [p for w, p in at.items() if w.startswith(t)]
        met += bool(own)
        total += sum(0.1 * sum(1 / (j * j) for j in range(1, min(len(p), 256) + 1)) / 1.64493406685 for p in own)
    return round(total / len(terms), 8) if met else None


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(5)
    vocabulary = "server serve servers log logs login 서버 서버가 net net_1 x9 a ab abc".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["log " * 400, "filler " * 16_500 + "login server server", "", "same log", "same log", "LOG, Log; log."]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(900, None, None)]
    return rows, spark.createDataFrame(rows, CHUNKS).repartition(3)


def test_keyword_rank_and_its_index_are_the_published_one(spark, words, tmp_path):
    rows, corpus = words
    asked = [(1, "server logs", None), (2, "서버 LOG log", None), (3, "!?", None), (4, None, None), (5, "absent", None), (6, "login x9 ab", None)]
    q = spark.createDataFrame(asked, QUERIES)
    terms = {1: ["server", "logs"], 2: ["서버", "log"], 6: ["login", "x9", "ab"]}
    want = []
    for qid, own in terms.items():
        scored = sorted((-s, i) for i, t, _ in rows if t is not None and (s := published_rank(own, t)) is not None)
        want += [(qid, i, -s, k) for k, (s, i) in enumerate(scored[: DEFAULT.axis_limit], 1)]
    index = R.postings(corpus.withColumns({"word": F.lit(1), "head": F.lit(2)}), str(tmp_path / "postings"))
    for found in (R.keyword_axis(q, corpus), R.keyword_postings(q, index)):
        assert sorted((r.qid, r.chunk_id, r.score, r.rn) for r in found.collect()) == sorted(want)
    assert max(len(r.positions) for r in index.collect()) == 256
    assert {r.positions[0] for r in index.filter("word in ('login', 'server') and chunk_id = 81").collect()} == {16383}
    assert "dynamicpruning" in read_files(R.keyword_postings(q, index)).lower()
    assert R.keyword_postings(q, R.postings(corpus.limit(0), str(tmp_path / "none"))).collect() == []


def test_postings_are_added_up_for_all_queries_at_once(spark, words, tmp_path):
    """No join makes a row a query and posting: the plan's rows are those of distinct terms, however Arrow cuts them."""
    q = spark.createDataFrame([(k, f"server logs {'ab' * (k % 3)} net", None) for k in range(40)] + [(90, "", None)], QUERIES)
    index = R.postings(words[1], str(tmp_path / "postings"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        want = sorted(map(tuple, R.keyword_axis(q, words[1]).collect()))
        for rows in ("1", "7", kept):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = R.keyword_postings(q, index)
            assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    plan = read_files(R.keyword_postings(q, index))
    assert "MapInArrow" in plan and "qid" not in plan.split("MapInArrow")[-1].split("\n", 1)[1]
    assert R.keyword_postings(q.filter("qid = 90"), index).collect() == []
    twice = R.postings(words[1].union(words[1]), str(tmp_path / "twice"))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, index.collect()))


def test_stages_are_counted_by_the_search_itself(spark, words):
    """The counted plan has the exchanges of the plain one, and the search gives the same rows."""
    from sediment.plans.retrieval import search

    q = spark.createDataFrame([(1, "server logs", None), (2, "서버 log", None), (3, "absent", None)], QUERIES)
    c = words[1].selectExpr("chunk_id", "'f' AS file_id", "chunk_id AS seq", "'t' AS doc_title", "1 AS page_no", "chunk_text", "embedding")
    counters = R.StageCounters()
    rows = R.keyword_axis(q, c)
    assert read_files(counters.of("plain", rows)).count("Exchange") == read_files(rows).count("Exchange")
    counters = R.StageCounters()
    got = search(spark, q, c, counters=counters).select("qid", "chunk_id", "place").collect()
    assert sorted(got) == sorted(search(spark, q, c).select("qid", "chunk_id", "place").collect())
    seen = counters.totals()
    assert list(seen) == ["candidates", "ranked", "final"] and seen["candidates"] >= seen["ranked"] >= seen["final"] == len(got) > 0


def test_search_reads_its_chunks_once(spark, words):
    """Axes, bodies and neighbours read what was written, not the plan that makes the chunks."""
    from sediment.plans.retrieval import search

    q = spark.createDataFrame([(1, "server logs", [1.0, 0.5]), (2, "서버 log", None)], QUERIES)
    c = words[1].selectExpr("chunk_id", "'f' AS file_id", "chunk_id AS seq", "'t' AS doc_title", "1 AS page_no", "chunk_text", "embedding")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    assert search(spark, q, c.mapInPandas(count, c.schema), exact=False).count() > 0
    assert made.value == len(words[0])


def test_counts_of_many_rows_are_those_of_each():
    from sediment.functions import grams

    rng = np.random.default_rng(4)
    for queries in ([], [[]], [[3, 5, 9], [], [5], list(range(0, 40, 3))]):
        index = grams.Index([np.array(v, np.int64) for v in queries])
        rows = [np.unique(rng.integers(0, 60, n)) for n in (0, 1, 7, 200)]
        want = [[len(set(v) & set(r.tolist())) for v in queries] for r in rows]
        assert index.counts(rows).tolist() == want
        places = np.repeat(np.arange(4), [len(r) for r in rows])
        sums, met = index.sums(places, np.concatenate(rows), np.full(len(places), 0.5), 4)
        assert met.tolist() == want and (sums * 2).tolist() == want


def vectors(n, dim, seed=3, groups=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    v = vectors(3000, 24)
    rows = [(k, "", x.tolist()) for k, x in enumerate(v)]
    rows += [(5000, "", None), (5001, "", [0.0] * 24), (5002, "", [1.0, 2.0]), (5003, "", rows[7][2]), (5004, "", rows[7][2])]
    corpus = spark.createDataFrame(rows, CHUNKS).repartition(4)
    asked = [(k, "", x.tolist()) for k, x in enumerate(vectors(30, 24, 9))] + [(70, "", rows[7][2]), (80, "", None), (81, "", [0.0] * 24), (82, "", [1.0])]
    return corpus, spark.createDataFrame(asked, QUERIES), V.build(corpus, str(tmp_path_factory.mktemp("v") / "cells"), 24, cells=40, sample=1000)


def test_index_holds_every_vector_and_gives_the_exact_answer(cells):
    corpus, q, index = cells
    assert index.rows.count() == 3002 == index.sizes.sum()
    want = sorted(map(tuple, R.vector_axis(q, corpus).collect()))
    for probes in (1, 4, 40):
        assert sorted(map(tuple, V.search(q, index, probes=probes).collect())) == want


def test_probes_read_few_cells_and_find_most(cells):
    corpus, q, index = cells
    found = V.search(q, index, probes=6, exact=False)
    want = {(r.qid, r.chunk_id) for r in R.vector_axis(q, corpus).collect()}
    assert len(want & {(r.qid, r.chunk_id) for r in found.collect()}) >= 0.9 * len(want)
    one = q.filter("qid = 3")
    plan = read_files(V.search(one, index, probes=2, exact=False))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    # a single query looks into two of forty cells, and its exact answer leaves cells out too
    units, _ = V._units([one.first().qvec])
    near = np.argsort(V._angles(units, index.centres)[0])[:2]
    assert index.sizes[near].sum() < 0.4 * index.sizes.sum()


def test_index_of_nothing(spark, tmp_path):
    none = V.build(spark.createDataFrame([], CHUNKS), str(tmp_path / "none"), 4)
    assert V.search(spark.createDataFrame([(1, "", [1.0, 0.0, 0.0, 0.0])], QUERIES), none).collect() == []
    few = V.build(spark.createDataFrame([(1, "", [1.0, 0.0]), (2, "", [1.0, 0.0])], CHUNKS), str(tmp_path / "few"), 2)
    assert [(r.chunk_id, r.rn) for r in V.search(spark.createDataFrame([(1, "", [2.0, 0.1])], QUERIES), few).orderBy("rn").collect()] == [(1, 1), (2, 2)]


def test_third_axis_is_the_best_stretch(spark):
    rng = random.Random(11)
    vocabulary = "server location table manual 서버 위치 error log restart the of in".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", "server location table"]
    corpus = spark.createDataFrame([(k, t, [1.0]) for k, t in enumerate(texts)] + [(999, None, [1.0])], CHUNKS).repartition(3)
    asked = {1: "server location table", 2: "서버 위치 error", 3: "unseen words here", 4: ""}
    q = spark.createDataFrame([(k, t, [1.0]) for k, t in asked.items()], QUERIES)
    for options in (DEFAULT, Options(axis_limit=5)):
        want = []
        for qid, text in asked.items():
            own = sorted((-round(s, 6), i) for i, t in enumerate(texts) if (s := brute_similarity(text, t)) >= 0.3)
            want += [(qid, i, -s, k) for k, (s, i) in enumerate(own[: options.axis_limit], 1)]
        assert sorted(map(tuple, R.trigram_axis(q, corpus, options).collect())) == sorted(want)
    fused = R.search_candidates(q.filter("qid = 1"), corpus).orderBy("rn").collect()
    best = {r.chunk_id for r in R.trigram_axis(q.filter("qid = 1"), corpus).filter("rn <= 5").collect()}
    assert best & {r.chunk_id for r in fused} and {r["mode"] for r in fused} == {"hybrid"}
