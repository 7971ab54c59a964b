"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import pii, similarity, text
from ..operators import retrieval as R
from ..operators import vector_index
from ..scratch import materialize, scratch_path
from . import corpus
from .corpus import CHUNKS_SQL, FILES_SQL, QUERIES_SQL
from .registry import load, query

_PUBLISHED = "pub AS (SELECT c.* FROM chunks c JOIN files f ON f.file_id = c.file_id WHERE f.status = 'published')"
_VEC = """vec AS (SELECT qid, chunk_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM (
  SELECT q.qid, c.chunk_id, round(1 - list_cosine_similarity(CAST(q.qvec AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS dist
  FROM queries q, pub c WHERE q.qvec IS NOT NULL AND c.embedding IS NOT NULL) QUALIFY rn <= 50)"""
#: The benchmark's texts have no Hangul, so no ending is stripped and SQL may leave that step out.
_TERMS = """qtok AS (SELECT qid, lower(regexp_replace(unnest(regexp_extract_all(query, '[0-9A-Za-z가-힣_.-]+')), '[^0-9A-Za-z가-힣_]', '', 'g')) AS term FROM queries),
terms AS (SELECT DISTINCT qid, term FROM qtok WHERE length(term) >= 2),
{words}"""
#: Positions of each word, 16383 being the last there is, and the weight they give it.
_WORDS = """{name} AS (SELECT {id}, word, (SELECT list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j)))) / 1.64493406685::DOUBLE AS weight FROM (
  SELECT {id}, word, least(count(DISTINCT least(pos, 16383)), 256) AS tf FROM (SELECT {id}, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT {id}, regexp_extract_all(lower({text}), '[0-9a-z가-힣_]+') AS ws FROM {rows})) GROUP BY 1, 2))"""
_TERMS = _TERMS.format(words=_WORDS.format(name="words", id="chunk_id", text="chunk_text", rows="pub"))
_KW = """kw AS (SELECT qid, chunk_id, score, terms, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rn FROM (
  SELECT t.qid, w.chunk_id, round(sum(w.weight) / any_value(t.n), 8) AS score, count(DISTINCT t.term) AS terms FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM terms) t JOIN words w ON starts_with(w.word, t.term) GROUP BY 1, 2) QUALIFY rn <= {limit})"""


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def _grams(s: str) -> str:
    """Of a text already squeezed."""
    return f"list_distinct(list_transform(range(1, greatest(length({s}) - 2, 1) + 1), lambda i: substr({s}, i, 3)))"


_TRI = f"""qs AS MATERIALIZED (SELECT qid, {_squeezed("query")} AS s FROM queries WHERE qvec IS NOT NULL), qg AS (SELECT qid, {_grams("s")} AS g FROM qs),
cs AS MATERIALIZED (SELECT chunk_id, {_squeezed("chunk_text")} AS s FROM pub), ci AS (SELECT chunk_id, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM cs),
cg AS (SELECT DISTINCT chunk_id, substr(s, i, 3) AS t FROM ci),
tri AS (SELECT qid, chunk_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS rn FROM (
  SELECT qid, chunk_id, round(count(*) / max(n), 6) AS sim FROM (SELECT qid, len(g) AS n, unnest(g) AS t FROM qg) q JOIN cg USING (t) GROUP BY 1, 2) WHERE sim >= 0.3 QUALIFY rn <= 50)"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.files(spark, sf_dir).filter("status = 'published'").select("file_id")
    return corpus.chunks(spark, sf_dir).join(own, "file_id", "left_semi")


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_VEC} SELECT qid, chunk_id, dist, rn FROM vec")
def vector_topk(spark, sf_dir):
    return R.vector_axis(corpus.queries(spark, sf_dir), published(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_VEC} SELECT qid, chunk_id, dist, rn FROM vec")
def vector_index_topk(spark, sf_dir):
    """The vector axis from an inverted file; cells that can't hold a nearer row are not read."""
    c, q = published(spark, sf_dir), corpus.queries(spark, sf_dir)
    return vector_index.search(q, vector_index.build(c, scratch_path(spark, "cells"), corpus.dimension(spark, sf_dir)))


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)} SELECT * FROM kw")
def keyword_prefix_topk(spark, sf_dir):
    return R.keyword_axis(corpus.queries(spark, sf_dir), published(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)} SELECT * FROM kw")
def keyword_postings_topk(spark, sf_dir):
    """The keyword axis from a positional index, of which only the partitions of the terms are read."""
    index = R.postings(published(spark, sf_dir), scratch_path(spark, "postings"))
    return R.keyword_postings(corpus.queries(spark, sf_dir), index)


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=25)} SELECT qid, chunk_id, rn, 'keyword' AS mode FROM kw")
def keyword_only_fallback(spark, sf_dir):
    no_vector = corpus.queries(spark, sf_dir).withColumn("qvec", F.lit(None).cast("array<float>"))
    return R.search_candidates(no_vector, published(spark, sf_dir)).select("qid", "chunk_id", "rn", "mode")


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TRI} SELECT qid, chunk_id, sim, rn FROM tri")
def trigram_containment_topk(spark, sf_dir):
    q = corpus.queries(spark, sf_dir).filter("qvec is not null")
    return R.trigram_axis(q, published(spark, sf_dir), exact=False)


_FUSED2 = """fused AS (SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
  round(coalesce(1.0::DOUBLE / (60 + v.rn), 0) + coalesce(1.0::DOUBLE / (60 + k.rn), 0), 10) AS score,
  round(coalesce(1.0::DOUBLE / (60 + v.rn), 0), 10) AS v_rrf, round(coalesce(1.0::DOUBLE / (60 + k.rn), 0), 10) AS k_rrf
  FROM vec v FULL OUTER JOIN kw k ON v.qid = k.qid AND v.chunk_id = k.chunk_id)"""
_FUSED3 = """fused AS (SELECT qid, chunk_id, round(coalesce(sum(p), 0), 10) AS score FROM (
  SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn) AS p FROM vec UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn) FROM kw UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn) FROM tri) GROUP BY 1, 2)"""


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_VEC}, {_TERMS}, {_KW.format(limit=50)}, {_FUSED2} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rn FROM fused QUALIFY rn <= 10")
def rrf_two_axis(spark, sf_dir):
    q, c = corpus.queries(spark, sf_dir), published(spark, sf_dir)
    return R.rank(R.fuse({"v": R.vector_axis(q, c), "k": R.keyword_axis(q, c)}), F.desc("score"), F.col("chunk_id"), limit=10)


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_VEC}, {_TERMS}, {_KW.format(limit=50)}, {_TRI}, {_FUSED3} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rn FROM fused QUALIFY rn <= 10")
def rrf_three_axis_containment(spark, sf_dir):
    q, c = corpus.queries(spark, sf_dir), published(spark, sf_dir)
    axes = {"v": R.vector_axis(q, c), "k": R.keyword_axis(q, c), "t": R.trigram_axis(q.filter("qvec is not null"), c, exact=False)}
    return R.rank(R.fuse(axes).select("qid", "chunk_id", "score"), F.desc("score"), F.col("chunk_id"), limit=10)


@query()
def rrf_three_axis(spark, sf_dir):
    """The fused search of the three axes, the third by best stretches."""
    q, c = corpus.queries(spark, sf_dir), published(spark, sf_dir)
    axes = {"v": R.vector_axis(q, c), "k": R.keyword_axis(q, c), "t": R.trigram_axis(q.filter("qvec is not null"), c)}
    return R.rank(R.fuse(axes), F.desc("score"), F.col("chunk_id"), limit=10)


_Q2 = "SELECT qid % 3 AS question, qid AS query_no, chunk_id, rn AS chunk_rank FROM kw"


@query(f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)}, c AS ({_Q2}),
u AS (SELECT *, row_number() OVER (PARTITION BY question, chunk_id ORDER BY query_no, chunk_rank) AS k FROM c QUALIFY k = 1)
SELECT question, query_no, chunk_id, chunk_rank, row_number() OVER (PARTITION BY question ORDER BY query_no, chunk_rank) AS pos FROM u QUALIFY pos <= 75""")
def multi_query_merge(spark, sf_dir):
    kw = R.keyword_axis(corpus.queries(spark, sf_dir), published(spark, sf_dir))
    rows = kw.select((F.col("qid") % 3).alias("question"), F.col("qid").alias("query_no"), "chunk_id", F.col("rn").alias("chunk_rank"))
    return R.merge_queries(rows.withColumn("rn", F.col("chunk_rank")), 75).select("question", "query_no", "chunk_id", "chunk_rank", "pos")


@query(f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)},
s AS (SELECT kw.qid, kw.chunk_id, kw.rn, round(kw.terms / (SELECT count(*) FROM terms t WHERE t.qid = kw.qid), 6) AS rerank_score FROM kw)
SELECT qid, chunk_id, rn, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rn) AS pos FROM s WHERE rerank_score >= 0.05 QUALIFY pos <= 10""")
def rerank_overlap(spark, sf_dir):
    q = R.bounded(corpus.queries(spark, sf_dir))
    kw = R.keyword_axis(q, published(spark, sf_dir))
    n = q.select("qid", F.size(F.array_distinct(F.transform(text.prefixes(F.col("query")), lambda x: F.lower(x)))).alias("n"))
    return R.rerank(kw.join(F.broadcast(n), "qid"), F.round(F.col("terms") / F.col("n"), 6), 10).select("qid", "chunk_id", "rn", "rerank_score", "pos")


@query(f"""WITH {CHUNKS_SQL}, {FILES_SQL}, {_PUBLISHED},
n AS (SELECT a.chunk_id, a.file_id, a.seq, string_agg(b.chunk_text, chr(10) ORDER BY b.seq, b.chunk_id) AS body, min(b.page_no) AS lo, max(b.page_no) AS hi, count(*) AS k
FROM chunks a JOIN chunks b ON a.file_id = b.file_id AND b.seq BETWEEN a.seq - 1 AND a.seq + 1 AND (a.chunk_id = b.chunk_id OR a.doc_title IS NOT DISTINCT FROM b.doc_title AND a.seq <> b.seq)
GROUP BY 1, 2, 3)
SELECT chunk_id, sha256(body) AS body_hash, CASE WHEN k > 1 THEN lo END AS first_page, CASE WHEN k > 1 THEN hi END AS last_page, k > 1 AS expanded FROM n""")
def neighbor_expand(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    hits = c.withColumn("qid", F.col("chunk_id"))
    out = R.expand_neighbors(hits, c, 1)
    return out.select("chunk_id", F.sha2("chunk_text", 256).alias("body_hash"), F.get("page_range", 0).alias("first_page"), F.get("page_range", 1).alias("last_page"), "expanded")


@query(f"""WITH s AS MATERIALIZED (SELECT doc_id, source, {_squeezed("text")} AS s FROM documents), g AS MATERIALIZED (SELECT doc_id, source, {_grams("s")} AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.g AS x, b.g AS y FROM g a JOIN g b ON a.source = b.source AND b.doc_id = a.doc_id + 20)
SELECT a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jac, round(len(list_intersect(x, y)) / len(x), 6) AS cont FROM p""")
def trigram_jaccard_pairs(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", similarity.trigrams(F.col("text")).alias("g"))
    other = d.select((F.col("doc_id") - 20).alias("doc_id"), "source", F.col("g").alias("y"), F.col("doc_id").alias("b"))
    return d.join(other, ["doc_id", "source"]).select(F.col("doc_id").alias("a"), "b", F.round(similarity.jaccard(F.col("g"), F.col("y")), 6).alias("jac"), F.round(similarity.containment(F.col("g"), F.col("y")), 6).alias("cont"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(n, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(similarity.cosine(F.col("embedding"), F.col("y")), 6).alias("cos"))


def search(spark: SparkSession, q: DataFrame, c: DataFrame, k: int = 5, options=DEFAULT, mask=pii.mask_accounts, counters: R.StageCounters | None = None, exact: bool = True) -> DataFrame:
    """Candidates, rerank by word overlap, near copies out, neighbours, masking, clipping: the whole search of a batch.

    ``counters`` counts candidates, ranked and final rows as the search runs.
    """
    k = options.top_k(k)
    # three axes, the bodies and the neighbours read the chunks, which may be a join
    c = materialize(c, "chunks")
    seen = counters.of if counters else lambda _, df: df
    found = materialize(seen("candidates", R.search_candidates(q, c, options, k, exact=exact)), "candidates")
    # the query set's size was checked by the axes; the trigrams of a chunk are made once
    bodies = found.join(c, "chunk_id").join(F.broadcast(q.select("qid", similarity.trigrams(F.col("query")).alias("__q"))), "qid")
    bodies = materialize(bodies.withColumn("__own", similarity.trigrams(F.col("chunk_text"))), "bodies")
    ranked = R.rerank(bodies, F.round(similarity.containment(F.col("__q"), F.col("__own")), 6), 2 * k, options).drop("__q")
    if counters:  # near copies are met by a join with what is ranked, which would count it twice
        ranked = materialize(seen("ranked", ranked), "ranked")
    kept = seen("final", R.drop_near_copies(ranked, k, options.dedup_similarity, F.col("__own")).drop("__own"))
    wide = R.expand_neighbors(kept, c, options.neighbor_window, options.result_max_chars)
    return wide.withColumn("chunk_text", text.clip(mask(F.col("chunk_text")), options.result_max_chars))


@query()
def full_search_pipeline(spark, sf_dir):
    return search(spark, corpus.queries(spark, sf_dir), published(spark, sf_dir)).select("qid", "chunk_id", "place", "mode", "rerank_score", "chunk_text", "expanded")


@query()
def full_search_containment(spark, sf_dir):
    """The whole search where the third axis is the share of the question's trigrams, which costs one count a chunk."""
    return search(spark, corpus.queries(spark, sf_dir), published(spark, sf_dir), exact=False).select("qid", "chunk_id", "place", "mode", "rerank_score", "chunk_text", "expanded")


@query()
def word_similarity_topk(spark, sf_dir):
    q = corpus.queries(spark, sf_dir).filter("qvec is not null")
    return R.trigram_axis(q, published(spark, sf_dir))


_COPIES = f"""r AS MATERIALIZED (SELECT kw.qid, kw.rn AS pos, kw.chunk_id, g FROM kw JOIN (SELECT chunk_id, {_grams("s")} AS g FROM (SELECT chunk_id, {_squeezed("chunk_text")} AS s FROM pub)) USING (chunk_id) WHERE kw.rn <= 20),
fold(qid, pos, kept) AS (SELECT DISTINCT qid, 0::BIGINT, [] :: STRUCT(chunk_id BIGINT, g VARCHAR[])[] FROM r
  UNION ALL SELECT f.qid, r.pos, CASE WHEN len(f.kept) >= 10 OR len(list_filter(f.kept, lambda k: len(list_intersect(k.g, r.g)) / (len(k.g) + len(r.g) - len(list_intersect(k.g, r.g))) >= 0.85)) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(chunk_id := r.chunk_id, g := r.g)) END
  FROM fold f JOIN r ON r.qid = f.qid AND r.pos = f.pos + 1)"""


@query(f"""WITH RECURSIVE {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)}, {_COPIES},
l AS (SELECT qid, kept FROM fold QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos DESC) = 1)
SELECT qid, unnest(list_transform(kept, lambda k: k.chunk_id)) AS chunk_id, unnest(range(1, len(kept) + 1)) AS place FROM l""")
def near_copies_dropped(spark, sf_dir):
    """The best twenty of the keyword axis without those too like one kept before, ten at most."""
    c = published(spark, sf_dir)
    ranked = R.keyword_axis(corpus.queries(spark, sf_dir), c).filter("rn <= 20").withColumnRenamed("rn", "pos").join(c.select("chunk_id", "chunk_text"), "chunk_id")
    return R.drop_near_copies(ranked, 10).select("qid", "chunk_id", "place")


_AXIS3 = """parts AS (SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn) AS p, 'v' AS a FROM vec UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn), 'k' FROM kw UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rn), 't' FROM tri),
fused AS (SELECT qid, chunk_id, round(sum(p), 10) AS score, round(coalesce(sum(p) FILTER (WHERE a = 'v'), 0), 10) AS v_rrf, round(coalesce(sum(p) FILTER (WHERE a = 'k'), 0), 10) AS k_rrf, round(coalesce(sum(p) FILTER (WHERE a = 't'), 0), 10) AS t_rrf FROM parts GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rn FROM fused QUALIFY rn <= 10)"""


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_VEC}, {_TERMS}, {_KW.format(limit=50)}, {_TRI}, {_AXIS3} SELECT t.*, substr(coalesce(p.chunk_text, ''), 1, 300) AS chunk_text FROM top t JOIN pub p USING (chunk_id)")
def search_diagnostics(spark, sf_dir):
    return R.diagnostics(corpus.queries(spark, sf_dir), published(spark, sf_dir), exact=False)


_NTERMS = "nt AS (SELECT qid, count(*) AS n FROM terms GROUP BY 1)"


@query(f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)}, {_NTERMS},
s AS (SELECT kw.qid, kw.rn, round(kw.terms / nt.n, 6) AS score FROM kw JOIN nt USING (qid)),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rn) AS pos FROM s WHERE score >= 0.05)
SELECT kw.qid, count(*) AS candidates, any_value(coalesce(r.n, 0)) AS ranked, any_value(least(coalesce(r.n, 0), 10)) AS final FROM kw LEFT JOIN (SELECT qid, count(*) AS n FROM r GROUP BY 1) r USING (qid) GROUP BY 1""")
def search_stage_counts(spark, sf_dir):
    """Each stage is counted and read by the next, so the corpus is searched once and its candidates are written."""
    q = R.bounded(corpus.queries(spark, sf_dir))
    kw = materialize(R.keyword_axis(q, published(spark, sf_dir)), "keyword")
    n = q.select("qid", F.size(F.array_distinct(F.transform(text.prefixes(F.col("query")), lambda x: F.lower(x)))).alias("n"))
    ranked = R.rerank(kw.join(F.broadcast(n), "qid"), F.round(F.col("terms") / F.col("n"), 6), DEFAULT.axis_limit)
    return R.stage_counts(candidates=kw, ranked=ranked, final=ranked.filter("pos <= 10"))


@query(f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {QUERIES_SQL}, {_PUBLISHED}, {_TERMS}, {_KW.format(limit=50)}, {_NTERMS},
s AS (SELECT kw.qid, kw.rn, round(kw.terms / nt.n, 6) AS score FROM kw JOIN nt USING (qid)), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rn) AS pos FROM s WHERE score >= 0.05)
SELECT (SELECT count(*) FROM kw) AS candidates, (SELECT count(*) FROM r) AS ranked, (SELECT count(*) FROM r WHERE pos <= 10) AS final""")
def search_stage_totals(spark, sf_dir):
    """The counters of one running search."""
    q, counters = R.bounded(corpus.queries(spark, sf_dir)), R.StageCounters()
    kw = counters.of("candidates", R.keyword_axis(q, published(spark, sf_dir)))
    n = q.select("qid", F.size(F.array_distinct(F.transform(text.prefixes(F.col("query")), lambda x: F.lower(x)))).alias("n"))
    ranked = counters.of("ranked", R.rerank(kw.join(F.broadcast(n), "qid"), F.round(F.col("terms") / F.col("n"), 6), DEFAULT.axis_limit))
    materialize(counters.of("final", ranked.filter("pos <= 10")), "searched")
    return spark.createDataFrame([counters.totals()], "candidates long, ranked long, final long")


_ASKED = """asked AS (SELECT item_id AS qid, b.text AS whole, CASE item_id % 5 WHEN 0 THEN 'execute' ELSE 'search' END AS mode,
  CASE item_id % 3 WHEN 0 THEN ['manual'] WHEN 1 THEN ['voc'] ELSE ['manual', 'voc'] END AS sources, CASE WHEN item_id % 4 = 1 THEN 'zzqx ' || CAST(item_id AS VARCHAR) ELSE b.text END AS query FROM benchmark b)"""


def _found(name: str, asked: str, docs: str) -> str:
    """The best three of the keyword axis, ids break ties."""
    return f"""{name} AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM (SELECT t.qid, w.id, round(sum(w.weight) / any_value(t.n), 8) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT DISTINCT qid, term FROM (SELECT qid, lower(regexp_replace(unnest(regexp_extract_all({asked}, '[0-9A-Za-z가-힣_.-]+')), '[^0-9A-Za-z가-힣_]', '', 'g')) AS term FROM asked WHERE mode <> 'execute') WHERE length(term) >= 2)) t
  JOIN {docs} w ON starts_with(w.word, t.term) GROUP BY 1, 2) QUALIFY rn <= 3)"""


@query(f"""WITH {FILES_SQL}, {CHUNKS_SQL}, {corpus.RECORDS_SQL}, {_PUBLISHED}, {_ASKED},
{_WORDS.format(name="mw", id="id", text="t", rows="(SELECT chunk_id AS id, chunk_text AS t FROM pub)")}, {_WORDS.format(name="vw", id="id", text="t", rows="(SELECT id, question || chr(10) || answer AS t FROM records)")},
{_found("m1", "query", "mw")}, {_found("v1", "query", "vw")}, {_found("m3", "query || ' ' || whole", "mw")}, {_found("v3", "query || ' ' || whole", "vw")},
s1 AS (SELECT qid, 'manual' AS source, id, rn FROM m1 JOIN asked USING (qid) WHERE list_contains(sources, 'manual') UNION ALL SELECT qid, 'voc', id, rn FROM v1 JOIN asked USING (qid) WHERE list_contains(sources, 'voc')),
l2 AS (SELECT * FROM asked WHERE mode <> 'execute' AND qid NOT IN (SELECT qid FROM s1)),
s2 AS (SELECT qid, 'manual' AS source, id, rn FROM m1 JOIN l2 USING (qid) WHERE sources = ['voc'] UNION ALL SELECT qid, 'voc', id, rn FROM v1 JOIN l2 USING (qid) WHERE sources = ['manual']),
l3 AS (SELECT * FROM l2 WHERE qid NOT IN (SELECT qid FROM s2)),
s3 AS (SELECT qid, 'manual' AS source, id, rn FROM m3 JOIN l3 USING (qid) UNION ALL SELECT qid, 'voc', id, rn FROM v3 JOIN l3 USING (qid))
SELECT *, CAST(1 AS BIGINT) AS step FROM s1 UNION ALL SELECT *, CAST(2 AS BIGINT) FROM s2 UNION ALL SELECT *, CAST(3 AS BIGINT) FROM s3""")
def prefetch_routing(spark, sf_dir):
    """Chosen sources, then the other, then both with the merged query; every fifth question is to be executed."""
    i = F.col("item_id")
    sources = F.when(i % 3 == 0, F.array(F.lit("manual"))).when(i % 3 == 1, F.array(F.lit("voc"))).otherwise(F.array(F.lit("manual"), F.lit("voc")))
    bare = F.when(i % 4 == 1, F.concat(F.lit("zzqx "), i.cast("string"))).otherwise(F.col("text"))
    asked = load(spark, sf_dir, "benchmark").select(i.alias("qid"), F.when(i % 5 == 0, "execute").otherwise("search").alias("mode"), sources.alias("sources"), bare.alias("query"), F.concat_ws(" ", bare, "text").alias("merged"))
    r = corpus.records(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.concat_ws("\n", "question", "answer").alias("chunk_text"))
    by = lambda c: lambda q: R.keyword_axis(q, c, limit=3).select("qid", F.col("chunk_id").alias("id"), "rn")
    return R.prefetch(asked, by(published(spark, sf_dir)), by(r))


@query()
def record_search_pipeline(spark, sf_dir):
    r = corpus.records(spark, sf_dir)
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.search_records(corpus.queries(spark, sf_dir), r.join(e, "id", "left"))
