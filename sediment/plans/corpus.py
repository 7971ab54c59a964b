"""Stand-ins over the driver's tables: files, chunks, vectors, queries, records and turns.

A file is a source, a chunk a document, its title the language; vectors meet
documents by id, so that some chunks have none. The same in SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import load

FILES_SQL = """files AS (SELECT source AS file_id, 'Title ' || source AS title, CASE WHEN source IN ('src3', 'src7') THEN 'archived' WHEN source = 'src5' THEN 'draft' ELSE 'published' END AS status,
  CAST(max(doc_id) % 3 + 1 AS BIGINT) AS version, count(*) AS n_chunks FROM documents GROUP BY source)"""
CHUNKS_SQL = """chunks AS (SELECT d.doc_id AS chunk_id, d.source AS file_id, CAST(floor(d.doc_id / 20) AS BIGINT) AS seq, d.lang AS doc_title, CAST(d.doc_id % 7 + 1 AS BIGINT) AS page_no,
  d.text AS chunk_text, e.embedding, CASE WHEN e.embedding IS NULL THEN NULL WHEN d.doc_id % 5 = 0 THEN 'old-model' ELSE 'bge-m3' END AS embed_model, len(e.embedding) AS embed_dim
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
QUERIES_SQL = """queries AS (SELECT b.item_id AS qid, b.text AS query, e.embedding AS qvec FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id * 7 + 3)"""
TURNS_SQL = """turns AS (SELECT conv_id * 100 + turn AS id, conv_id, CAST(conv_id % 17 AS VARCHAR) AS user_id, turn, role, text AS content FROM conversations)"""
RECORDS_SQL = """records AS (SELECT q.conv_id * 100 + q.turn AS id, q.text AS question, a.text AS answer, 'batch-' || CAST(q.conv_id % 9 AS VARCHAR) AS batch_id, q.conv_id % 2 = 0 AS resolved,
  CASE q.conv_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'operator' WHEN 2 THEN '' END AS handled_by, 'file-' || CAST(q.conv_id % 3 AS VARCHAR) AS source_file
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("file_id")).agg((F.max("doc_id") % 3 + 1).cast("int").alias("version"), F.count(F.lit(1)).alias("n_chunks"))
    status = F.when(F.col("file_id").isin("src3", "src7"), "archived").when(F.col("file_id") == "src5", "draft").otherwise("published")
    return per.select("file_id", F.concat(F.lit("Title "), "file_id").alias("title"), status.alias("status"), "version", "n_chunks")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = F.when(F.col("embedding").isNull(), None).when(F.col("doc_id") % 5 == 0, "old-model").otherwise("bge-m3")
    return d.join(e, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_id"), F.floor(F.col("doc_id") / 20).alias("seq"), F.col("lang").alias("doc_title"),
        (F.col("doc_id") % 7 + 1).cast("int").alias("page_no"), F.col("text").alias("chunk_text"), "embedding", model.alias("embed_model"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embed_dim"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, whole, is a question."""
    b, e = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return b.join(e, F.col("vec_id") == F.col("item_id") * 7 + 3, "left").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.col("embedding").alias("qvec"))


def dimension(spark: SparkSession, sf_dir: str) -> int:
    """The commonest dimension of the vectors."""
    first = load(spark, sf_dir, "embeddings").filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", (F.col("conv_id") % 17).cast("string").alias("user_id"), "turn", "role", F.col("text").alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    k = F.col("conv_id") % 4
    return q.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn") - 1).alias("id"), "question", "answer", F.concat(F.lit("batch-"), (F.col("conv_id") % 9).cast("string")).alias("batch_id"), (F.col("conv_id") % 2 == 0).alias("resolved"),
        F.when(k == 0, "user").when(k == 1, "operator").when(k == 2, "").alias("handled_by"), F.concat(F.lit("file-"), (F.col("conv_id") % 3).cast("string")).alias("source_file"),
    )
