"""Filters, joins, aggregates, paging, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii
from ..operators import relational as O
from ..operators.keyed_table import KeyedTable
from ..scratch import scratch_path
from . import corpus
from .corpus import CHUNKS_SQL, FILES_SQL, RECORDS_SQL
from .registry import load, query


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL} SELECT c.file_id, f.title, f.version, count(*) AS n, count(c.embedding) AS embedded FROM chunks c JOIN files f ON c.file_id = f.file_id WHERE f.status = 'published' GROUP BY 1, 2, 3")
def published_chunks(spark, sf_dir):
    f = corpus.files(spark, sf_dir).filter("status = 'published'")
    return corpus.chunks(spark, sf_dir).join(f, "file_id").groupBy("file_id", "title", "version").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%the%' AND lang = 'en' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50 OFFSET 20")
def optional_ilike_page(spark, sf_dir):
    def by(term: str | None, lang: str | None):
        d = load(spark, sf_dir, "documents")
        d = d if term is None else d.filter(F.col("text").ilike(f"%{term}%"))
        return d if lang is None else d.filter(F.col("lang") == lang)

    return O.page(by("the", "en"), [F.desc_nulls_last("n_chars"), F.col("doc_id")], 20, 50).select("doc_id", "source", "n_chars")


@query(r"SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\'")
def ilike_escaped(spark, sf_dir):
    escaped = "".join("\\" + c if c in "%_\\" else c for c in "%%%")
    return load(spark, sf_dir, "documents").filter(F.col("text").ilike(f"%{escaped}%")).select("doc_id")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, embed_model FROM chunks WHERE embedding IS NULL OR embed_model IS DISTINCT FROM 'bge-m3' OR embed_dim IS DISTINCT FROM 64 ORDER BY chunk_id LIMIT 1000")
def stale_embeddings(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    stale = F.col("embedding").isNull() | ~F.col("embed_model").eqNullSafe(F.lit("bge-m3")) | ~F.col("embed_dim").eqNullSafe(F.lit(64))
    return O.page(c.filter(stale), [F.col("chunk_id")], 0, 1000, 1000).select("chunk_id", "embed_model")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE embedding IS NULL")
def unlimited_backlog(spark, sf_dir):
    """A limit of 0 takes all that is waiting."""
    return O.first_rows(corpus.chunks(spark, sf_dir).filter("embedding is null").select("chunk_id"), [F.col("chunk_id")], 0)


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 72 HOUR")
def retention_purge(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    return O.retained(e, "ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 72)


@query("SELECT event_id, user_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 10 DAY END IS NULL OR CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 10 DAY END > TIMESTAMP '2024-01-25 00:00:00'")
def ttl_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAY")))
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return e.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("event_id", "user_id")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, file_id, seq FROM chunks WHERE (file_id, seq) IN (SELECT file_id, seq + 1 FROM chunks WHERE chunk_id % 11 = 0)")
def composite_key_semi(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir).select("chunk_id", "file_id", "seq")
    keys = c.filter("chunk_id % 11 = 0").select("file_id", (F.col("seq") + 1).alias("seq"))
    return c.join(keys, ["file_id", "seq"], "left_semi").select("chunk_id", "file_id", "seq")


@query(f"WITH {FILES_SQL}, {CHUNKS_SQL} SELECT chunk_id, file_id FROM chunks WHERE file_id NOT IN (SELECT file_id FROM files WHERE status = 'archived')")
def delete_cascade(spark, sf_dir):
    gone = corpus.files(spark, sf_dir).filter("status = 'archived'")
    return O.delete(corpus.chunks(spark, sf_dir), gone, ["file_id"]).select("chunk_id", "file_id")


@query(f"WITH {RECORDS_SQL} SELECT id, batch_id FROM records WHERE batch_id NOT IN ('batch-1', 'batch-4')")
def delete_any(spark, sf_dir):
    return corpus.records(spark, sf_dir).filter(~F.col("batch_id").isin("batch-1", "batch-4")).select("id", "batch_id")


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')")
def regex_not_match(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")).select("doc_id")


@query(f"""WITH {RECORDS_SQL} SELECT batch_id, count(*) AS offered, count(*) FILTER (WHERE coalesce(trim(question), '') <> '' AND coalesce(trim(answer), '') <> '' AND (handled_by IS NULL OR handled_by NOT IN ('user'))) AS kept FROM records GROUP BY 1""")
def required_columns(spark, sf_dir):
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    keep = full("question") & full("answer") & (F.col("handled_by").isNull() | ~F.col("handled_by").isin("user"))
    return corpus.records(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("offered"), F.count_if(keep).alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN true ELSE list_has_any(['BUILDING', 'MACHINERY'], [c_mktsegment]) END AS allowed FROM customer")
def role_gate(spark, sf_dir):
    required = F.when(F.col("c_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    allowed = (F.size(required) == 0) | F.arrays_overlap(required, F.array("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", allowed.alias("allowed"))


@query(f"WITH {RECORDS_SQL} SELECT id, md5(question || ' ' || answer) AS pair_hash, coalesce(nullif(handled_by, ''), 'none') AS handled FROM records")
def computed_columns(spark, sf_dir):
    return corpus.records(spark, sf_dir).select("id", F.md5(F.concat_ws(" ", "question", "answer")).alias("pair_hash"), F.coalesce(F.nullif("handled_by", F.lit("")), F.lit("none")).alias("handled"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN c_name WHEN length(c_name) <= 4 THEN '••••' ELSE '••••••••' || right(c_name, 4) END AS shown FROM customer")
def secret_mask(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", pii.mask_secret(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("shown"))


@query("SELECT event_id, CASE WHEN v = '' THEN true ELSE lower(v) IN ('1', 'true', 'yes', 'on', 'y') END AS flag FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Yes' WHEN 2 THEN 'off' WHEN 3 THEN 'TRUE' ELSE 'n' END AS v FROM events)")
def bool_parse(spark, sf_dir):
    k = F.col("event_id") % 5
    v = F.when(k == 0, "").when(k == 1, "Yes").when(k == 2, "off").when(k == 3, "TRUE").otherwise("n")
    return load(spark, sf_dir, "events").select("event_id", F.when(v == "", True).otherwise(F.lower(v).isin("1", "true", "yes", "on", "y")).alias("flag"))


_AXES = "a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents QUALIFY rn <= 50), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(text), doc_id) AS rn FROM documents QUALIFY rn <= 50)"


@query(f"WITH {_AXES}, f AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.rn), 0) + coalesce(1.0::DOUBLE / (60 + b.rn), 0), 10) AS score FROM a FULL OUTER JOIN b ON a.id = b.id) SELECT f.id, f.score, d.lang, d.source FROM f JOIN documents d ON d.doc_id = f.id")
def full_outer_axes(spark, sf_dir):
    d = load(spark, sf_dir, "documents")

    # the top 50 by a limit, so that no task sorts all rows; only they are numbered
    a = d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    b = d.select("doc_id", F.md5("text").alias("h")).orderBy("h", "doc_id").limit(50)
    a = a.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("ra"))
    b = b.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy("h", "doc_id")).alias("rb"))
    part = lambda c: F.coalesce(F.lit(1.0) / (60 + F.col(c)), F.lit(0.0))
    fused = a.join(b, "id", "full").select("id", F.round(part("ra") + part("rb"), 10).alias("score"))
    return fused.join(d.select(F.col("doc_id").alias("id"), "lang", "source"), "id")


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE handled_by = 'user') AS by_user, count(*) FILTER (WHERE handled_by = 'operator') AS by_operator, count(*) FILTER (WHERE handled_by IS NULL) AS pending, count(*) FILTER (WHERE resolved) AS resolved FROM records")
def label_counts_filter(spark, sf_dir):
    h = F.col("handled_by")
    return corpus.records(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(h == "user").alias("by_user"), F.count_if(h == "operator").alias("by_operator"), F.count_if(h.isNull()).alias("pending"), F.count_if("resolved").alias("resolved")
    )


@query(f"WITH {RECORDS_SQL} SELECT coalesce(handled_by, 'null') AS label, count(*) AS n FROM records GROUP BY 1")
def label_histogram(spark, sf_dir):
    return corpus.records(spark, sf_dir).groupBy(F.coalesce("handled_by", F.lit("null")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RECORDS_SQL} SELECT batch_id, max(source_file) AS source_file, count(*) AS n, min(id) AS first_id FROM records GROUP BY batch_id ORDER BY min(id) DESC")
def batch_listing(spark, sf_dir):
    return corpus.records(spark, sf_dir).groupBy("batch_id").agg(F.max("source_file").alias("source_file"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("first_id"))


@query(f"WITH {CHUNKS_SQL} SELECT embed_model, embed_dim, count(*) AS n FROM chunks GROUP BY 1, 2")
def embedding_by_model(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).groupBy("embed_model", "embed_dim").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT r_name || '/' || n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'new') SELECT t.title, coalesce(max(f.v), 0) + 1 AS next_version FROM t LEFT JOIN (SELECT r_name || '/' || n_name AS title, CAST(n_nationkey % 4 AS BIGINT) AS v FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0) f ON f.title = t.title GROUP BY 1")
def next_version(spark, sf_dir):
    named = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("title"), "n_nationkey")
    wanted = named.select("title").unionByName(spark.createDataFrame([("new",)], "title string"))
    have = named.filter("n_nationkey % 3 <> 0").select("title", (F.col("n_nationkey") % 4).cast("long").alias("v"))
    return wanted.join(have, "title", "left").groupBy("title").agg((F.coalesce(F.max("v"), F.lit(0)) + 1).alias("next_version"))


@query("SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS total_us, date_diff('microsecond', min(ts), min(ts) FILTER (WHERE event_type = 'click')) AS first_us, count(*) FILTER (WHERE event_type = 'purchase') AS calls, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS call_ms FROM events GROUP BY 1")
def request_rollup(spark, sf_dir):
    ms = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    first = F.min(F.when(F.col("event_type") == "click", F.col("ts")))
    call = F.col("event_type") == "purchase"
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        ms(F.min("ts"), F.max("ts")).alias("total_us"), ms(F.min("ts"), first).alias("first_us"), F.count_if(call).alias("calls"), F.round(F.coalesce(F.sum(F.when(call, F.col("value"))), F.lit(0.0)), 4).alias("call_ms")
    )


@query("SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(round_even(length(text) / 2.7, 0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def prompt_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.rint(F.length("text") / F.lit(2.7)).cast("long")).alias("tokens"))


_DELTA = "delta AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal, 1 AS o FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, c_name || '**', c_acctbal + 2, 2 FROM customer WHERE c_custkey % 14 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, 1 FROM customer WHERE c_custkey % 50 = 0)"


def _delta(c):
    part = lambda m, mark, plus, o, shift=0: c.filter(F.col("c_custkey") % m == 0).select((F.col("c_custkey") + shift).alias("c_custkey"), F.concat("c_name", F.lit(mark)).alias("c_name"), (F.col("c_acctbal") + plus).alias("c_acctbal"), F.lit(o).alias("__order"))
    return part(7, "*", 1, 1).unionByName(part(14, "**", 2, 2)).unionByName(part(50, "", 0, 1, 1_000_000))


@query("""WITH delta AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 70 = 0 AND o_orderkey <> 0),
u AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta) UNION ALL SELECT * FROM delta)
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM u""")
def upsert_in_place(spark, sf_dir):
    """Orders as a table in files, changed by an upsert and then by a conditional update."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    twice = o.filter(k % 50 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    table = KeyedTable(scratch_path(spark, "orders"), ("o_orderkey",), o.schema, 16)
    table.create(o)
    table.upsert(twice.unionByName(o.filter((k % 70 == 0) & (k != 0)).select((-k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")))
    table.update(spark, F.col("o_totalprice") > 400_000, {"o_orderstatus": F.lit("big")})
    return table.read(spark)


@query(f"WITH {_DELTA}, u AS (SELECT c_custkey, c_name, c_acctbal, 0 AS o FROM customer UNION ALL SELECT * FROM delta) SELECT c_custkey, c_name, c_acctbal FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o DESC) = 1")
def upsert_latest(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return O.upsert(c, _delta(c), ["c_custkey"])


@query(f"WITH {_DELTA} SELECT outcome, count(*) AS n FROM (SELECT DISTINCT d.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM delta d LEFT JOIN customer c ON c.c_custkey = d.c_custkey) GROUP BY 1")
def upsert_outcome(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return O.upsert_outcome(c, _delta(c), ["c_custkey"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN status = 'draft' THEN 'published' ELSE status END AS status, CASE WHEN status = 'draft' THEN TIMESTAMP '2024-02-01 00:00:00' END AS published_at FROM files")
def conditional_update(spark, sf_dir):
    f, draft = corpus.files(spark, sf_dir), F.col("status") == "draft"
    return f.select("file_id", F.when(draft, "published").otherwise(F.col("status")).alias("status"), F.when(draft, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("published_at"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY p_name, p_partkey), p_name FROM part")
def append_ids(spark, sf_dir):
    base = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return O.append_with_ids(base, new, "id", ["name", "p_partkey"])


@query("SELECT substr(sha256(text), 1, 16) AS key, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def content_addressed(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("key")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))


@query("WITH k AS (SELECT doc_id, sha256('srv|bge-m3|64|2|' || substr(text, 1, 4000)) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 4 = 0)")
def embedding_cache_missing(spark, sf_dir):
    k = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("srv"), F.lit("bge-m3"), F.lit("64"), F.lit("2"), F.substring("text", 1, 4000)), 256).alias("key"))
    return k.join(k.filter("doc_id % 4 = 0").select("key").distinct(), "key", "left_anti").select("doc_id", "key")


@query("SELECT CAST(200 AS BIGINT) AS \"offset\", count(*) AS total, least(50, greatest(count(*) - 200, 0)) AS returned, count(*) > 250 AS has_more, 200 + least(50, greatest(count(*) - 200, 0)) AS next_offset FROM customer")
def paging_envelope(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return O.envelope(c, O.page(c, [F.col("c_custkey")], 200, 50), 200)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 8")
def series_cap(spark, sf_dir):
    return O.last_n(load(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 8).select("o_orderpriority", "o_orderkey", "o_totalprice")
