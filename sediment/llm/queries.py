"""The thin queries of the corpus operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, exact_dedup, fill_middle, filter_audit, language_id, license_oracle, license_scan, line_dedup, packing, quality_rules, secret_scan, simhash_dedup, source_mix, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s")
    s, of = F.col("s"), secret_scan.of_kind
    return found.select(
        "doc_id",
        *[F.size(of(s, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(of(s, "assign", "access", "hex")), 256).alias("base_sha256"),
        secret_scan.joined(s).alias("spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_rules.quality_cascade(table(spark, sf_dir, "documents"), counts=counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *counts, failed.alias("base_failed"), "kept")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    rebuilt = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = best_fit.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return best_fit.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_secret_scan, op2_line_dedup, op3_source_mix, op4_packing, op5_warc, op6_simhash_dedup, op7_exact_dedup, op8_license_scan, op9_language_id, op10_quality_rules, op11_fill_middle, op12_best_fit_packing, op13_filter_audit, pipeline)
    return {f.__name__: f for f in named}


_WS = r"[ \t\n\x0B\x0C\r]"

_OP2 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(regexp_replace(line, '^[ \\t\\n\\x0B\\x0C\\r]+|[ \\t\\n\\x0B\\x0C\\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g USING (rid)
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN f.first IS NOT NULL AND q.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND q.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND q.payload_bytes >= 100
"""

_OP7 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY t.n ORDER BY t.doc_id NULLS LAST) = 1 AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\x0C\r]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\x0C\r]')) AS ls FROM d),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
x AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM tri),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM x) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) AS kept
FROM v
"""


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ 	
]+') AS ws, row_number() OVER () AS rid FROM d),
least_id AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(g.toxic, 0) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(low < w.doc_id, low IS NOT NULL)] AS fails FROM w JOIN least_id USING (t) LEFT JOIN g ON g.doc_id = w.doc_id),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, e.i, h.i] AS o FROM letters a JOIN letters b ON b.i <> a.i JOIN letters c ON c.i NOT IN (a.i, b.i) JOIN letters e ON e.i NOT IN (a.i, b.i, c.i) JOIN letters h ON h.i NOT IN (a.i, b.i, c.i, e.i)),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders),
x AS (SELECT part, filter_order, step, n, good, toxic, fails[o[step]] AS own, len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS single FROM m, s),
r AS (SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND own), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE own AND single), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND own AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND own AND toxic = 1), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY 1, 2, 3)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op5_warc": _OP5, "op7_exact_dedup": _OP7, "op8_license_scan": license_oracle.sql(), "op10_quality_rules": _OP10, "op11_fill_middle": _OP11, "op13_filter_audit": _OP13}
