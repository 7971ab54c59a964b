"""Memory, budgets, classification and grounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import answers, memory
from ..operators import relational as O
from . import corpus
from .corpus import CHUNKS_SQL, RECORDS_SQL, TURNS_SQL
from .registry import load, query


@query(f"WITH {TURNS_SQL} SELECT id, conv_id, role FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id, user_id ORDER BY id DESC) <= 3")
def recent_turns(spark, sf_dir):
    return memory.recent(corpus.turns(spark, sf_dir), 3).select("id", "conv_id", "role")


@query("WITH m AS (SELECT event_id AS id, user_id, ts AS updated_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 10 DAY END AS expires_at FROM events) SELECT id, user_id FROM m WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) <= 5")
def long_term_recent(spark, sf_dir):
    m = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("expires_at"))
    return memory.long_term(m, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 5).select("id", "user_id")


_ASKS = """m AS (SELECT e.vec_id AS id, e.vec_id % 20 AS user_id, v.ts AS updated_at, CASE WHEN e.vec_id % 3 <> 0 THEN v.ts + INTERVAL 10 DAY END AS expires_at, CASE WHEN e.vec_id % 11 <> 0 THEN e.embedding END AS embedding FROM embeddings e JOIN events v ON v.event_id = e.vec_id),
asks AS (SELECT vec_id AS ask_id, vec_id % 20 AS user_id, CASE WHEN vec_id % 2 = 0 THEN embedding END AS vector FROM embeddings WHERE vec_id % 25 < 2),
met AS (SELECT a.ask_id, a.user_id, m.id, m.updated_at, a.vector IS NULL AS recent, CASE WHEN a.vector IS NOT NULL AND m.embedding IS NOT NULL THEN round(1 - list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(a.vector AS DOUBLE[])), 6) + 0.0 END AS dist
  FROM m JOIN asks a ON a.user_id = m.user_id WHERE m.expires_at IS NULL OR m.expires_at > TIMESTAMP '2024-01-25 00:00:00')"""


@query(f"WITH {_ASKS} SELECT ask_id, user_id, id, dist, row_number() OVER (PARTITION BY ask_id ORDER BY dist, CASE WHEN recent THEN updated_at END DESC, CASE WHEN recent THEN -id ELSE id END) AS rn FROM met WHERE recent OR dist IS NOT NULL QUALIFY rn <= 5")
def long_term_recalled(spark, sf_dir):
    """Two asks a block of 25 vectors, every other by a vector; entries and vectors meet events by id."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20).alias("user_id"))
    asks = e.filter("vec_id % 25 < 2").select(F.col("vec_id").alias("ask_id"), "user_id", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("vector"))
    m = e.join(load(spark, sf_dir, "events").select("event_id", "ts"), F.col("event_id") == F.col("vec_id"))
    m = m.select(F.col("vec_id").alias("id"), "user_id", F.col("ts").alias("updated_at"), F.when(F.col("vec_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("expires_at"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"))
    return memory.recalled(m, asks, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("SELECT conv_id, count(*) AS offered, count(*) FILTER (WHERE turn % 3 <> 0 AND trim(text) <> '') AS stored FROM conversations GROUP BY 1")
def turn_counters(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, "  \n").otherwise(F.col("text")).alias("content"))
    return memory.counters(c)


@query(f"WITH {TURNS_SQL}, o AS (SELECT DISTINCT conv_id, conv_id * 100 + 2 AS upto0 FROM turns WHERE conv_id % 2 = 0) SELECT t.conv_id, t.user_id, count(*) AS n, max(t.id) AS upto FROM turns t LEFT JOIN o ON o.conv_id = t.conv_id WHERE t.id > coalesce(o.upto0, 0) GROUP BY 1, 2 HAVING count(*) >= 4")
def pending_summary(spark, sf_dir):
    t = corpus.turns(spark, sf_dir)
    o = t.filter("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") * 100 + 2).alias("summarized_upto")).distinct()
    return memory.pending(t, o, 4)


@query(f"WITH {TURNS_SQL}, p AS (SELECT conv_id, max(id) AS upto FROM turns WHERE id > 0 GROUP BY 1 HAVING count(*) >= 4) SELECT conv_id, upto AS summarized_upto FROM p UNION ALL SELECT DISTINCT conv_id, conv_id * 100 + 2 FROM turns WHERE conv_id % 2 = 0 AND conv_id NOT IN (SELECT conv_id FROM p)")
def advance_offsets(spark, sf_dir):
    t = corpus.turns(spark, sf_dir)
    o = t.filter("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") * 100 + 2).alias("summarized_upto")).distinct()
    return memory.advance(o, memory.pending(t, o.limit(0), 4))


@query(f"WITH {TURNS_SQL} SELECT id FROM turns WHERE user_id NOT IN ('3', '5')")
def forget_users(spark, sf_dir):
    gone = spark.createDataFrame([("3",), ("5",)], "user_id string")
    return memory.forget(gone, corpus.turns(spark, sf_dir))[0].select("id")


@query("SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS thread, count(*) AS n FROM events GROUP BY 1")
def day_threads(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(memory.day_thread(F.col("user_id").cast("string"), F.col("ts")).alias("thread")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT * FROM conversations WHERE role <> 'system'), g AS (SELECT conv_id, count(*) AS n, max(length(text)) AS longest, sum(length(text)) AS total, arg_max(role, turn) AS last FROM o GROUP BY 1) SELECT conv_id, CASE WHEN n > 6 THEN 'messages' WHEN longest > 700 THEN 'length' WHEN total > 2000 THEN 'total' WHEN last <> 'user' THEN 'last' END AS problem FROM g")
def history_problems(spark, sf_dir):
    return memory.history_problems(corpus.turns(spark, sf_dir), 6, 700, 2000)


@query(f"WITH {TURNS_SQL}, b AS (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY id DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM turns) SELECT id, conv_id FROM b WHERE used <= 900 OR k = 1")
def history_budget(spark, sf_dir):
    return O.newest_within(corpus.turns(spark, sf_dir), ["conv_id"], [F.desc("id")], F.length("content"), 900).select("id", "conv_id")


@query(f"WITH {TURNS_SQL}, p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM turns) SELECT id, md5(right(coalesce(previous || chr(10), '') || content, 600)) AS q FROM p WHERE role = 'user'")
def prev_user_turn(spark, sf_dir):
    t = memory.previous_user_turn(corpus.turns(spark, sf_dir)).filter("role = 'user'")
    return t.select("id", F.md5(memory.retrieval_query(F.col("content"), F.col("previous"))).alias("q"))


@query(f"""WITH {TURNS_SQL}, l AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 5)
SELECT user_id, string_agg('- [' || role || '] ' || trim(content), chr(10) ORDER BY id) FILTER (WHERE trim(content) <> '') AS block FROM l GROUP BY 1""")
def memory_blocks(spark, sf_dir):
    """The newest entries of each user, as many as long-term memory gives to a prompt."""
    entries = corpus.turns(spark, sf_dir).withColumn("kind", F.col("role"))
    return memory.memory_block(O.last_n(entries, ["user_id"], [F.desc("id")], DEFAULT.memory_top_k))


@query(r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*(?:[-*•]|[0-9]+[.)])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS f FROM documents) SELECT doc_id, md5(array_to_string(f[1:7], '|')) AS facts FROM l")
def fact_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(memory.fact_lines(F.col("text")), "|")).alias("facts"))


@query("""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM l),
k AS (SELECT doc_id, any_value(length(text)) AS n, count(*) AS total, count(*) FILTER (WHERE used <= 800 OR pos = 0) AS kept FROM u GROUP BY 1)
SELECT doc_id, CASE WHEN n <= 800 THEN total ELSE kept END AS shown, total, n > 800 AS truncated FROM k""")
def line_budget(spark, sf_dir):
    b = O.line_budget(F.col("text"), 800)
    return load(spark, sf_dir, "documents").select("doc_id", b.alias("b")).select("doc_id", F.col("b.shown").alias("shown"), F.col("b.total").alias("total"), F.col("b.truncated").alias("truncated"))


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, file_id, chunk_text, sum(length(chunk_text)) OVER w AS used, coalesce(sum(length(chunk_text)) OVER (PARTITION BY file_id ORDER BY seq, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks WHERE length(chunk_text) > 0 WINDOW w AS (PARTITION BY file_id ORDER BY seq, chunk_id ROWS UNBOUNDED PRECEDING))
SELECT chunk_id, file_id, CASE WHEN used <= 8000 THEN md5(chunk_text) ELSE md5(substr(chunk_text, 1, CAST(8000 - before AS BIGINT)) || '…') END AS body, used > 8000 AS partial FROM s WHERE used <= 8000 OR (before < 7800 AND before <= 8000)""")
def read_through(spark, sf_dir):
    """Chunks of a file in order under a budget of characters; the first that does not fit is cut if over 200 are left."""
    return memory.read_through(corpus.chunks(spark, sf_dir), 8000, 200).select("chunk_id", "file_id", F.md5("body").alias("body"), "partial")


@query(f"WITH {RECORDS_SQL} SELECT id, CASE WHEN coalesce(handled_by, '') <> '' THEN handled_by WHEN contains(replace(answer || CASE WHEN id % 3 = 0 THEN ' 설정을 변경 했습니다' ELSE '' END, ' ', ''), '설정을변경') THEN 'operator' ELSE 'unknown' END AS label FROM records")
def keyword_label(spark, sf_dir):
    a = F.concat("answer", F.when(F.col("id") % 3 == 0, " 설정을 변경 했습니다").otherwise(""))
    return corpus.records(spark, sf_dir).select("id", answers.label(F.col("handled_by"), a).alias("label"))


_VERDICTS = "v AS (SELECT event_id AS pos, event_id % 700 AS id, CASE event_id % 4 WHEN 0 THEN ' USER ' WHEN 1 THEN 'Operator' WHEN 2 THEN 'other' ELSE 'unknown' END AS label, props AS reason FROM events)"


@query(f"WITH {_VERDICTS}, s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) SELECT id, lower(trim(label)) AS label, substr(reason, 1, 120) AS reason FROM v WHERE id IN (SELECT id FROM s) AND lower(trim(label)) IN ('user', 'operator', 'unknown') QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1")
def verdict_validate(spark, sf_dir):
    k = F.col("event_id") % 4
    v = load(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % 700).alias("id"), F.when(k == 0, " USER ").when(k == 1, "Operator").when(k == 2, "other").otherwise("unknown").alias("label"), F.col("props").alias("reason"))
    return answers.valid_verdicts(v, load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))


@query(r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), lambda v: NOT contains(split_part(text, chr(10), 1), v)))) AS n FROM documents")
def ungrounded_values(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(answers.ungrounded(F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1)), (answers.IP,))).alias("n"))


@query(r"""WITH p AS (SELECT page_id, html, list_distinct(regexp_extract_all(html, '(?:^|[^\w.])(/(?:[\w.@+-]+/)+[\w.@+-]*)', 1)) AS found, split_part(html, chr(10), 1) AS said FROM pages)
SELECT page_id, list_sort(list_filter(found, lambda v: NOT contains(said, v))) AS paths FROM p""")
def ungrounded_paths(spark, sf_dir):
    """Paths of a page that its first line does not name."""
    bad = answers.ungrounded(F.col("html"), F.split_part("html", F.lit("\n"), F.lit(1)), (answers.PATH,))
    return load(spark, sf_dir, "pages").select("page_id", F.array_sort(bad).alias("paths"))


@query(r"""WITH b AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS bad FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(list_filter(bad, lambda v: contains(x, v))) = 0), chr(10)), '^\s+|\s+$', '', 'g')) AS h FROM b""")
def line_filter(spark, sf_dir):
    bad = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({answers.IP})"), F.lit(1)))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(answers.drop_lines(F.col("text"), bad)).alias("h"))


@query()
def answer_review(spark, sf_dir):
    r = corpus.records(spark, sf_dir)
    shown = answers.review(F.col("answer"), F.col("question"), F.lit("someone.else"), F.col("resolved"), F.lit("fallback"), F.lit("foreign"), F.lit("partly"))
    return r.select("id", shown.alias("shown"))


@query("SELECT c_custkey, substr(lower(split_part(c_name || '@Example.com', '@', 1)), 1, 128) AS who FROM customer")
def identity_names(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", answers.identity(F.concat("c_name", F.lit("@Example.com"))).alias("who"))


@query(f"WITH {RECORDS_SQL}, b AS (SELECT id, conv, CASE WHEN coalesce(handled_by, '') = '' THEN 'undecided' ELSE handled_by END || ': ' || question AS line FROM (SELECT *, id // 100 AS conv FROM records)) SELECT conv, md5(string_agg(line, chr(10) ORDER BY id)) AS block FROM b GROUP BY 1")
def evidence_blocks(spark, sf_dir):
    r = corpus.records(spark, sf_dir).withColumn("conv", F.floor(F.col("id") / 100))
    line = F.concat(F.coalesce(F.nullif("handled_by", F.lit("")), F.lit("undecided")), F.lit(": "), "question")
    return r.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))).alias("r")).select("conv", F.md5(F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("block"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || CAST(user_id AS VARCHAR) AS audit FROM events")
def audit_rows(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("audit"))
