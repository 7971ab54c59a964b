"""Chart data and command policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, ingest, policy, registry
from ..scratch import scratch_path
from ..sources import tables
from .registry import load, query

_POINTS = "points AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS series_no, round(sum(CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END), 2) AS value FROM orders GROUP BY 1, 2)"


def points(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    v = F.round(F.sum(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))), 2)
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("label"), F.substring("o_orderpriority", 1, 1).cast("int").alias("series_no")).agg(v.alias("value"))


@query(f"WITH {_POINTS}, v AS (SELECT *, greatest(value, 0) AS v FROM points) SELECT label, series_no, round(v, 2) AS v, round(sum(v) OVER (PARTITION BY label ORDER BY series_no) - v, 2) AS base, round(sum(v) OVER (PARTITION BY label), 2) AS total FROM v")
def stack_base(spark, sf_dir):
    return charts.stack_bases(points(spark, sf_dir)).select("label", "series_no", *[F.round(c, 2).alias(c) for c in ("v", "base", "total")])


@query(f"WITH {_POINTS} SELECT label, series_no, round(abs(value) / sum(abs(value)) OVER (PARTITION BY label), 6) AS share, abs(value) / sum(abs(value)) OVER (PARTITION BY label) * 360 >= 18 AS labelled FROM points")
def pie_share(spark, sf_dir):
    return charts.pie_shares(points(spark, sf_dir), "label").select("label", "series_no", F.round("share", 6).alias("share"), "labelled")


@query(f"WITH {_POINTS}, r AS (SELECT series_no, least(min(value), 0) AS lo, greatest(max(value), 0) AS hi FROM points GROUP BY 1), m AS (SELECT *, (hi - lo) / 5 AS raw, pow(10, floor(log10((hi - lo) / 5))) AS mag FROM r) SELECT series_no, lo, hi, CASE WHEN raw <= mag THEN mag WHEN raw <= 2 * mag THEN 2 * mag WHEN raw <= 5 * mag THEN 5 * mag ELSE 10 * mag END AS step FROM m")
def nice_ticks(spark, sf_dir):
    r = points(spark, sf_dir).groupBy("series_no").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    lo, hi = charts.y_range(F.col("a"), F.col("b"), True)
    return r.select("series_no", lo.alias("lo"), hi.alias("hi")).withColumn("step", charts.tick_step(F.col("lo"), F.col("hi")))


@query("SELECT p_partkey, CASE WHEN abs(v) >= 1000000 THEN regexp_replace(printf('%.1fM', v / 1000000), '\\.0M$', 'M') WHEN abs(v) >= 10000 THEN printf('%.0fk', v / 1000) WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS shown FROM (SELECT p_partkey, p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 17.3 ELSE 4001 END AS v FROM part)")
def axis_format(spark, sf_dir):
    k = F.col("p_partkey") % 3
    v = F.col("p_retailprice") * F.when(k == 0, 1.0).when(k == 1, 17.3).otherwise(4001.0)
    return load(spark, sf_dir, "part").select("p_partkey", charts.axis_text(v).alias("shown"))


@query(f"WITH {_POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY series_no ORDER BY label) - 1 AS pos, count(*) OVER (PARTITION BY series_no) AS n FROM points) SELECT series_no, label, pos % greatest(1, CAST(ceil(n / 12.0) AS BIGINT)) = 0 AS shown FROM p")
def label_thinning(spark, sf_dir):
    from pyspark.sql import Window

    p = points(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("series_no").orderBy("label")) - 1)
    return charts.thin_labels(p, "series_no").select("series_no", "label", "shown")


@query(f"WITH {_POINTS}, p AS (SELECT series_no, label, CASE WHEN label > '1998' THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY series_no ORDER BY label) AS pos FROM points) SELECT series_no, max(pos) AS pos, arg_max(value, pos) AS value FROM p WHERE value IS NOT NULL GROUP BY 1")
def last_value_label(spark, sf_dir):
    from pyspark.sql import Window

    p = points(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("series_no").orderBy("label")))
    return charts.last_values(p.withColumn("value", F.when(F.col("label") <= "1998", F.col("value"))), ["series_no"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'kind' WHEN c_custkey % 10 = 1 THEN 'empty' WHEN c_custkey % 10 = 2 THEN 'lengths' WHEN c_custkey % 10 = 3 THEN 'values' END AS problem FROM customer")
def chart_problems(spark, sf_dir):
    k = F.col("c_custkey") % 10
    labels = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    values = F.when(k == 2, F.array(F.lit("1"))).when(k == 3, F.array(F.lit("1"), F.lit("x"))).otherwise(F.array(F.col("c_acctbal").cast("string"), F.lit(None).cast("string")))
    series = F.array(F.struct(F.col("c_name").alias("name"), values.alias("values")))
    return load(spark, sf_dir, "customer").select("c_custkey", charts.problems(labels, series, F.when(k == 0, "radar").otherwise("line")).alias("problem"))


_LINE = "CASE c_custkey % 6 WHEN 0 THEN 'ls -la /data/kill' WHEN 1 THEN 'bash -c ''rm -rf /''' WHEN 2 THEN 'echo KILL' WHEN 3 THEN 'cat a;/usr/bin/reboot' WHEN 4 THEN 'tail x | head' ELSE 'df {path} -h {path} {n}' END"


def command_lines(spark, sf_dir):
    k = F.col("c_custkey") % 6
    line = F.when(k == 0, "ls -la /data/kill").when(k == 1, "bash -c 'rm -rf /'").when(k == 2, "echo KILL").when(k == 3, "cat a;/usr/bin/reboot").when(k == 4, "tail x | head").otherwise("df {path} -h {path} {n}")
    return load(spark, sf_dir, "customer").select("c_custkey", line.alias("line"), F.split(line, " ", -1).alias("words"))


_DENY = ", ".join(f"'{d}'" for d in policy.DENIED)


@query(rf"""WITH l AS (SELECT c_custkey, {_LINE} AS line FROM customer), s AS (SELECT c_custkey, list_filter(list_transform(list_filter(string_split_regex(line, '[\s;|&()`$<>"'']+'), lambda p: p <> ''), lambda p: lower(regexp_extract(p, '([^/]*)$', 1))), lambda n: n IN ({_DENY})) AS d,
list_filter(list_transform(string_split(line, ' '), lambda w: lower(trim(w))), lambda w: NOT contains(w, '/') AND NOT starts_with(w, '-') AND w IN ({_DENY})) AS b FROM l) SELECT c_custkey, d[1] AS strict, b[1] AS lax FROM s""")
def deny_scan(spark, sf_dir):
    return command_lines(spark, sf_dir).select("c_custkey", policy.denied(F.col("words"), True).alias("strict"), policy.denied(F.col("words"), False).alias("lax"))


@query(f"SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 6 = 5 THEN ['path', 'n'] ELSE [] END, ',') AS names FROM (SELECT c_custkey, {_LINE} AS line FROM customer)")
def placeholders(spark, sf_dir):
    return command_lines(spark, sf_dir).select("c_custkey", F.array_join(policy.placeholders(F.col("line")), ",").alias("names"))


@query(f"SELECT c_custkey, CASE WHEN list_has_any(string_split(line, ' '), ['|', '||', '&', '&&', ';', '>', '>>', '<', '<<', '`', '$(']) THEN 'operator' END AS problem, contains(lower(line), 'reboot') AS named FROM (SELECT c_custkey, {_LINE} AS line FROM customer)")
def token_checks(spark, sf_dir):
    return command_lines(spark, sf_dir).select("c_custkey", policy.token_problem(F.col("words")).alias("problem"), policy.self_named(F.col("words"), ("reboot",)).alias("named"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN TRY_CAST(v AS BIGINT) IS NULL THEN 'int' END WHEN v NOT IN ('a', '7') THEN 'enum' END AS problem FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '7' WHEN 1 THEN 'a' ELSE 'zz' END AS v FROM customer)")
def type_cast(spark, sf_dir):
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, "7").when(k == 1, "a").otherwise("zz")
    kind = F.when(F.col("c_custkey") % 2 == 0, "int").otherwise("enum")
    return load(spark, sf_dir, "customer").select("c_custkey", policy.cast_argument(v, kind, F.array(F.lit("a: first"), F.lit("7: seven")))["problem"].alias("problem"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN c_custkey % 4 >= 2 THEN 2 ELSE 0 END AS n_choices FROM customer")
def argument_slots(spark, sf_dir):
    k = F.col("c_custkey") % 4
    row = F.create_map(F.lit("arg1_name"), F.when(k > 0, "path").otherwise(" "), F.lit("arg2_name"), F.when(k > 1, "mode").otherwise(""), F.lit("arg2_choices"), F.lit("x: one\n\n y"))
    s = load(spark, sf_dir, "customer").select("c_custkey", policy.argument_slots(4, row).alias("s"))
    return s.select("c_custkey", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: F.when(x["name"] == "mode", F.size(x["choices"])).otherwise(a)).alias("n_choices"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN 'path|' || c_name || '|' || CASE WHEN c_custkey % 4 = 2 THEN '정수' ELSE '문자열' END || '|Y|/tmp|' ELSE '||문자열|N||' END AS a1,
  CASE WHEN c_custkey % 4 > 1 THEN 'mode||선택형|N||x: one' || chr(10) || 'y_x0041_<&>' ELSE '||문자열|N||' END AS a2, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer)
SELECT 'cmd ' || k || '|' || c_name || ' & <' || c_mktsegment || '>|run ' || k || ' {path}|' || CASE WHEN k % 3 = 1 THEN '대상 서버' ELSE '로그인 서버' END || '|' || CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END || '|' || CASE WHEN k % 5 = 0 THEN c_mktsegment || ', user' ELSE '' END
  || '|' || a1 || '|' || a2 || '|||문자열|N|||||문자열|N||' AS cells, count(*) AS n FROM c GROUP BY 1""")
def command_export(spark, sf_dir):
    """Commands made of customers are written as workbooks and read again; a header row starts each workbook."""
    k, lit = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x))
    arg = lambda name, about, kind, required, default, choices: F.struct(F.lit(name).alias("name"), about.alias("description"), kind.alias("type"), F.lit(required).alias("required"), F.lit(default).cast("string").alias("default"), choices.alias("choices"))
    path = arg("path", F.col("c_name"), F.when(k % 4 == 2, "int"), True, "/tmp", F.lit(None).cast("array<string>"))
    mode = arg("mode", F.lit(None).cast("string"), F.lit("enum"), False, None, lit("x: one", "y_x0041_<&>"))
    commands = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("cmd "), k).alias("title"), F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit(">")).alias("description"), F.concat(F.lit("run "), k, F.lit(" {path}")).alias("exec_command"),
        F.when(k % 3 == 1, "target_server").when(k % 3 == 2, "login_server").alias("host_mode"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(k % 5 == 0, F.array("c_mktsegment", F.lit("user"))).alias("required_roles"),
        F.when(k % 4 > 1, F.array(path, mode)).when(k % 4 == 1, F.array(path)).alias("args"),
    )
    out = scratch_path(spark, "command_export")
    registry.export_commands(commands, out)
    rows = tables.read_tables(spark, out, "*.xlsx").filter("row_no > 0")
    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.coalesce(F.get("cells", i), F.lit(""))), "|")
    return rows.groupBy(cells.alias("cells")).agg(F.count(F.lit(1)).alias("n"))


_SHEET = """sheet AS (SELECT CAST(s_suppkey AS VARCHAR) AS file, r AS row_no, CASE WHEN r = 0 THEN ['A long report title that runs far over forty characters, really', ''] WHEN r = 1 THEN ['', ''] WHEN r = 2 + s_suppkey % 2 THEN ['name', 'value', 'kind']
  WHEN r = 2 THEN ['note', 'note'] ELSE [s_name || r, CASE WHEN r % 4 = 0 THEN '' ELSE CAST(s_acctbal AS VARCHAR) END, 'k'] END AS cells FROM supplier, (SELECT unnest(range(8)) AS r))"""


def sheet(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(7))))
    r, lit = F.col("r"), lambda *x: F.array(*map(F.lit, x))
    cells = F.when(r == 0, lit("A long report title that runs far over forty characters, really", "")).when(r == 1, lit("", "")).when(r == 2 + F.col("s_suppkey") % 2, lit("name", "value", "kind"))
    cells = cells.when(r == 2, lit("note", "note")).otherwise(F.array(F.concat("s_name", r.cast("string")), F.when(r % 4 == 0, "").otherwise(F.col("s_acctbal").cast("string")), F.lit("k")))
    return s.select(F.col("s_suppkey").cast("string").alias("file"), r.alias("row_no"), cells.alias("cells"))


@query(f"""WITH {_SHEET}, f AS (SELECT file, row_no, list_filter(cells, lambda x: x <> '') AS c FROM sheet), n AS (SELECT *, len(c) AS n, lead(len(c), 1) OVER w AS n1, lead(len(c), 2) OVER w AS n2, lead(len(c), 3) OVER w AS n3 FROM f WINDOW w AS (PARTITION BY file ORDER BY row_no)),
s AS (SELECT file, row_no, round(n + len(list_distinct(c)) / n * 2 + 1.5 * (CAST(coalesce(n1, 0) >= greatest(2, n * 0.6) AS BIGINT) + CAST(coalesce(n2, 0) >= greatest(2, n * 0.6) AS BIGINT) + CAST(coalesce(n3, 0) >= greatest(2, n * 0.6) AS BIGINT)) - 3 * len(list_filter(c, lambda x: length(x) > 40)), 6) AS score FROM n WHERE n >= 2)
SELECT file, row_no, score FROM s""")
def header_row_score(spark, sf_dir):
    return ingest.header_scores(sheet(spark, sf_dir))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS file, CAST(2 + s_suppkey % 2 AS BIGINT) AS header FROM supplier")
def header_row_detect(spark, sf_dir):
    return ingest.header_row(sheet(spark, sf_dir))


@query(f"WITH {_SHEET} SELECT file, row_no, cells[1] AS name, cells[2] AS value FROM sheet WHERE row_no > 2 + CAST(file AS BIGINT) % 2")
def table_load(spark, sf_dir):
    s = sheet(spark, sf_dir)
    t = ingest.table_rows(s, ingest.header_row(s))
    return t.select("file", "row_no", F.try_element_at("row", F.lit("name")).alias("name"), F.try_element_at("row", F.lit("value")).alias("value"))


@query(f"WITH {_SHEET} SELECT file, row_no, cells[1] AS question, CASE WHEN cells[2] = '' THEN 'blank' END AS skipped FROM sheet WHERE row_no > 2 + CAST(file AS BIGINT) % 2")
def record_import(spark, sf_dir):
    s = sheet(spark, sf_dir)
    t = ingest.table_rows(s, ingest.header_row(s))
    return ingest.import_records(t, "name", "value").select("file", "row_no", "question", "skipped")


_FILES = "f AS (SELECT p_partkey AS file_id, p_brand AS title, CAST(p_partkey % 5 + 1 AS BIGINT) AS version, CASE WHEN p_partkey % 7 = 0 THEN 'draft' WHEN p_partkey % 3 = 0 THEN 'archived' ELSE 'published' END AS status FROM part)"


def part_files(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.when(k % 7 == 0, "draft").when(k % 3 == 0, "archived").otherwise("published")
    return load(spark, sf_dir, "part").select(k.alias("file_id"), F.col("p_brand").alias("title"), (k % 5 + 1).cast("int").alias("version"), status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("published_at"))


@query(f"WITH {_FILES}, c AS (SELECT DISTINCT file_id, title FROM f WHERE status = 'draft' AND file_id % 2 = 0), t AS (SELECT DISTINCT title FROM c) SELECT f.file_id, CASE WHEN f.file_id IN (SELECT file_id FROM c) THEN 'published' WHEN f.title IN (SELECT title FROM t) AND f.status = 'published' THEN 'archived' ELSE f.status END AS status FROM f")
def publish_latest_version(spark, sf_dir):
    f = part_files(spark, sf_dir)
    return ingest.publish(f, f.filter("status = 'draft' and file_id % 2 = 0"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("file_id", "status")


@query(f"WITH {_FILES} SELECT file_id, CASE WHEN status = 'published' THEN 'published files cannot be deleted' END AS problem FROM f")
def delete_guard(spark, sf_dir):
    return ingest.guard(part_files(spark, sf_dir), "delete").select("file_id", "problem")


@query(f"WITH {_FILES}, d AS (SELECT file_id, title, row_number() OVER (PARTITION BY title ORDER BY file_id) AS k FROM f WHERE status = 'draft') SELECT d.file_id, d.title, CAST(m.v + d.k AS BIGINT) AS version FROM d JOIN (SELECT title, max(version) AS v FROM f GROUP BY 1) m USING (title)")
def draft_versions(spark, sf_dir):
    f = part_files(spark, sf_dir)
    d = f.filter("status = 'draft'").select("file_id", "title", F.col("file_id").alias("draft_no"))
    return ingest.next_versions(d, f).select("file_id", "title", "version")


@query()
def batch_embedding(spark, sf_dir):
    return ingest.embed(load(spark, sf_dir, "documents"), ingest.hash_embedder(), "doc_id", "text")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN 'denied' WHEN c_custkey % 6 = 5 THEN 'missing' WHEN c_custkey % 4 = 0 THEN 'unused' END AS problem FROM (SELECT c_custkey, {_LINE} AS line FROM customer)")
def definition_check(spark, sf_dir):
    from ..operators import registry

    arg = F.struct(F.lit("n").alias("name"), F.lit("int").alias("type"), F.array().cast("array<string>").alias("choices"))
    given = F.when((F.col("c_custkey") % 4 == 0) | (F.col("c_custkey") % 6 == 5), F.array(arg)).otherwise(F.array().cast("array<struct<name:string,type:string,choices:array<string>>>"))
    return command_lines(spark, sf_dir).select("c_custkey", registry.definition_problem(F.lit("tool"), F.col("line"), given, F.lit("login_server")).alias("problem"))


@query("WITH a AS (SELECT trim(p_name) AS title, p_type AS d, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS c, 0 AS k FROM part UNION ALL SELECT trim(s_name), 'supplier', '한글', 1 FROM supplier), f AS (SELECT * FROM a WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY k, d, c) = 1) SELECT title, d AS description, coalesce(nullif(c, ''), title) AS exec_command, c <> '한글' AS enabled FROM f WHERE title NOT IN (SELECT p_name FROM part WHERE p_partkey % 5 = 0)")
def merge_catalogs(spark, sf_dir):
    from ..operators import registry

    part = load(spark, sf_dir, "part")
    a = part.select(F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("exec_command"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.lit("supplier").alias("description"), F.lit("한글").alias("exec_command"))
    return registry.merge_catalogs(part.filter("p_partkey % 5 = 0").select(F.col("p_name").alias("title")), a, b)


@query("SELECT c_custkey, '[VOC 제목] ' || c_name || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '[시스템] ' || c_mktsegment || ' / -' || chr(10) ELSE '' END || '[문의 내용]' || chr(10) || 'a b' AS message FROM customer")
def record_messages(spark, sf_dir):
    from ..operators import messages

    none = F.lit(None).cast("string")
    system = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", messages.record_message(F.col("c_name"), system, none, F.lit(""), none, messages.body_text(F.lit(" "), F.lit("<p>a<br>b</p>"))).alias("message"))


@query("SELECT doc_id, substr(trim(text), 1, 150) || CASE WHEN length(trim(text)) > 150 THEN '…' ELSE '' END AS reason FROM documents")
def similar_reasons(spark, sf_dir):
    from ..operators import messages

    return load(spark, sf_dir, "documents").select("doc_id", messages.similar_reason(F.col("text"), F.lit(0.5)).alias("reason"))
