"""Cleaning, splitting, tokenising and masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, text, udfs
from .registry import load, query

_TAGS = "|".join(text.HTML_TAGS)
_MARKUP = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '</?(?:{_TAGS})\b[^>]*/?>', ' ', 'gi')"""
_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_COLLAPSE = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({0}, '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \t\r\x0B\x0C\x{{a0}}]+|[ \t\r\x0B\x0C\x{{a0}}]+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(r"SELECT doc_id, sha256(regexp_replace(text || chr(1) || chr(160) || chr(9), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g').replace(chr(160), ' ')) AS h FROM documents")
def strip_control_chars(spark, sf_dir):
    t = F.concat(F.col("text"), F.lit("\x01\xa0\t"))
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_controls(t), 256).alias("h"))


@query(f"SELECT page_id, sha256({_MARKUP.format('html')}) AS h FROM pages")
def strip_html_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_markup(F.col("html")), 256).alias("h"))


@query(f"SELECT page_id, sha256({_ENTITIES.format('html')}) AS h FROM pages")
def unescape_entities(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(text.unescape_common(F.col("html")), 256).alias("h"))


@query(r"SELECT page_id, sha256(regexp_replace(regexp_replace('![i](x) [' || url || '](y) ' || url, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')) AS h FROM pages")
def markdown_links(spark, sf_dir):
    t = F.concat(F.lit("![i](x) ["), "url", F.lit("](y) "), "url")
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_links(t), 256).alias("h"))


@query(r"SELECT page_id, regexp_replace('see ' || url || ' end', 'https?://\S+', '', 'g') AS rest FROM pages")
def drop_bare_urls(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.drop_urls(F.concat(F.lit("see "), "url", F.lit(" end"))).alias("rest"))


@query(f"SELECT doc_id, sha256({_COLLAPSE.format('text')}) AS h FROM documents")
def collapse_whitespace(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("h"))


_CLEAN = _COLLAPSE.format("u")


@query(f"WITH a AS (SELECT page_id, {_ENTITIES.format(_MARKUP.format('html'))} AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(replace(t, chr(160), ' '), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g') AS u FROM a) SELECT page_id, sha256({_CLEAN}) AS h, length({_CLEAN}) AS n FROM b")
def clean_html_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").withColumn("c", text.clean_native(F.col("html"))).select("page_id", F.sha2("c", 256).alias("h"), F.length("c").alias("n"))


@query(r"SELECT page_id, len(list_filter(string_split_regex(html, '\n\s*\n'), lambda p: length(regexp_replace(p, '\s+', '', 'g')) > 0)) AS n FROM pages")
def paragraph_split(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.size(text.paragraphs(F.col("html"))).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, 'intro' || chr(10) || '# One ' || chr(10) || text || chr(10) || '## Empty' || chr(10) || '### Two' || chr(10) || 'end' AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM t),
g AS (SELECT *, regexp_matches(line, '^#{1,6}\s+') AS head FROM l), k AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM g)
SELECT doc_id, sec, max(trim(regexp_replace(line, '^#{1,6}\s+', ''))) FILTER (WHERE head) AS title, sha256(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head)) AS h FROM k GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT head) > 0""")
def header_sections(spark, sf_dir):
    t = F.concat(F.lit("intro\n# One \n"), "text", F.lit("\n## Empty\n### Two\nend"))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.sections(t)).alias("s"))
    sec = F.when(F.col("s.title").isNull(), 0).when(F.col("s.title") == "One", 1).otherwise(3).cast("long")
    return rows.select("doc_id", sec.alias("sec"), F.col("s.title").alias("title"), F.sha2("s.body", 256).alias("h"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil(length(text) / 1500.0)) AS BIGINT))) AS seq FROM documents) SELECT doc_id, seq, sha256(substr(text, seq * 1500 + 1, 1500)) AS h FROM c")
def hard_cut_chunks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.hard_cut(F.col("text"), 1500)).alias("seq", "piece")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2("piece", 256).alias("h"))


#: The fold over paragraphs, on a text of pieces parted by U+0001; pieces cut hard; each with what follows the first blank in the end of the one before it.
_PACKED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, CASE WHEN length(t) <= 1500 THEN t ELSE list_reduce(string_split(t, chr(10) || chr(10)), lambda a, x: CASE
  WHEN string_split(a, chr(1))[-1] <> '' AND length(string_split(a, chr(1))[-1]) + length(x) + 2 <= 1500 THEN a || chr(10) || chr(10) || x WHEN string_split(a, chr(1))[-1] = '' THEN a || x ELSE a || chr(1) || x END) END AS packed, length(t) <= 1500 AS short FROM d),
c AS (SELECT doc_id, CASE WHEN short THEN [packed] ELSE flatten(list_transform(string_split(packed, chr(1)), lambda x: list_transform(range(0, length(x), 1500), lambda i: substr(x, i + 1, 1500)))) END AS cut FROM p),
e AS (SELECT doc_id, unnest(range(len(cut))) AS seq, cut FROM c),
o AS (SELECT doc_id, seq, cut[seq + 1] AS own, CASE WHEN seq > 0 THEN right(cut[seq], 200) END AS tail FROM e)
SELECT doc_id, seq, CASE WHEN tail IS NULL THEN own ELSE CASE WHEN strpos(tail, ' ') BETWEEN 1 AND length(tail) - 1 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END || chr(10) || own END AS chunk_text FROM o"""


@query(_PACKED)
def packed_chunks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.packed(F.col("text"), 1500, 200)).alias("seq", "chunk_text"))


@query("SELECT c_custkey, array_to_string(list_filter(['name: ' || trim(c_name), CASE WHEN c_custkey % 2 = 0 THEN 'segment: ' || trim(c_mktsegment) END], lambda x: x IS NOT NULL), chr(10)) AS body FROM customer")
def row_chunk_text(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  ")
    return c.select("c_custkey", text.labelled_cells(("name", F.col("c_name")), ("segment", seg)).alias("body"))


@query("SELECT doc_id, sha256('Title ' || source || CASE WHEN doc_id % 2 = 0 THEN ' > ' || lang ELSE '' END || chr(10) || text) AS h FROM documents")
def contextual_prefix(spark, sf_dir):
    part = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.context_prefix(F.col("text"), F.concat(F.lit("Title "), "source"), part, F.lit(None).cast("string")), 256).alias("h"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def tag_strip(spark, sf_dir):
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(t, 256).alias("h"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END) AS h FROM documents")
def clip_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clip(F.col("text"), 300), 256).alias("h"))


_TOK = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣_.-]+')) AS tok, unnest(range(len(regexp_extract_all(text, '[0-9A-Za-z가-힣_.-]+')))) AS pos FROM documents),
f AS (SELECT doc_id, tok, pos FROM t WHERE length(tok) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(tok) ORDER BY pos) = 1)"""


@query(f"WITH {_TOK} SELECT d.doc_id, md5(coalesce(string_agg(f.tok, ' ' ORDER BY f.pos), '')) AS tokens FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1")
def tokens_with_suffix(spark, sf_dir):
    """The documents have no Hangul, so that SQL may leave the endings out; tests cover them."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("tokens"))


@query(f"WITH {_TOK}, s AS (SELECT doc_id, pos, regexp_replace(tok, '[^0-9A-Za-z가-힣_]', '', 'g') AS p FROM f) SELECT d.doc_id, md5(coalesce(string_agg(s.p || ':*', ' | ' ORDER BY s.pos), '')) AS q FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND length(s.p) >= 2 GROUP BY 1")
def prefix_query(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.transform(text.prefixes(F.col("text")), lambda x: F.concat(x, F.lit(":*"))), " | ")).alias("q"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '{사용자 id}', 'g')) AS h FROM documents")
def mask_email(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(pii.mask_email(F.col("text")), 256).alias("h"))


@query(r"""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '담당자: ' || c_name WHEN 1 THEN '요청자 ：  Kim Lee 확인' WHEN 2 THEN '이름:홍길동' ELSE c_name END AS t FROM customer)
SELECT c_custkey, regexp_replace(t, '(담당자|요청자|의뢰자|작성자|신청자|문의자|처리자|승인자|성명|이름)\s*[:：]\s*[A-Za-z가-힣]{1,12}(?:\s+[A-Za-z가-힣]{1,12})?', '\1: {사용자 이름}', 'g') AS masked FROM c""")
def mask_labelled_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, F.concat(F.lit("담당자: "), "c_name")).when(k == 1, "요청자 ：  Kim Lee 확인").when(k == 2, "이름:홍길동").otherwise(F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(t, pii.LABELLED, "$1: " + pii.NAME).alias("masked"))


@query()
def mask_pii_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", pii.mask_pii(F.col("text")).alias("masked"), F.size(pii.find_accounts(F.col("text"))).alias("n_accounts"))


@query()
def nfkc_clean(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", udfs.clean_text("html").alias("cleaned"))


@query(r"SELECT doc_id, greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(replace(text, 'th', '``'), '`+'), lambda x: length(x))), 0)) AS fence FROM documents")
def fence_length(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.fence_length(F.replace("text", F.lit("th"), F.lit("``"))).alias("fence"))


@query("SELECT doc_id, CAST(round((length(text) - length(regexp_replace(text, '[가-힣]', '', 'g'))) + 0.55 * length(regexp_replace(text, '[가-힣]', '', 'g')), 4) AS DOUBLE) AS width FROM documents")
def text_width(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(text.text_width(F.col("text"), 1.0), 4).alias("width"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS s, len(embedding) AS n FROM embeddings")
def vector_literal(spark, sf_dir):
    from ..functions.similarity import vector_literal as literal

    v = literal(F.col("embedding"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(v).alias("n"))


@query("SELECT doc_id, sha256(text) AS a, sha1(text) AS b, md5(text) AS c FROM documents")
def hash_keys(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.sha1("text").alias("b"), F.md5("text").alias("c"))
