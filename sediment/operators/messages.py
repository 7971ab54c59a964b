"""Messages, plans and results of other systems, read into columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAN = "struct<mode:string,sources:array<string>,queries:array<string>>"


def content_text(content: Column) -> Column:
    """Text of message content as JSON: a string, or a list whose strings and text parts are joined by line feeds."""
    v = F.try_parse_json(content)
    part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))
    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), lambda x: x.isNotNull())
    return F.when(content.isNull(), "").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(parts.isNotNull(), F.array_join(parts, "\n")).otherwise(content)


def json_object(said: Column) -> Column:
    """The outermost braces of a model's text, without thoughts and fences; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(said, F.lit("")), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", " ")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_plan(said: Column) -> Column:
    """(mode, sources, queries) of a routing plan, read strictly: execute only if it says so, known sources in order, three queries at most.

    A search without sources uses both; null if there is no JSON object.
    """
    raw = F.from_json(json_object(said), T.StructType([T.StructField("mode", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("queries", T.ArrayType(T.StringType()))]))
    mode = F.when(F.lower(F.btrim(F.coalesce(raw["mode"], F.lit("")))) == "execute", "execute").otherwise("search")
    named = F.transform(F.coalesce(raw["sources"], F.array().cast("array<string>")), lambda s: F.lower(F.btrim(s)))
    known = F.filter(F.array(F.lit("manual"), F.lit("voc")), lambda s: F.array_contains(named, s))
    sources = F.when((mode == "search") & (F.size(known) == 0), F.array(F.lit("manual"), F.lit("voc"))).otherwise(known)
    asked = F.filter(F.transform(F.coalesce(raw["queries"], F.array().cast("array<string>")), lambda q: F.btrim(q)), lambda q: q != "")
    return F.when(raw.isNotNull(), F.struct(mode.alias("mode"), sources.alias("sources"), F.slice(asked, 1, 3).alias("queries")))


def unwrapped(text: str | None, depth: int = 4) -> str | None:
    """The inner result of JSON in strings, lists of text parts and result or content fields, as JSON or text."""
    r = text
    for _ in range(depth):
        if isinstance(r, str):
            try:
                r = json.loads(r)
                continue
            except ValueError:
                break
        if isinstance(r, list):
            texts = [p["text"] for p in r if isinstance(p, dict) and p.get("text")]
            if not texts:
                break
            r = "".join(texts)
        elif isinstance(r, dict) and not {"exit_code", "stdout"} & set(r) and isinstance(inner := r.get("result", r.get("content")), dict | str | list):
            r = inner
        else:
            break
    return r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def unwrap(text: pd.Series) -> pd.Series:
    return text.map(unwrapped)


def body_text(text: Column, raw: Column) -> Column:
    """The text, or else the raw markup without tags."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.btrim(F.coalesce(text, F.lit(""))), F.lit("")), plain)


def record_message(title: Column, system: Column, subsystem: Column, kind: Column, department: Column, body: Column) -> Column:
    """A message of labelled lines; lines without a value are left out, and of system and subsystem one suffices."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{label}] "), c))
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    systems = F.when((F.coalesce(system, F.lit("")) != "") | (F.coalesce(subsystem, F.lit("")) != ""), F.concat(dash(system), F.lit(" / "), dash(subsystem)))
    return F.concat_ws("\n", line("VOC 제목", title), line("시스템", systems), line("분류", kind), line("요청 부서", department), F.concat(F.lit("[문의 내용]\n"), body))


def similar_reason(content: Column, score: Column) -> Column:
    """150 characters of the content, or else the score."""
    c = F.btrim(F.coalesce(content, F.lit("")))
    cut = F.when(F.length(c) > 150, F.concat(F.substring(c, 1, 150), F.lit("…"))).otherwise(c)
    return F.when(c != "", cut).when(score.isNotNull(), F.concat(F.lit("키워드 검색 유사도 "), score.cast("string"))).otherwise("키워드 검색 유사 문서")
