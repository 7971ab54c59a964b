"""Classification of records and grounding of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import pii

#: Phrases by which an answer shows that an operator acted (blanks don't count).
OPERATOR_PHRASES = (
    "확인 결과", "확인결과", "확인해보니", "확인한 결과", "점검 결과", "점검해", "조회해보니", "로그를 확인", "로그 확인", "서버에 이상", "장애가 있",
    "장비 이상", "이상이 있었", "재기동", "재시작 처리", "리셋", "복구", "조치했", "조치 완료", "조치하였", "처리했", "처리하였", "설정을 변경", "설정 변경",
    "권한을 부여", "권한 부여", "계정을", "쿼터를 증설", "증설", "할당량을 조정", "반영했", "반영하였", "적용했", "적용하였", "삭제했", "삭제하였", "담당자가",
    "운영팀에서", "관리자가", "직접 확인",
)
LABELS = ("user", "operator", "unknown")
#: Openings of a guide to documents.
GUIDE_MARKERS = ("자세한 내용은 다음 문서", "가이드 문서:", "가이드 위치:")
#: Fixed patterns: four groups of digits with dots between; a path from the root with one folder or more, not inside a word.
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PATH = r"(?<![\w.])/(?:[\w.@+-]+/){1,}[\w.@+-]*"


def keyword_label(answer: Column, phrases: tuple[str, ...] = OPERATOR_PHRASES) -> Column:
    """operator where a phrase occurs, else unknown; never user."""
    bare = F.replace(F.coalesce(answer, F.lit("")), F.lit(" "), F.lit(""))
    any_ = F.lit(False)
    for p in dict.fromkeys(x.replace(" ", "") for x in phrases):
        any_ = any_ | F.contains(bare, F.lit(p))
    return F.when(any_, "operator").otherwise("unknown")


def label(stored: Column, answer: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), keyword_label(answer))


def valid_verdicts(verdicts: DataFrame, sent: DataFrame) -> DataFrame:
    """Verdicts (pos, id, label, reason) whose id was sent and whose label is known in any case; the first of each id; reasons of 120 characters."""
    known = verdicts.withColumn("label", F.lower(F.btrim("label"))).filter(F.col("label").isin(*LABELS)).join(sent.select("id"), "id", "left_semi")
    first = known.groupBy("id").agg(F.min_by(F.struct("label", "reason"), "pos").alias("v"))
    return first.select("id", F.col("v.label").alias("label"), F.substring(F.coalesce("v.reason", F.lit("")), 1, 120).alias("reason"))


def classify(records: DataFrame, classifier: Callable[[list[tuple[int, str, str]]], str], batch: int = DEFAULT.classify_batch) -> DataFrame:
    """(id, label, reason) of records with a blank label and an answer, asked in batches inside tasks.

    The classifier gets (id, question, answer) and returns text; JSON in it is
    read leniently. A batch that fails, and ids without a valid verdict, give
    no row and so stay unlabelled.
    """
    import json
    import re

    def read(text: str) -> list[dict]:
        text = re.sub(r"```(?:json)?|```", "", re.sub(r"<think>.*?</think>", "", text or "", flags=re.S))
        for a, z in (("{", "}"), ("[", "]")):
            i, j = text.find(a), text.rfind(z)
            if 0 <= i < j:
                try:
                    got = json.loads(text[i : j + 1])
                except ValueError:
                    continue
                got = got.get("results", [got]) if isinstance(got, dict) else got
                return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in range(0, len(pdf), batch):
                part = [(int(r.id), r.question or "", r.answer) for r in pdf.iloc[k : k + batch].itertuples()]
                try:
                    said = read(classifier(part))
                except Exception:  # noqa: BLE001  a classifier may raise anything; its batch stays unlabelled
                    continue
                ids, seen = {i for i, _, _ in part}, set()
                for x in said:
                    i, lab = x.get("id"), str(x.get("label", "")).strip().lower()
                    if i in ids and i not in seen and lab in LABELS:
                        seen.add(i)
                        rows.append((i, lab, str(x.get("reason") or "")[:120]))
            yield pd.DataFrame(rows, columns=["id", "label", "reason"]).astype({"id": "int64"})

    todo = records.filter(F.coalesce("handled_by", F.lit("")) == "").filter(F.length(F.btrim(F.coalesce("answer", F.lit("")), F.lit(" \t\r\n"))) > 0)
    return todo.select("id", "question", "answer").mapInPandas(run, "id long, label string, reason string")


def ungrounded(answer: Column, corpus: Column, patterns: tuple[str, ...] = (IP, PATH)) -> Column:
    """Distinct addresses and absolute paths of the answer that the corpus does not contain."""
    found = F.flatten(F.array(*[F.regexp_extract_all(answer, F.lit(f"({p})"), F.lit(1)) for p in patterns]))
    return F.filter(F.array_distinct(found), lambda v: ~F.contains(corpus, v))


def foreign_accounts(answer: Column, user: Column) -> Column:
    """Accounts other than the caller's; none where the caller is unknown."""
    own = F.lower(F.btrim(F.coalesce(user, F.lit(""))))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.filter(pii.find_accounts(answer), lambda a: F.lower(a) != own))


def drop_lines(answer: Column, bad: Column) -> Column:
    """The answer without the lines that hold a bad value, ends stripped."""
    # the bad values are bound to an outer variable, else each line would find them anew
    kept = F.flatten(F.transform(F.array(bad), lambda own: F.filter(F.split(answer, "\n", -1), lambda x: ~F.exists(own, lambda b: F.contains(x, b)))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def substantive(body: Column, least: int = 20) -> Column:
    return F.length(F.regexp_replace(body, r"[\s#\-*>|`0-9.]", "")) >= least


def review(answer: Column, corpus: Column, user: Column, searched: Column, fallback: Column, foreign_fallback: Column, tail: Column, patterns: tuple[str, ...] = (IP, PATH)) -> Column:
    """What may be shown of an answer: all of it, the lines that hold no bad value and a note, or a fallback."""
    guide = F.lit(False)
    for m in GUIDE_MARKERS:
        guide = guide | F.contains(answer, F.lit(m))
    foreign = foreign_accounts(answer, user)
    bad = F.concat(foreign, ungrounded(answer, corpus, patterns))
    body = drop_lines(answer, bad)
    return (
        F.when(F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", "")) == 0, answer)
        .when(~searched & guide, fallback)
        .when(F.size(bad) == 0, answer)
        .when(substantive(body), F.concat(body, F.lit("\n\n"), tail))
        .when(F.size(foreign) > 0, foreign_fallback)
        .otherwise(fallback)
    )


def identity(name: Column) -> Column:
    """The local part in lower case, 128 characters at most."""
    return F.substring(F.lower(F.btrim(F.split_part(name, F.lit("@"), F.lit(1)))), 1, 128)
