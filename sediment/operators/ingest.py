"""From files to published chunks: header rows, table rows, versions, publishing, embedding, imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Options

Embedder = Callable[[list[str]], list[list[float]]]


def filled(cell: Column) -> Column:
    return F.length(F.btrim(F.coalesce(cell, F.lit("")), F.lit(" \t\r\n"))) > 0


def header_scores(rows: DataFrame, file: str = "file", most: int = 15) -> DataFrame:
    """(file, row_no, score) of the first ``most`` rows (row_no from 0, cells an array of strings) with two filled cells or more.

    Filled cells, twice the share of distinct ones, 1.5 for each of the next
    three rows that keep 0.6 of the width (two cells at least), less 3 for each
    cell over 40 characters.
    """
    head = rows.filter(F.col("row_no") < most + 3).withColumn("c", F.filter(F.transform("cells", lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n"))), lambda x: x != ""))
    w = Window.partitionBy(file).orderBy("row_no")
    n = F.size("c")
    follow = sum((F.coalesce(F.lead(n, k).over(w), F.lit(0)) >= F.greatest(F.lit(2.0), n * 0.6)).cast("int") for k in (1, 2, 3))
    score = n + F.size(F.array_distinct("c")) / F.nullif(n, F.lit(0)) * 2 + follow * 1.5 - F.size(F.filter("c", lambda x: F.length(x) > 40)) * 3
    return head.select(file, "row_no", F.round(score, 6).alias("score"), n.alias("n")).filter((F.col("n") >= 2) & (F.col("row_no") < most)).drop("n")


def header_row(rows: DataFrame, file: str = "file", most: int = 15) -> DataFrame:
    """(file, header): the row of the best score, the first of equals; row 0 where no row has one."""
    best = header_scores(rows, file, most).filter("score > -1").groupBy(file).agg(F.max_by("row_no", F.struct("score", -F.col("row_no"))).alias("h"))
    return rows.select(file).distinct().join(best, file, "left").select(file, F.coalesce("h", F.lit(0)).cast("int").alias("header"))


def table_rows(rows: DataFrame, header: DataFrame, file: str = "file") -> DataFrame:
    """(file, row_no, cells as a map of column to value) below the header; blank rows go, short ones are padded with nulls.

    A blank header is named by its position; of equal headers the last counts.
    """
    head = rows.join(header, file).filter(F.col("row_no") == F.col("header")).select(file, "header", F.transform("cells", lambda x, i: F.when(filled(x), F.btrim(x, F.lit(" \t\r\n"))).otherwise(F.concat(F.lit("column_"), i.cast("string")))).alias("names"))
    body = rows.join(head, file).filter((F.col("row_no") > F.col("header")) & F.exists("cells", filled))
    last = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: ~F.array_contains(F.slice(F.col("names"), s["i"] + 2, F.greatest(F.size("names") - s["i"] - 1, F.lit(0))), s["n"]))
    return body.select(file, "row_no", F.map_from_entries(F.transform(last, lambda s: F.struct(s["n"].alias("k"), F.get(F.col("cells"), s["i"]).alias("v")))).alias("row"))


def next_versions(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Drafts (title, ...) with the version after the title's latest; several drafts of one title count on in order of ``draft_no``."""
    latest = files.groupBy("title").agg(F.max("version").alias("__v"))
    n = F.row_number().over(Window.partitionBy("title").orderBy("draft_no"))
    return drafts.withColumn("__n", n).join(latest, "title", "left").withColumn("version", F.coalesce("__v", F.lit(0)) + F.col("__n")).drop("__v", "__n")


def publish(files: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """Chosen files (file_id) become published, and other published versions of their titles archived.

    Choosing an archived file rolls back to it. One writer is assumed.
    """
    picked = chosen.select("file_id").distinct().withColumn("__pick", F.lit(True))
    tagged = files.join(picked, "file_id", "left").withColumn("__pick", F.coalesce("__pick", F.lit(False)))
    titles = tagged.filter("__pick").select("title").distinct().withColumn("__title", F.lit(True))
    out = tagged.join(titles, "title", "left")
    sibling = F.col("__title") & ~F.col("__pick") & (F.col("status") == "published")
    return out.withColumns({"status": F.when(F.col("__pick"), "published").when(sibling, "archived").otherwise(F.col("status")), "published_at": F.when(F.col("__pick"), at).otherwise(F.col("published_at"))}).select(*files.columns)


def guard(files: DataFrame, action: str) -> DataFrame:
    """Files with ``problem`` (null if the action is allowed): published ones can't be deleted, only drafts edited, only published ones withdrawn."""
    s = F.col("status")
    rules = {"delete": (s == "published", "published files cannot be deleted"), "edit": (s != "draft", "only drafts can be edited"), "unpublish": (s != "published", "the file is not published"), "publish": (s == "published", "the file is published already")}
    bad, why = rules[action]
    return files.withColumn("problem", F.when(bad, why))


def hash_embedder(dim: int = 64) -> Embedder:
    """A deterministic embedder without a model: signed counts of hashed words."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return embed


def embed(df: DataFrame, embedder: Embedder, id: str, body: str, options: Options = DEFAULT, max_failures: int = 5) -> DataFrame:
    """(id, embedding): texts clipped and embedded in batches inside tasks; a batch that fails is tried row by row.

    A row that fails alone stays null; after ``max_failures`` failing rows in
    succession the rest of the task's rows stay null without a try.
    """
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = 0
        for pdf in batches:
            texts = [(t or "")[: options.embed_max_chars] for t in pdf["t"]]
            out: list[list[float] | None] = []
            for k in range(0, len(texts), options.embed_batch):
                part = texts[k : k + options.embed_batch]
                if broken >= max_failures:
                    out += [None] * len(part)
                    continue
                try:
                    out += embedder(part)
                    broken = 0
                except Exception:  # noqa: BLE001  an embedder may raise anything; its rows are tried alone
                    for t in part:
                        try:
                            out += embedder([t]) if broken < max_failures else [None]
                            broken = 0 if broken < max_failures else broken
                        except Exception:  # noqa: BLE001
                            out.append(None)
                            broken += 1
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    return df.select(F.col(id).alias("id"), F.col(body).alias("t")).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id)


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> None:
    """Raises if a vector has another dimension than the files' setting."""
    bad = vectors.filter(F.col(column).isNotNull() & (F.size(column) != dim)).limit(1).count()
    if bad:
        raise ValueError(f"an embedding does not have {dim} dimensions")


def import_records(rows: DataFrame, question: str, answer: str, required: tuple[str, ...] = (), exclude: dict[str, tuple[str, ...]] | None = None, falsy: tuple[str, ...] = ("0", "false", "no", "n")) -> DataFrame:
    """Question and answer records from table rows (file, row_no, row as a map), with the reason of those left out.

    Blank required, question or answer cells and excluded values leave a row
    out; a blank value is never excluded. resolved is true unless its cell is
    one of ``falsy``.
    """
    cell = lambda c: F.btrim(F.coalesce(F.try_element_at("row", F.lit(c)), F.lit("")), F.lit(" \t\r\n"))
    blank = F.lit(False)
    for c in (question, answer, *required):
        blank = blank | (cell(c) == "")
    out_of = F.lit(False)
    for c, values in (exclude or {}).items():
        out_of = out_of | cell(c).isin(*values)
    return rows.select("file", "row_no", cell(question).alias("question"), cell(answer).alias("answer"), (~F.lower(cell("resolved")).isin(*falsy)).alias("resolved"), F.when(blank, "blank").when(out_of, "excluded").alias("skipped"))
