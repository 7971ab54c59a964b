"""Operator 2: drops lines that occur in many documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, hash128, lower_ascii, materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    return F.transform(_lines(text), lambda x: lower_ascii(F.btrim(x, F.lit(WHITE))))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (h1, h2) of normalised lines found in ``min_docs`` documents or more, with n_docs.

    Each row is a document. Its keys are made distinct inside the row, so that
    counting rows per hash counts documents, and map-side partial counts
    absorb a line that a third of all documents carry.
    """
    keys = docs.select(F.explode(F.array_distinct(_keys(F.coalesce(F.col(text), F.lit(""))))).alias("k")).filter(F.length("k") >= min_chars)
    h1, h2 = hash128(F.col("k"))
    return keys.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, kept_text, n_lines (before dropping), n_dropped, and the columns named in ``keep``.

    Normalised lines are exploded and hashed to 128 bits, distinct documents
    are counted per hash, and each document is put together again, by
    position, from the lines whose hash stays under the threshold. Only
    (row key, position, hash) is exploded against the frequent hashes; texts
    move once, to meet their dropped positions.

    A null or empty text is one empty line, whose key is too short to be
    dropped. Every row is a document of its own, so a repeated row counts
    again and each copy gets the same result. Null ids are kept. Other
    columns of ``docs``, whatever their names, are not read unless in ``keep``.
    """
    base = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    k1, k2 = hash128(F.col("__text"))
    base = base.withColumns({"__k1": k1, "__k2": k2})
    frequent = materialize(frequent_lines(base, "__text", min_docs, min_chars), "lines")
    refs = base.select("__id", "__k1", "__k2", F.posexplode(_keys(F.col("__text"))).alias("pos", "k")).filter(F.length("k") >= min_chars)
    h1, h2 = hash128(F.col("k"))
    hits = refs.select("__id", "__k1", "__k2", "pos", h1.alias("h1"), h2.alias("h2")).join(frequent.select("h1", "h2"), ["h1", "h2"])
    drops = hits.groupBy(F.col("__id").alias("d_id"), F.col("__k1").alias("d_k1"), F.col("__k2").alias("d_k2")).agg(F.collect_set(F.col("pos") + 1).alias("__drop"))
    joined = base.join(drops, F.col("__id").eqNullSafe(F.col("d_id")) & (F.col("__k1") == F.col("d_k1")) & (F.col("__k2") == F.col("d_k2")), "left")
    lines = _lines(F.col("__text"))
    # a lambda's body is evaluated for each element, so the split lines are bound to an outer variable first
    stay = lambda own: F.array_except(F.sequence(F.lit(1), F.size(own)), F.col("__drop"))
    kept = F.array_join(F.flatten(F.transform(F.array(lines), lambda own: F.transform(stay(own), lambda i: F.get(own, i - 1)))), "\n")
    return joined.select(
        F.col("__id").alias(id),
        F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )
