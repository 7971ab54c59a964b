"""A corpus pipeline over ``documents``: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import language_id, line_dedup, packing, simhash_dedup, source_mix
from sediment.llm.common import materialize, table
from sediment.llm.queries import tokenizer_path

#: Fingerprints this near are candidates, beside those that share a min-hash key.
NEAR_BITS = 4
#: Near copies are documents whose sets of five-word shingles have this Jaccard similarity or more.
NEAR = 0.8
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the rest keep their columns, with the predicted language as lang.

    Rejected are texts that are null or have no letter, and those farther from
    every centroid than it reaches. Ties go to the first label; repeated rows
    stay or go together. Without any labelled text every document goes.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.filter(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; documents stay, though a text may become empty.

    A null text becomes an empty one, n_chars is counted anew. Each row is a
    document, so repeated rows count as often as they occur.
    """
    out = line_dedup.dedup_lines(docs, min_docs=10, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: sets of five-word shingles NEAR alike or more.

    Texts without words are alike. Null ids come after all others; of rows
    that repeat an id and text one stays.
    """
    return simhash_dedup.keep_one(docs.select(*COLUMNS), words=5, max_bits=NEAR_BITS, likeness=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    A null source is one of its own; texts without words are not taken beyond
    the whole times that all documents of their source are.
    """
    return source_mix.mixed_rows(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, window and place in it.

    A null or empty text has its end token only; each copy of a document that
    the mix took several times has its own pieces.
    """
    cut = packing.pieces(docs, tokenizer_path())
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_frequent_lines),
    ("simhash_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: SQL can't express the centroid classifier, SimHash's components or the cube method; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
