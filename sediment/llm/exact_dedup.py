"""Operator 7: exact duplicates by recipes of content-defined chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_place

#: Least and most bytes of a chunk.
MIN_CHUNK, MAX_CHUNK = 256, 16384
#: Chunks are cut after eight marked characters in a row, which come about once in a few hundred in every script. ASCII is
#: marked by its last two bits (0 and 3), any other character by the last bit of its last byte in UTF-8.
_ASCII = "[" + "".join(rf"\x{b:02x}" for b in range(128) if b % 4 in (0, 3)) + "]"
_LAST, _NEXT = "[" + "".join(rf"\x{b:02x}" for b in range(0x81, 0xC0, 2)) + "]", r"[\x80-\xbf]"
_OTHER = rf"[\xc0-\xdf]{_LAST}|[\xe0-\xef]{_NEXT}{_LAST}|[\xf0-\xff]{_NEXT}{_NEXT}{_LAST}"


def normalize_space(text: Column) -> Column:
    """Each run of white space becomes one space; runs that are one space already are passed over."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def bytes_of(text: Column) -> Column:
    """The bytes of UTF-8 as characters from U+0000 to U+00FF."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Cuts a text, as ``bytes_of`` gives it, at places that its content defines, so that equal passages give equal chunks wherever they stand.

    Where no such place comes in ``most`` bytes, the cut is made there. A
    text of ASCII only needs no bytes and a shorter pattern that cuts alike;
    in others, eight bytes that may be marked are asked for first.
    """
    cut = lambda t, marked: F.regexp_extract_all(t, F.lit(rf"(?s).{{{least},{most}}}?{marked}{{8}}|.{{1,{most}}}"), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), cut(text, _ASCII)).otherwise(cut(bytes_of(text), rf"(?=[{_ASCII[1:-1]}\x80-\xff]{{8}})(?:{_ASCII}|{_OTHER})"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of white space is made one space. Every
    text is cut into content-defined chunks where it is read, and stays there:
    what is written of a chunk is a 64-bit identifier and its SHA-256. Chunks
    are made distinct by both, which verifies, by digest and not by bytes, that
    an identifier stands for one chunk only. A document is then its ordered list of identifiers, and
    only these lists are grouped and joined; no text moves. Where an
    identifier turns out to stand for several chunks, the documents that hold
    it carry the SHA-256 of each chunk beside their list.

    A null text counts as empty, and its list of chunks is empty. Of equal
    texts one row stays, one with the smallest id; nulls come after all ids,
    and a group of null ids only has a null keep_id. Of rows that repeat the
    id that stays any one is marked kept.
    Other columns are not read.
    """
    base = docs.select(F.col(id).alias("id"), normalize_space(F.col(text)).alias("text"))
    part = F.transform(chunks(F.col("text"), least, most), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d")))
    rows = materialize(base.select("id", F.sha2(F.col("text"), 256).alias("text_sha256"), part.alias("parts")), "recipes").select("*", row_place().alias("place"))
    store = rows.select(F.explode("parts").alias("c")).select("c.*").groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialize(store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "clashes")
    recipe, proof = F.col("parts.h"), F.array_join(F.transform("parts", lambda c: F.hex(c["d"])), "")
    if clashes.isEmpty():
        rows = rows.select("id", "place", "text_sha256", recipe.alias("recipe"), F.lit("").alias("proof"))
    else:
        held = rows.select("place", F.explode(recipe).alias("h")).join(clashes, "h").select(F.col("place").alias("held")).distinct()
        rows = rows.join(held, F.col("place") == F.col("held"), "left").select("id", "place", "text_sha256", recipe.alias("recipe"), F.when(F.col("held").isNotNull(), proof).otherwise("").alias("proof"))
    first = F.coalesce(F.min_by("place", "id"), F.min("place"))
    groups = materialize(rows.groupBy("recipe", "proof").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), first.alias("first")), "groups")
    return rows.join(groups, ["recipe", "proof"]).select(F.col("id").alias(id), "keep_id", "group_size", (F.col("place") == F.col("first")).alias("kept"), "text_sha256")
