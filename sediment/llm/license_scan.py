"""Operator 8: licence texts and notices by the digest of their canonical form. DataFrame functions only."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .license_texts import names, registry

#: Equivalent spellings, applied in this order after lower-casing: (pattern, replacement).
SPELLINGS = (
    (r"https?://", "http "),
    (r"licen[cs]e", "license"),
    (r"sub-licens", "sublicens"),
    (r"non-infring", "noninfring"),
    (r"merchantibility", "merchantability"),
    (r"acknowledgement", "acknowledgment"),
    (r"organisation", "organization"),
    (r"&", " and "),
    (r"per cent", "percent"),
    (r"whilst", "while"),
)
#: The addresses that the Free Software Foundation has had, as they stand in words; all become one.
ADDRESS = r"(?:675 mass ave cambridge ma 02139|59 temple place(?: suite 330)? boston ma 02111 1307|51 franklin st(?:reet)?(?: fifth floor)? boston ma 02110 1301)(?: usa)?"
#: Lines that name a holder with a sign or year, or reserve rights, after any comment sign, wherever they stand.
HOLDER = r"^[^a-z0-9]*(?:copyright(?: \(c\)|:| ©| [0-9<\[{(])|\(c\) *(?:copyright|[0-9<\[{©])|©|all rights reserved)"
#: Lines that name one with less: the word or the letter in brackets, unless a sentence or a member of a list goes on.
UNSIGNED = r"^[^a-z0-9]*(?:copyright (?!(?:notices?|holders?|owners?|laws?|licenses?|statements?|interests?|and|or|in|is|to|of|as)\b)|\(c\) *+(?!(?:you|the|under|if|any|all|each|to|in|for|by|representations)\b))"
#: A line of more than eight words that is no copyright line: prose, which may go on in the next line.
PROSE = r"^(?![^a-z0-9]*(?:copyright|\(c\)|©))[^a-z0-9]*(?:[a-z0-9]+[^a-z0-9]+){8}[a-z0-9]"
#: How a notice of one line leads up to a licence's name, in canonical words.
LEAD = r"^(?:spdx license identifier |(?:this [a-z]+ is )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?)"

#: What any line with such a lead has before it is brought to canonical words.
LED = r"(?:licen[cs]ed|released|distributed|available|published|provided)[^a-z0-9]+under|identifier"


def _words(t: Column) -> Column:
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(F.regexp_replace(t, r"[\x00-\x2f\x3a-\x60\x7b-\x{bf}\x{2000}-\x{206f}]+", " "), F.lit(" "))


def _with_last(lines: Column) -> Column:
    """(line, last): each line with the one before it, the first with an empty one."""
    # bound to a variable, so that the text is split once
    bound = F.transform(F.array(lines), lambda ls: F.zip_with(ls, F.slice(F.concat(F.array(F.lit("")), ls), 1, F.size(ls)), lambda x, y: F.struct(x.alias("line"), y.alias("last"))))
    return F.element_at(bound, 1)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and words of letters and digits with one space between.

    Copyright lines go whole, however long and wherever they stand: those with
    a sign and year, and those with less unless the line before is prose,
    whose sentence they may carry on.
    """
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    lines = F.transform(F.filter(_with_last(F.split(t, "\n", -1)), lambda x: ~(x["line"].rlike(HOLDER) | (x["line"].rlike(UNSIGNED) & ~x["last"].rlike(PROSE)))), lambda x: x["line"])
    marked = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("all rights reserved"))
    words = _words(F.when(marked, F.array_join(lines, "\n")).otherwise(t))
    return F.when(F.contains(words, F.lit(" boston ma ")) | F.contains(words, F.lit(" mass ave ")), F.regexp_replace(words, ADDRESS, "fsf address")).otherwise(words)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the registry, a fixed table of some fifty rows."""
    known = spark.createDataFrame(registry(), "license_id string, text string")
    return known.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def name_digests() -> dict[str, str]:
    """Digest of each known name in canonical words, and its licence; a fixed table made by rule."""
    return {hashlib.sha256(" ".join(re.findall("[a-z0-9]+", n.lower())).encode()).hexdigest(): i for i, n in names()}


def notices(text: Column) -> Column:
    """Identifiers of the licences that some whole line of the text is a notice of, in order, without repeats, comma-joined.

    A line is lower-cased and brought to canonical words, what leads up to
    the licence's name is dropped, and the digest of the rest is looked up
    among those of the known names.
    """
    known = F.create_map(*[F.lit(x) for pair in sorted(name_digests().items()) for x in pair])
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    lines = F.transform(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(LED)), _words)
    found = F.transform(F.filter(lines, lambda x: x.rlike(LEAD)), lambda x: F.try_element_at(known, F.sha2(F.regexp_replace(x, LEAD, ""), 256)))
    listed = F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")
    return F.when(F.contains(t, F.lit("under")) | F.contains(t, F.lit("identifier")), listed).otherwise("")


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_digest, license_id (null where no known text equals the whole text), is_license, notices.

    The digest of the canonical form of each whole text is looked up by a hash
    join among the digests of known licences, which are broadcast: the
    registry is a fixed table of some fifty rows. ``notices`` are the licences
    that some line of the text, as a whole, says it is under ("Released under
    the MIT License."), comma-joined; they are found by the same digests of
    canonical forms. A null or empty text has the digest of the empty string
    and no notices. Repeated rows repeat their result; null ids are kept;
    other columns are not read. Documents are not shuffled.
    """
    rows = docs.select(F.col(id).alias("id"), F.sha2(canonical(F.col(text)), 256).alias("text_digest"), notices(F.col(text)).alias("notices"))
    known = known_digests(docs.sparkSession)
    return rows.join(F.broadcast(known), F.col("text_digest") == F.col("digest"), "left").select(F.col("id").alias(id), "text_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"), "notices")
