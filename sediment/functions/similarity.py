"""Vectors and trigrams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def squeezed(t: Column) -> Column:
    """Lower case, one space for each run of white space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(t), r"\s+", " "))


def trigrams(t: Column) -> Column:
    """Distinct character trigrams of the lower-case text with white space squeezed; shorter texts are their own."""
    s = squeezed(t)
    # one pass of the pattern engine; cutting by position would count characters anew for each
    return F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(F.regexp_extract_all(s, F.lit("(?s)(?=(...))"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty. Written without branches, so that the shared part is found once."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the first set that the second holds; 0 if it is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(0.0))


def vector_literal(v: Column) -> Column:
    return F.transform(v, lambda x: F.round(x.cast("double"), 6))
