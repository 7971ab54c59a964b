"""The driver's contract, with or without the corpus operators."""

from __future__ import annotations

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and {"qid", "chunk_id", "score", "rn"} <= set(rows[0].asDict())
