"""Spreadsheets as a sink: round trips, limits, aborted jobs; and the form of commands."""

from __future__ import annotations

import re
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators import memory, registry
from sediment.sources import sheets, tables


def files(path):
    return sorted(p.name for p in path.iterdir())


def read(spark, path):
    return sorted(tuple(r.cells) for r in tables.read_tables(spark, str(path), "*.xlsx").filter("row_no > 0").collect())


def test_round_trip(spark, tmp_path):
    odd = ["a & <b>", "\x01\x0b\x02", "line\nbreak\rreturn\ttab", "_x0041_", "_x005F_", "漢字 \U0001f600", "\ufffe", 'quote "', "x" * 40_000, "__x0042_"]
    rows = [(str(k), v) for k, v in enumerate(odd)]
    for parts in (1, 4):
        out = tmp_path / f"o{parts}"
        sheets.write_sheets(spark.createDataFrame(rows, "k string, `v.w` string").repartition(parts, "k"), str(out))
        assert read(spark, out) == sorted(rows) and all(re.fullmatch(r"part-.*\.xlsx", f) for f in files(out))
    heads = {tuple(r.cells) for r in tables.read_tables(spark, str(tmp_path / "o4")).filter("row_no = 0").collect()}
    assert heads == {("k", "v.w")}


def test_values_nulls_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, True, 1.5, ""), (None, "x", None, None, "y")], "a int, b string, c boolean, d double, e string")
    sheets.write_sheets(rows, str(tmp_path / "a"))
    assert read(spark, tmp_path / "a") == [("", "x", "", "", "y"), ("1", "", "true", "1.5")]
    sheets.write_sheets(rows.limit(0), str(tmp_path / "b"))
    assert len(files(tmp_path / "b")) == 1 and read(spark, tmp_path / "b") == [] and tables.read_tables(spark, str(tmp_path / "b")).first().cells == ["a", "b", "c", "d", "e"]


def test_full_workbooks_go_on_in_others_and_modes(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 2).select(F.col("id").alias("k"))
    sheets.write_sheets(rows, str(tmp_path), most=120)
    assert len(files(tmp_path)) == 10 and read(spark, tmp_path) == sorted((str(k),) for k in range(1000))
    sheets.write_sheets(rows.limit(3), str(tmp_path))
    assert len(read(spark, tmp_path)) == 1003
    sheets.write_sheets(rows.limit(3), str(tmp_path), mode="overwrite")
    assert len(read(spark, tmp_path)) == 3


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    sheets.write_sheets(spark.range(2).select(F.col("id").alias("k")), str(tmp_path))
    before = files(tmp_path)
    bad = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") == 4000, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("k"))
    with pytest.raises(Exception, match="stop"):
        sheets.write_sheets(bad, str(tmp_path), mode="overwrite")
    assert files(tmp_path) == before


def test_lists_of_values(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Y")], "name string, `on` string")
    sheets.write_sheets(rows, str(tmp_path), {"on": ["Y", "N"]}, notes=("first <note>", "second"))
    with zipfile.ZipFile(tmp_path / files(tmp_path)[0]) as z:
        assert z.testzip() is None
        one, two = (z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2))
    assert '<formula1>"Y,N"</formula1>' in one and 'sqref="B2:B400"' in one and 'errorStyle="stop"' in one and "first &lt;note&gt;" in two
    for values in (["x" * 300], ["a,b"]):
        with pytest.raises(Exception, match="longer than"):
            sheets.write_sheets(rows, str(tmp_path), {"on": values})
    assert [sheets.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_form_of_commands(spark, tmp_path):
    arg = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "description", "type")] + [T.StructField("required", T.BooleanType()), T.StructField("default", T.StringType()), T.StructField("choices", T.ArrayType(T.StringType()))]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "exec_command", "host_mode")] + [T.StructField("enabled", T.BooleanType()), T.StructField("required_roles", T.ArrayType(T.StringType())), T.StructField("args", arg)])
    rows = [("b", "d", "run {x}", "target_server", True, ["admin", "user"], [("x", "what", "enum", True, "1", ["1: one", "2"]), *[(f"y{k}", None, "other", None, None, None) for k in range(5)]]), ("a", None, None, None, None, None, None)]
    registry.export_commands(spark.createDataFrame(rows, schema), str(tmp_path))
    none = ["", "", "문자열", "N", "", ""]
    wide = lambda cells: [*cells, *[""] * (30 - len(cells))]
    got = [wide(r.cells) for r in tables.read_tables(spark, str(tmp_path)).filter("row_no > 0").orderBy("file", "row_no").collect()]
    assert got == [["a", "", "", "로그인 서버", "N", "", *none * 4], ["b", "d", "run {x}", "대상 서버", "Y", "admin, user", "x", "what", "선택형", "Y", "1", "1: one\n2", *[c for k in range(3) for c in (f"y{k}", *none[1:])]]]
    with zipfile.ZipFile(tmp_path / files(tmp_path)[0]) as z:
        lists = re.findall('errorStyle="(.*?)" sqref="([A-Z]+)2:', z.read("xl/worksheets/sheet1.xml").decode())
    assert len(lists) == 3 + 2 * 4 and [c for kind, c in lists if kind == "warning"] == ["F"]


def test_recall_by_vector_or_time(spark):
    entry = "id long, user_id string, updated_at timestamp_ntz, expires_at timestamp_ntz, embedding array<float>, kind string"
    t = lambda d: __import__("datetime").datetime(2024, 1, d)
    rows = [(k, "u", t(1 + k), None, [1.0, float(k)] if k != 3 else None, "fact") for k in range(6)] + [(10, "u", t(20), t(21), [1.0, 0.0], "old"), (11, "v", t(2), None, [0.0, 0.0], "zero"), (12, None, t(2), None, [1.0, 0.0], "none")]
    asks = spark.createDataFrame([(1, "u", [1.0, 0.0], "x"), (2, "u", None, "x"), (3, "v", [1.0, 0.0], "x"), (4, "v", None, "x"), (5, "w", None, "x"), (6, None, None, "x")], "ask_id long, user_id string, vector array<float>, kind string")
    out = memory.recalled(spark.createDataFrame(rows, entry), asks, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 3)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.ask_id, r.rn)):
        got.setdefault(r.ask_id, []).append((r.id, r.dist))
    assert [i for i, _ in got[1]] == [0, 1, 2] and got[1][0][1] == 0 and got[2] == [(5, None), (4, None), (3, None)] and got[4] == [(11, None)] and set(got) == {1, 2, 4}
    assert memory.recalled(spark.createDataFrame([], entry), asks, F.current_timestamp()).count() == 0


def test_recall_ranks_before_the_exchange(spark, sf):
    from __spark_entry__ import queries

    plan = queries()["long_term_recalled"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_recall_in_blocks_is_that_of_every_pair(spark, monkeypatch):
    """However many slices and blocks a user's rows make, and no join makes a row a pair."""
    entry = "id long, user_id string, updated_at timestamp_ntz, expires_at timestamp_ntz, embedding array<float>"
    t = lambda k: __import__("datetime").datetime(2024, 1, 1 + k % 20)
    odd = {3: None, 5: [0.0, 0.0], 7: [1.0], 9: [1.0, None], 11: []}
    rows = [(k, "ab"[k % 3 == 0], t(k), None, odd.get(k, [float(k % 7), float(k % 5) - 2])) for k in range(120)]
    asked = [(k, "abc"[k % 3], [None, [1.0, 0.5], [0.0, 0.0], [2.0], [-1.0, float(k)]][k % 5]) for k in range(60)]
    m, asks = spark.createDataFrame(rows, entry), spark.createDataFrame(asked, "ask_id long, user_id string, vector array<float>")
    want = []
    for a, user, v in asked:
        own = [r for r in rows if r[1] == user]
        if v is None:
            best = [(r[0], None) for r in sorted(own, key=lambda r: (r[2], r[0]), reverse=True)]
        else:
            norm = lambda x: sum(i * i for i in x) ** 0.5
            fits = [r for r in own if r[4] and None not in r[4] and len(r[4]) == len(v) and norm(v) * norm(r[4]) > 0]
            best = sorted(((r[0], round(1 - sum(x * y for x, y in zip(r[4], v, strict=True)) / (norm(v) * norm(r[4])), 6) + 0.0) for r in fits), key=lambda x: (x[1], x[0]))
        want += [(a, user, i, d, n) for n, (i, d) in enumerate(best[:5], 1)]
    for size in (1, 8, 4096):
        monkeypatch.setattr(memory, "SLICE", size)
        monkeypatch.setattr(memory, "BLOCK", size)
        out = memory.recalled(m, asks, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in sorted(out.collect(), key=lambda r: (r.ask_id, r.rn))] == want
        assert "CoGroup" in plan
