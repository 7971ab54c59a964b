"""Retrieval, ingest, sources, streams."""

from __future__ import annotations

import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sediment.operators import answers, ingest, memory
from sediment.operators import relational as O
from sediment.operators import retrieval as R
from sediment.sources import documents, tables
from sediment.streaming import counters, text_streams
from sediment.streaming.state import rocksdb

CORPUS = "chunk_id long, file_id string, seq long, doc_title string, page_no int, chunk_text string, embedding array<float>"


def corpus(spark):
    rows = [
        (1, "f", 1, "t", 1, "one " * 5, [1.0, 0.0]), (2, "f", 2, "t", 2, "two two", [0.9, 0.1]), (3, "f", 3, "t", 3, "three", None), (4, "f", 4, "u", 4, "other title", [0.0, 0.0]), (5, "g", 1, None, None, "alone", [0.0, 1.0]), (6, "g", 2, None, None, "next", [1.0]),
    ]
    return spark.createDataFrame(rows, CORPUS)


def test_vector_axis_skips_missing_and_odd_vectors(spark):
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", None), (3, "z", [0.0, 0.0])], "qid long, query string, qvec array<float>")
    assert [(r.qid, r.chunk_id) for r in R.vector_axis(q, corpus(spark)).orderBy("qid", "rn").collect()] == [(1, 1), (1, 2), (1, 5)]


def test_query_set_is_bounded(spark):
    from sediment.config import Options

    with pytest.raises(ValueError):
        R.bounded(spark.range(5).withColumnRenamed("id", "qid"), Options(max_queries=4))


def test_keyword_axis(spark):
    q = spark.createDataFrame([(1, "tw thre", None), (2, "!", None)], "qid long, query string, qvec array<float>")
    got = R.keyword_axis(q, corpus(spark)).orderBy("rn").collect()
    assert [(r.chunk_id, r.terms, r.score) for r in got] == [(2, 1, pytest.approx(0.1 * 1.25 / 1.64493406685 / 2, abs=1e-8)), (3, 1, pytest.approx(0.1 / 1.64493406685 / 2, abs=1e-8))]
    assert {(r.chunk_id, r["mode"]) for r in R.search_candidates(q, corpus(spark)).collect()} == {(2, "keyword"), (3, "keyword")}


def test_fusion_equals_outer_join(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, chunk_id long, rn int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid long, chunk_id long, rn int")
    got = {r.chunk_id: r.score for r in R.fuse({"a": a, "b": b}).collect()}
    assert got == {10: pytest.approx(1 / 61), 11: pytest.approx(1 / 62 + 1 / 61), 12: pytest.approx(1 / 62)}


def test_near_copies_keep_the_first(spark):
    rows = [(1, 1, 1, "the quick brown fox jumps"), (1, 2, 2, "the quick brown fox jumps!"), (1, 3, 3, "something else entirely"), (1, 4, 4, "a fourth text here")]
    df = spark.createDataFrame(rows, "qid long, chunk_id long, pos int, chunk_text string")
    assert [r.chunk_id for r in R.drop_near_copies(df, 2).orderBy("place").collect()] == [1, 3]
    assert [r.chunk_id for r in R.drop_near_copies(df, 9, 1.0).orderBy("place").collect()] == [1, 2, 3, 4]


def test_rerank_fallback(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, None), (2, 3, 1, 0.01), (2, 4, 2, 0.9), (2, 5, 3, 0.9)], "qid long, chunk_id long, rn int, s double")
    got = [(r.qid, r.chunk_id) for r in R.rerank(df, F.col("s"), 10).orderBy("qid", "pos").collect()]
    assert got == [(1, 1), (1, 2), (2, 4), (2, 5)]


def test_neighbors(spark):
    c = corpus(spark)
    hits = c.filter("chunk_id in (2, 5)").withColumn("qid", F.lit(1))
    got = {r.chunk_id: r for r in R.expand_neighbors(hits, c, 1).collect()}
    assert got[2].chunk_text == "one " * 5 + "\ntwo two\nthree" and got[2].page_range == [1, 3]
    assert got[5].chunk_text == "alone\nnext" and got[5].page_range is None and got[5].expanded
    tight = {r.chunk_id: r.chunk_text for r in R.expand_neighbors(hits, c, 1, 14).collect()}
    assert tight[2] == "two two\nthree"
    text = "x" * 900
    big = spark.createDataFrame([(k, "h", k, "t", k, text, None) for k in (1, 2, 3)], CORPUS)
    hit = big.filter("chunk_id = 2").withColumn("qid", F.lit(1))
    assert len(R.expand_neighbors(hit, big, 1, 1500).first().chunk_text) == 900 and len(R.expand_neighbors(hit, big, 1, 10_000).first().chunk_text) == 2702


def test_merge_keeps_first_order_and_cap(spark):
    rows = [(1, 1, 10, 1), (1, 1, 11, 2), (1, 2, 11, 1), (1, 2, 12, 2)]
    df = spark.createDataFrame(rows, "question long, query_no long, chunk_id long, chunk_rank int").withColumn("rn", F.col("chunk_rank"))
    assert [r.chunk_id for r in R.merge_queries(df, 9).orderBy("pos").collect()] == [10, 11, 12] and R.merge_queries(df, 2).count() == 2


def test_upsert_with_nulls_and_ties(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, None, 2), (3, "n", 1)], "k long, v string, __order long")
    assert sorted(map(tuple, O.upsert(base, delta, ["k"]).collect())) == [(1, "a"), (2, None), (3, "n")]
    assert O.append_with_ids(base, base.limit(0), "k", ["v"]).count() == 2


def test_appended_ids_have_no_gaps_when_partitions_are_merged(spark):
    base = spark.range(1, 6).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    new = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("v"), F.repeat(F.lit("y"), 40).alias("wide"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        rows = O.append_with_ids(base, new, "k", ["v"]).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(1, 20_006)) and [r.v for r in rows[5:]] == sorted(r.v for r in rows[5:])
        few = O.append_with_ids(base, new.unionByName(new), "k", ["v"]).agg(F.count_distinct("k"), F.max("k")).first()
        assert tuple(few) == (40_005, 40_005)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿제목;x\n값;1\n;\n".encode())
    (tmp_path / "b.tsv").write_bytes("가\t나\n".encode("cp949"))
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    got = {(r.file, r.row_no): r.cells for r in tables.read_tables(spark, str(tmp_path)).collect()}
    assert got["a.csv", 0] == ["제목", "x"] and got["a.csv", 1] == ["값", "1"] and got["b.tsv", 0] == ["가", "나"] and got["c.xlsx", 0] == [] and got["c.xlsx", 1] == ["name", "", "5"]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    bad = {r.path.rsplit("/", 1)[-1]: r.problem for r in tables.check_uploads(files, (".csv", ".xlsx")).collect()}
    assert bad == {"a.csv": None, "b.tsv": "extension", "c.xlsx": None}


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first <b>x</b>\n\nsecond\n\nthird")
    (tmp_path / "b.md").write_text("# T\nbody\n## <br>\n<br>\n")
    a, p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        shapes = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{para("Title")}</p:txBody></p:sp><p:grpSp><p:sp><p:txBody>{para("inner")}</p:txBody></p:sp></p:grpSp><p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>{para("x")}</a:txBody></a:tc><a:tc><a:txBody>{para("y")}</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>'
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {a} {p}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {a} {p}><p:cSld><p:spTree></p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {a} {p}><p:cSld><p:spTree><p:sp><p:txBody>{para('aside')}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>")
    rows = documents.read_chunks(spark, str(tmp_path)).collect()
    assert [r.chunk_text for r in rows if r.file == "a.txt"] == ["first x", "second", "third"]
    assert [(r.section_title, r.chunk_text) for r in rows if r.file == "b.md"] == [("T", "body")]
    assert [(r.section_title, r.page_no, r.chunk_text) for r in rows if r.file == "c.pptx"] == [("Title", 1, "Title\ninner\nx | y")]
    assert "aside" in documents.read_chunks(spark, str(tmp_path), "*.pptx", notes=True).first().chunk_text


def test_embedding_failures_stay_null(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(k, "bad" if k == 3 else f"t{k}") for k in range(8)], "id long, t string").coalesce(1)
    got = {r.id: r.embedding for r in ingest.embed(df, embed, "id", "t").collect()}
    assert got[3] is None and sum(v is not None for v in got.values()) == 7
    with pytest.raises(ValueError):
        ingest.check_dimension(ingest.embed(df, embed, "id", "t"), 2)


def test_classification(spark):
    rows = [(k, "q", "a" if k else "  ", None) for k in range(24)] + [(99, "q", "a", "user")]
    df = spark.createDataFrame(rows, "id long, question string, answer string, handled_by string").coalesce(1)

    def model(part):
        if any(i == 13 for i, _, _ in part):
            raise RuntimeError
        return '<think>{"x"}</think>```json\n{"results": [' + ", ".join(f'{{"id": {i}, "label": "User", "reason": "r"}}' for i, _, _ in part) + ', {"id": 1, "label": "operator"}, {"id": 777, "label": "user"}]}\n```'

    got = {r.id: r.label for r in answers.classify(df, model, 12).collect()}
    assert got == {k: "user" for k in range(1, 13)}


def test_memory(spark):
    m = spark.createDataFrame([(1, "u", "fact", " a "), (2, "u", None, "b"), (3, "u", "x", " ")], "id long, user_id string, kind string, content string")
    assert memory.memory_block(m).first().block == "- [fact] a\n- [fact] b"
    df = spark.createDataFrame([("- one\n2. two\n\n* three",)], "t string").select(memory.fact_lines(F.col("t")).alias("f"))
    assert df.first().f == ["one", "two", "three"]


def test_deltas():
    d = text_streams.Deltas()
    feed = [("partial", "ab"), ("partial", "abc"), ("partial", "d"), ("final", "abcd"), ("final", "whole"), ("partial", "x"), ("final", "y")]
    assert [d.feed(*x) for x in feed] == ["ab", "c", "d", "", "whole", "x", ""]


def test_markers_do_not_depend_on_cuts():
    text = "a chart://0123456789abcdef b chart:/ x chart://zz chart://fedcba9876543210 end chart:"
    table = {"0123456789abcdef": "ONE", "fedcba9876543210": "TWO"}
    whole = text_streams.Markers(table.get)
    want = whole.feed(text) + whole.flush()
    assert "ONE" in want and "TWO" in want and want.endswith("chart:")
    rng = random.Random(7)
    for _ in range(200):
        m, out, at = text_streams.Markers(table.get), "", 0
        while at < len(text):
            n = rng.randint(1, 9)
            out, at = out + m.feed(text[at : at + n]), at + n
        assert out + m.flush() == want


def write_pieces(spark, src, parts, at=0):
    for k, part in enumerate(parts, at):
        spark.createDataFrame(part, text_streams.SCHEMA).coalesce(1).write.parquet(f"{src}/{k}")


def run_stream(spark, tmp_path, build, out="out"):
    """What a stream over the pieces in the folder writes, and has written, under its checkpoint."""
    stream = spark.readStream.schema(text_streams.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        q = build(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / out), "parquet")
        assert q.awaitTermination(240)
    return sorted(map(tuple, spark.read.schema(text_streams.OUT).parquet(str(tmp_path / out)).collect()))


BUILDS = {
    "markers": lambda s: text_streams.replace_markers(s, {"fedcba9876543210": "IMG"}, None),
    "new": lambda s: text_streams.new_text(s, None),
    "whole": lambda s: text_streams.hold_until_end(s, str.upper, None),
}
PIECES = [
    [("r", 0, "partial", "see cha"), ("q", 0, "partial", "x"), ("e", 0, "partial", "half chart")], [("r", 1, "partial", "rt://fedcba9876543210"), ("q", 1, "final", "xy"), ("e", 1, "error", ":/")],
    [("r", 2, "end", " ok"), ("q", 2, "end", ""), ("z", 0, "partial", None)],
]
WANT = {
    "markers": {"r": "see IMG ok", "q": "xxy", "e": "half chart:/"},
    "new": {"r": "see chart://fedcba9876543210", "q": "xy", "e": "half chart"},  # what ends a message repeats it
    "whole": {"r": "SEE CHART://FEDCBA9876543210 OK", "q": "XXY"},
}


def texts(rows):
    return {k: "".join(d for r, _, d in rows if r == k) for k in {r for r, _, _ in rows}}


@pytest.mark.parametrize("name", list(BUILDS))
def test_stateful_streams_go_on_after_a_restart(spark, tmp_path, name):
    """Stopped in the middle of each request and started from the checkpoint, a stream writes the same rows as one that ran through."""
    through, stopped = tmp_path / "through", tmp_path / "stopped"
    write_pieces(spark, str(through / "in"), PIECES)
    whole = run_stream(spark, through, BUILDS[name])
    assert texts(whole) == WANT[name]
    for k, part in enumerate(PIECES):
        write_pieces(spark, str(stopped / "in"), [part], k)
        got = run_stream(spark, stopped, BUILDS[name])
    assert got == whole


def test_a_timer_ends_requests_that_are_cut_off(spark, tmp_path):
    """What waited for more goes out when no more came, and the state is gone; a whole that was never reviewed stays unsaid."""
    write_pieces(spark, str(tmp_path / "in"), [[("r", 4, "partial", "see chart:/"), ("q", 0, "partial", "done"), ("q", 1, "end", "")]])
    source = spark.readStream.schema(text_streams.SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streams = {"cut_markers": text_streams.replace_markers(source, {}, 1500), "cut_whole": text_streams.hold_until_end(source, str.upper, 1500)}
    for name, out in streams.items():
        with rocksdb(spark):
            q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="300 milliseconds").start()
        try:
            until = time.monotonic() + 90
            rows = lambda: sorted((r.request_id, r.seq, r.delta) for r in spark.table(name).collect())  # noqa: B023, E731
            want = [("q", 0, "done"), ("r", 4, "chart:/"), ("r", 4, "see ")] if name == "cut_markers" else [("q", 1, "DONE")]
            gone = lambda: q.lastProgress and q.lastProgress.stateOperators and q.lastProgress.stateOperators[0].customMetrics.get("numExpiredTimers", 0) + q.lastProgress.stateOperators[0].numRowsTotal == 0  # noqa: B023, E731
            while time.monotonic() < until and not (rows() == want and gone()):
                time.sleep(0.5)
            assert rows() == want and gone()
        finally:
            q.stop()


def test_summary_counts_are_forgotten_after_their_time(spark, tmp_path):
    """State TTL: a conversation that was quiet for too long counts from nothing."""
    due = {}
    for name, ttl in (("short", 2000), ("long", 600_000)):
        top = tmp_path / name
        source = lambda: spark.readStream.schema("conv_id long, id long").option("recursiveFileLookup", "true").parquet(str(top / "in"))  # noqa: B023, E731
        for k, ids in enumerate(([1, 2], [3], [4, 5])):
            spark.createDataFrame([(1, i) for i in ids], "conv_id long, id long").coalesce(1).write.parquet(str(top / "in" / str(k)))
            with rocksdb(spark):
                q = counters.due_summaries(source(), 3, ttl).writeStream.option("checkpointLocation", str(top / "c")).trigger(processingTime="200 milliseconds").start(str(top / "out"), "parquet")
            until = time.monotonic() + 60
            while time.monotonic() < until and not sum(p.numInputRows for p in q.recentProgress):
                time.sleep(0.2)
            q.stop()
            time.sleep(2.5 if name == "short" else 0)  # longer than the state lives
        due[name] = [tuple(r) for r in spark.read.schema("conv_id long, n long, upto long").parquet(str(top / "out")).collect()]
    assert due == {"short": [], "long": [(1, 3, 3)]}


def test_publish_rolls_back(spark):
    f = spark.createDataFrame([("1", "t", "archived"), ("2", "t", "published"), ("3", "u", "published")], "file_id string, title string, status string").withColumn("published_at", F.lit(None).cast("timestamp"))
    out = {r.file_id: r.status for r in ingest.publish(f, f.filter("file_id = '1'"), F.current_timestamp()).collect()}
    assert out == {"1": "published", "2": "archived", "3": "published"}
    assert counters.request_counters  # run as a query in test_queries


@pytest.mark.parametrize(
    "said,want",
    [
        ('<think>{}</think>```json\n{"mode": "Execute", "sources": ["VOC", "x"], "queries": ["a", " ", "b", "c", "d"]}\n```', ("execute", ["voc"], ["a", "b", "c"])),
        ('{"mode": "look"}', ("search", ["manual", "voc"], [])),
        ("no json", None),
    ],
)
def test_plans(spark, said, want):
    from sediment.operators import messages

    got = spark.createDataFrame([(said,)], "t string").select(messages.parse_plan(F.col("t")).alias("p")).first().p
    assert (got and tuple(got)) == want


def test_message_parts(spark):
    from sediment.operators import messages

    rows = ['"plain"', '[{"type": "text", "text": "a"}, "b", {"type": "image"}]', None]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(messages.content_text(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == ["plain", "a\nb", ""]
    inner = '{"content": [{"type": "text", "text": "{\\"stdout\\": \\"x\\"}"}]}'
    assert messages.unwrapped(inner) == '{"stdout": "x"}' and messages.unwrapped('{"result": []}') == "[]" and messages.unwrapped("x") == "x"


def test_registry(spark):
    from sediment.operators import registry

    c = spark.createDataFrame([("My Quota", "x"), ("My quota now", "x"), ("할당량", "quota report -u {user_id}"), ("한글", "한글"), ("9 lives", None)], "title string, exec_command string")
    taken = spark.createDataFrame([("my_quota",)], "tool_name string")
    got = {r.title: r.tool_name for r in registry.tool_names(c, taken).collect()}
    assert got["My Quota"] == "my_quota_2" and got["My quota now"] == "my_quota_3" and got["할당량"] == "quota_report" and got["9 lives"] == "lives" and got["한글"].startswith("k")
    assert registry.guess_column(["Id", "질문 내용", "Answer"], ["질문", "question"]) == "질문 내용" and registry.guess_column(["a"], ["b"]) == ""
    rec = spark.createDataFrame([(1, "q", "a", "user"), (2, "q", "a", "user")], "id long, question string, answer string, handled_by string")
    out = {r.id: (r.answer, r.handled_by) for r in registry.edit_records(rec, rec.filter("id = 1").withColumn("answer", F.lit("new"))).collect()}
    assert out == {1: ("new", None), 2: ("a", "user")}


def test_prefetch_routes_and_falls_back(spark):
    calls = []

    def search(name, hits):
        def run(q):
            asked = q.collect()
            calls.append((name, sorted((r.qid, r.query) for r in asked)))
            return spark.createDataFrame([(r.qid, f"{name}:{r.query}") for r in asked if any(w in r.query for w in hits)], "qid long, hit string")

        return run

    questions = spark.createDataFrame(
        [(1, "abbr", "before abbr", "search", ["manual"]), (2, "nothing", "login nothing", "search", ["manual", "voc"]), (3, "run it", "run it", "execute", ["manual"]), (4, "case", "case", "search", ["manual"]), (5, "empty", "empty", "search", ["voc"])],
        "qid long, query string, merged string, mode string, sources array<string>",
    )
    got = sorted((r.qid, r.source, r.step, r.hit) for r in R.prefetch(questions, search("m", ["abbr", "login"]), search("v", ["case"])).collect())
    assert got == [(1, "manual", 1, "m:abbr"), (2, "manual", 3, "m:login nothing"), (4, "voc", 2, "v:case")]
    assert calls == [("m", [(1, "abbr"), (2, "nothing"), (4, "case")]), ("v", [(2, "nothing"), (5, "empty")]), ("m", [(5, "empty")]), ("v", [(4, "case")]), ("m", [(2, "login nothing")]), ("v", [(2, "login nothing")])]


def test_record_search_labels_clips_masks_and_never_filters_by_label(spark):
    long = "disk quota is full " * 200
    rows = [(1, "disk quota is full", "확인 결과 증설 했습니다", None, [1.0, 0.0]), (2, "disk quota is full?", "ask kim.minsu please", "user", [1.0, 0.1]), (3, long, "an answer of its own", "", [0.9, 0.1]), (4, "disk quota is full", "확인 결과 증설 했습니다", "unknown", [1.0, 0.0])]
    records = spark.createDataFrame(rows, "id long, question string, answer string, handled_by string, embedding array<double>")
    queries = spark.createDataFrame([(9, "disk quota is full", [1.0, 0.0])], "qid long, query string, qvec array<double>")
    got = {r.id: r for r in R.search_records(queries, records).collect()}
    assert set(got) == {1, 2, 3} and got[1].handled_by == "operator" and got[2].handled_by == "user" and got[3].handled_by == "unknown"
    assert "kim.minsu" not in got[2].answer and got[3].question.endswith("…(이하 생략)") and len(got[3].question) < 1520
    for label in ("user", "operator", "unknown", None):
        relabelled = records.withColumn("handled_by", F.lit(label).cast("string"))
        assert {r.id for r in R.search_records(queries, relabelled).collect()} == set(got)


def test_stage_counts_tell_where_candidates_fell(spark):
    rows = lambda *q: spark.createDataFrame([(x,) for x in q], "qid long")
    got = {r.qid: (r.candidates, r.ranked, r.final) for r in R.stage_counts(candidates=rows(1, 1, 2, 3), ranked=rows(1, 2), final=rows(1)).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 1, 0), 3: (1, 0, 0)}


def test_folders_under_a_root(spark, tmp_path):
    (tmp_path / "root/in").mkdir(parents=True)
    (tmp_path / "root/in/a.md").write_text("# T\nx")
    (tmp_path / "root/in/b.xlsx").write_bytes(b"no zip")
    (tmp_path / "other").mkdir()
    (tmp_path / "root/link").symlink_to(tmp_path / "other")
    root = str(tmp_path / "root")
    assert documents.under(root, "/in/../in/a.md").endswith("root/in/a.md")
    for bad in ("..", "in/../../other", "link", "link/x"):
        with pytest.raises(ValueError, match="outside"):
            documents.under(root, bad)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in documents.listing(spark, root, "in").collect()) == ["a.md", "b.xlsx"]
    got = {r.path.rsplit("/", 1)[-1]: r.problem for r in documents.read_under(spark, root, "in", (".md", ".xlsx")).collect()}
    assert got == {"a.md": None, "b.xlsx": "content"}


def test_retention_and_unlimited(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, None)], "k long, t string").withColumn("t", F.to_timestamp_ntz("t"))
    now = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    assert {r.k for r in O.retained(rows, "t", now, 24).collect()} == {2, 3} and O.retained(rows, "t", now, 0).count() == 3
    assert O.first_rows(rows, [F.col("k")], 0).count() == 3 and [r.k for r in O.first_rows(rows, [F.desc("k")], 2).collect()] == [3, 2]
