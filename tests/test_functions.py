"""Column functions on small fixtures."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.config import DEFAULT
from sediment.functions import grams, pii, similarity, text, udfs
from sediment.operators import answers, charts, policy
from sediment.operators.relational import line_budget


def one(spark, expr, *values):
    """The value of ``expr(col a, col b, ...)`` on one row."""
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize(
    "raw,want",
    [
        ("ssh <user>@<host>", "ssh <user>@<host>"),
        ("<p>a</p><br/>b", "a b"),
        ("x<!-- no -->y", "x y"),
        ("<script>var a = '<b>';</script>t", "t"),
        ("a&nbsp;&amp;&lt;b&gt;", "a &<b>"),
        ("a b​c\x00d", "a bcd"),
        ("![i](u) [t](v)", "t"),
        ("a  \t b \n\n\n\n c ", "a b\n\nc"),
        ("", ""),
    ],
)
def test_cleaning(spark, raw, want):
    assert one(spark, text.clean_native, raw) == want
    assert udfs.clean(raw) == want


def test_code_stays_as_written():
    t = "<b>x</b> `<b>  &amp;` y\n```\n<div>  a\n```"
    assert udfs.clean(t) == "x `<b>  &amp;` y\n```\n<div>  a\n```"
    assert udfs.clean("Ａ① &hellip;") == "A1 …"


def test_sections_drop_bare_headers(spark):
    md = "intro\n# A\nx\ny\n## B\n### C\nz"
    want = [(None, "intro"), ("A", "x\ny"), ("C", "z")]
    assert [tuple(r) for r in one(spark, text.sections, md)] == want and udfs.sections_of(md) == want


def test_packing_paragraphs():
    assert udfs.pack_paragraphs("a\n\nb\n\nc", 6, 0) == ["a\n\nb", "c"]
    cut = udfs.pack_paragraphs("w " * 2000, 1500, 200)
    assert len(cut) == 3 and cut[0] == ("w " * 2000)[:1500] and cut[1].startswith("w ") and "\n" in cut[1]
    assert udfs.pack_paragraphs("", 10) == [""]


def test_hard_cut(spark):
    assert one(spark, lambda t: text.hard_cut(t, 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(spark, lambda t: text.hard_cut(t, 3), "") == [""]


@pytest.mark.parametrize("tok,want", [("서버에서는", "서버"), ("접근하려면", "접근"), ("은", "은"), ("가가", "가가"), ("server", "server"), ("위치를", "위치")])
def test_suffix(spark, tok, want):
    assert one(spark, text.strip_suffix, tok) == want


def test_tokens_and_prefixes(spark):
    assert one(spark, text.tokens, "GPU 노드에 gpu server.log 접근하려면 a") == ["GPU", "노드에", "노드", "server.log", "접근하려면", "접근"]
    assert one(spark, text.prefixes, "server.log 서버의 !") == ["serverlog", "서버의", "서버"]
    assert one(spark, text.prefixes, "! ?") == []
    assert one(spark, text.expansions, "노드에 12 접근") == ["노드에 12 접근", "노드에 노드 12 접근", "노드에 노드 접근"]


def test_trigrams(spark):
    assert one(spark, similarity.trigrams, "AbCd") == ["abc", "bcd"]
    assert one(spark, similarity.trigrams, "ab") == ["ab"] and one(spark, similarity.trigrams, "") == [""]
    j = lambda a, b: similarity.jaccard(similarity.trigrams(a), similarity.trigrams(b))
    assert one(spark, j, "", "") == 1.0 and one(spark, j, "abcd", "abce") == pytest.approx(1 / 3)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.70710678), None]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("other.user 님", "{사용자 id} 님"),
        ("server.log and www.google.com", "server.log and www.google.com"),
        ("a@b.co end", "{사용자 id} end"),
        ("see http://host.name/x/ops.user2 ops.user2", "see http://host.name/x/ops.user2 {사용자 id}"),
        ("run main.py", "run main.py"),
        ("user.name은", "user.name은"),
    ],
)
def test_accounts(spark, raw, want):
    assert one(spark, pii.mask_accounts, raw) == want


def test_people_and_organisations(spark):
    assert one(spark, pii.mask_pii, "담당자: 홍길동 확인, 김철수 책임이 플랫폼팀에 요청") == "담당자: {사용자 이름}, {사용자 이름} 책임이 {팀명}에 요청"
    assert one(spark, pii.mask_pii, "팀장 회의") == "팀장 회의"
    assert one(spark, pii.mask_accounts, "김철수 책임 플랫폼팀") == "김철수 책임 플랫폼팀"
    assert one(spark, pii.find_accounts, "a.bc x.y2 a.bc http://q.w/z") == []
    assert one(spark, pii.find_accounts, "ab.cd xx.yy2 ab.cd http://qq.ww/z") == ["ab.cd", "xx.yy2"]


def test_answers(spark):
    assert one(spark, answers.keyword_label, "설정을 변경 했습니다") == "operator" and one(spark, answers.keyword_label, None) == "unknown"
    shown = lambda a, c: answers.review(a, c, F.lit("me.here"), F.lit(True), F.lit("FB"), F.lit("FOREIGN"), F.lit("NOTE"))
    long = "this line is long enough to stay in the answer"
    assert one(spark, shown, f"{long}\nip 10.1.2.3", "ip 10.1.2.3") == f"{long}\nip 10.1.2.3"
    assert one(spark, shown, f"{long}\nip 10.1.2.4", "ip 10.1.2.3") == f"{long}\n\nNOTE"
    assert one(spark, shown, "ip 10.1.2.4", "") == "FB"
    assert one(spark, shown, "other.user did", "other.user") == "FOREIGN"
    assert one(spark, shown, f"me.here {long}", "") == f"me.here {long}"
    assert one(spark, shown, f"{long}\n/no/such/path", "") == f"{long}\n\nNOTE"


def test_policy(spark):
    words = lambda t: F.split(t, "\\|\\|\\|", -1)
    assert one(spark, lambda t: policy.denied(words(t), True), "bash|||-c|||x") == "bash"
    assert one(spark, lambda t: policy.denied(words(t), True), "ls|||/usr/bin/rm") == "rm"
    assert one(spark, lambda t: policy.denied(words(t), False), "/data/kill|||--rm|||x") is None
    assert one(spark, lambda t: policy.denied(words(t), False), "KILL") == "kill"
    for line, want in (("-u|||other", "other"), ("--user=other", "other"), ("-uother", "other"), ("-u|||me", None), ("-u|||-x", None), ("-u other", "other"), ("-v", None)):
        assert one(spark, lambda t: policy.other_user(words(t), F.lit("Me")), line) == want
    assert one(spark, lambda t: policy.token_problem(words(t)), "a|||>") == "operator" and one(spark, lambda t: policy.token_problem(words(t)), "x" * 600) == "length"
    assert one(spark, lambda t: policy.render(t, F.create_map(F.lit("p"), F.lit("a b"), F.lit("q"), F.lit(""))), "ls {p} {q} -x{p}") == ["ls", "a b", "-xa b"]
    assert udfs.shell_words("a 'b c' d") == ["a", "b c", "d"] and udfs.shell_words("a 'b") is None


@pytest.mark.parametrize("v,axis,value", [("15630", "16k", "15,630"), ("1500000", "1.5M", "1,500,000"), ("2000000", "2M", "2,000,000"), ("15630000", "15.6M", "15.63M"), ("12.5", "12.5", "12.5"), ("7", "7", "7"), (None, "", "")])
def test_number_texts(spark, v, axis, value):
    assert one(spark, lambda c: charts.axis_text(c.cast("double")), v) == axis
    assert one(spark, lambda c: charts.value_text(c.cast("double")), v) == value


def test_ticks(spark):
    t = lambda a, b: charts.ticks(a.cast("double"), b.cast("double"))
    assert one(spark, t, "0", "100") == [0, 20, 40, 60, 80, 100] and one(spark, t, "3", "3")[0] == 3.0
    lo, hi = charts.y_range(F.col("a").cast("double"), F.col("a").cast("double"), False)
    assert spark.createDataFrame([("0",)], "a string").select(lo, hi).first()[:] == (-1.0, 1.0)


def test_line_budget(spark):
    r = one(spark, lambda t: line_budget(t, 8), "abc\ndef\nghi")
    assert (r.shown, r.total, r.truncated, r.text) == (2, 3, True, "abc\ndef")
    r = one(spark, lambda t: line_budget(t, 3), "abcdef\ng")
    assert r.text == "abcdef" and one(spark, lambda t: line_budget(t, 11), "abc\ndef\nghi").truncated is False
    assert one(spark, text.fence_length, "a ``` b ````") == 5 and one(spark, text.fence_length, "a") == 3


def brute_similarity(query, t):
    """Over all stretches of the text's trigrams."""
    grams = lambda s: [f"  {w} "[i : i + 3] for w in re.findall(r"\w+", s.lower()) for i in range(len(w) + 1)]
    want, own, best = set(grams(query)), grams(t), 0.0
    for i in range(len(own) if want else 0):
        seen, shared = set(), 0
        for x in own[i:]:
            shared += x in want and x not in seen
            seen.add(x)
            best = max(best, shared / (len(want) + len(seen) - shared))
    return best


def test_word_similarity_is_that_of_the_best_stretch():
    assert udfs.word_similarity("cat", "a car") == pytest.approx(0.5)
    assert udfs.word_similarity("server location", "x " * 200 + "server location table") > 0.9
    assert DEFAULT.top_k(9999) == 20 and DEFAULT.top_k(0) == 1 and DEFAULT.candidates(500) == 100
    assert udfs.word_similarity("", "x") == udfs.word_similarity("x", "") == 0 and udfs.word_similarity("Same words", "has the same WORDS in it") == 1
    rng, words = random.Random(1), "cat car cart dog doge a the then éa 서버 위치 x1".split()
    for _ in range(300):
        q, t = (" ".join(rng.choice(words) for _ in range(rng.randint(0, n))) for n in (5, 50))
        want = brute_similarity(q, t)
        assert udfs.word_similarity(q, t) == pytest.approx(want)
        found = grams.best_extent(np.unique(grams.word_trigrams(q)), t, 0.3)
        assert found == pytest.approx(want if want >= 0.3 else 0)


def test_best_stretches_of_long_texts_for_many_queries():
    rng = random.Random(3)
    for wide in (96, 3):  # the second leaves long stretches to their own bound
        grams.WIDE = wide
        for k in range(60):
            letters = "abcdeé  " if k % 2 else "ab "
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 600)))
            t = t[:40] * 6 + t if k % 5 == 0 else t
            asked = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4)] + [t[20:70], t[5:9], ""]
            wants = [np.unique(grams.word_trigrams(q)) for q in asked]
            floor = (1e-9, 0.2, 0.4)[k % 3]
            own = grams.Extents(t, grams.Index(wants))
            got = dict(own.best(np.arange(len(asked)), np.full(len(asked), floor)))
            for i, q in enumerate(asked):
                want = brute_similarity(q, t)
                assert got.get(i, 0) == pytest.approx(want if want >= floor else 0)
            for i, _, bound, share, _ in own.runs(np.arange(len(asked)), np.full(len(asked), 1e-9)):
                assert share - 1e-9 <= brute_similarity(asked[i], t) <= bound.max() + 1e-9
    grams.WIDE = 96


def test_sections_are_linear_and_complete(spark):
    cases = {"": [], "a\nb": [(None, "a\nb")], "# T\nx\ny\n## U \n\nz\n# V": [("T", "x\ny"), ("U", "\nz")], "p\r\n# A\r\nq\r\n": [(None, "p"), ("A", "q")]}
    for t, want in cases.items():
        got = one(spark, lambda c: text.sections(c), t)
        assert [(s.title, s.body) for s in got] == want or (t == "" and [(s.title, s.body) for s in got] == [(None, "")]), t
    long = "\n".join(f"# H{k}\nline {k}" if k % 3 == 0 else f"more {k}" for k in range(40_000))
    began = time.perf_counter()
    assert len(one(spark, lambda c: text.sections(c), long)) == 13_334
    assert time.perf_counter() - began < 30


def test_only_small_tables_of_few_files_are_dealt_out(spark, tmp_path):
    from sediment.session import spread

    path = str(tmp_path / "a b%20c")
    spark.range(1000).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    moved = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    assert moved(spread(table)) and not moved(spread(table, most=100))
    assert spread(spark.range(3)).count() == 3
