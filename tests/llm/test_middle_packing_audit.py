"""Fill-in-middle, best-fit packing and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sediment.llm import best_fit, fill_middle, filter_audit
from sediment.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string"
TEXTS = [
    "", None, " ", "one two  three\n\nfour", "é€😀 mixed ÀB\tc\x00d", "<P>", "a<S>b", "a<S b> <M", "x" * 5000, "word, " * 3000, "\n" * 40, "<", "12 345 don't we'll", "日本語 text　wide", "tab\t\t two  blanks   three",
    "<|endoftext|> in  text", "ß µ ª ² ¼ '' 's 'S",
]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def some(n=3):
    """Every text under several ids, some rows twice, null ids, and columns whose names clash."""
    rows = [(100 * k + i, t, "en") for k in range(n) for i, t in enumerate(TEXTS)]
    return [*rows, rows[3], rows[3], (None, "no id here", None), (None, None, "")]


def middle(id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return id, n, "plain", None, None, t, t
    return (id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t) if h[3] % 100 < 20 else (id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t)


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_fill_in_middle_is_the_brute_force_one(spark, size):
    rows = some(12)
    df = docs(spark, rows).withColumns({"id": F.lit("clash"), "n": F.lit(0), "output": F.lit("x")})
    out = fill_middle.fill_in_middle(df, size=size).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(middle(i, t)) for i, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def ids():
    return best_fit.ByteIds(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85\xa0 abZ'sdé×ßªµ²½¬¡\x00\x7f9日😀<|endoftext|>.,!-\xad"), max_size=40) | st.text(max_size=30))
def test_byte_ids_are_those_of_whole_texts(ids, text):
    assert ids(text) == array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_plan_uses_each_piece_once_and_fills_exactly():
    rng = np.random.default_rng(5)
    for window, n in ((16, 200), (64, 5000), (1024, 3000)):
        counts = np.bincount(rng.integers(1, window + 1, n), minlength=window + 1)
        counts[window // 3] += n  # a hot length
        used = np.zeros(window + 1, np.int64)
        made = best_fit.plan(counts)
        for c, times in made:
            assert sum(k * v for k, v in c.items()) <= window and times > 0
            for k, v in c.items():
                used[k] += v * times
        assert (used == counts).all()
        total = int((counts * np.arange(window + 1)).sum())
        least = max(-(-total // window), int(counts[window // 2 + 1 :].sum()))
        assert sum(t for _, t in made) <= 1.03 * least + 1
        # the number of steps follows the window, not the number of pieces
        assert len(best_fit.plan(counts * 10**6)) <= 8 * window


def test_stock_finds_every_exact_complement():
    rng = np.random.default_rng(1)
    for _ in range(300):
        stock = best_fit.Stock(np.bincount(rng.integers(1, 30, rng.integers(1, 6)), minlength=41))
        for n in rng.integers(1, 30, 2).tolist():
            if stock.left[n]:
                stock.add(n, -1)
        pieces = [n for n in range(41) for _ in range(int(stock.left[n]))]
        sums = defaultdict(lambda: 9)
        for i, a in enumerate(pieces):
            sums[a] = 1
            for j in range(i + 1, len(pieces)):
                sums[a + pieces[j]] = min(sums[a + pieces[j]], 2)
                for k in range(j + 1, len(pieces)):
                    sums[a + pieces[j] + pieces[k]] = min(sums[a + pieces[j] + pieces[k]], 3)
        for gap in range(1, 41):
            found = stock.exact(gap)
            assert len(found) % 9 == (sums[gap] if gap in sums else 9) % 9 and (not found or sum(found) == gap and not Counter(found) - Counter(pieces))


def check_packed(rows, source, window, ids):
    whole = defaultdict(list)
    for i, t, *_ in source:
        whole[i].append(ids(t or "") + array("I", [2]).tobytes())
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(w[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(w) // 4 >= r.start + r.length for w in whole[r.doc_id])
    for own in seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= window
    want = sorted((repr(i), s, n) for i, ws in whole.items() for w in ws for s, n in best_fit.piece_bounds(len(w) // 4, window))
    assert sorted((repr(r.doc_id), r.start, r.length) for r in rows) == want
    return len(seq)


@pytest.mark.parametrize("window", [1024, 16])
def test_packing_covers_every_document_once(spark, ids, window):
    source = some(4)
    df = docs(spark, source).withColumns({"id": F.lit("clash"), "length": F.lit(0), "n": F.lit(0)}).repartition(3)
    cut = best_fit.pieces(df, tokenizer_path("byte_bpe_50k.json"), window=window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    n = check_packed(best_fit.pack(cut, window).collect(), source, window, ids)
    total = sum(r.n for r in cut.groupBy().agg(F.sum("length").alias("n")).collect())
    assert n <= -(-total // window) * 1.1 + 1
    assert best_fit.pack(cut.limit(0), window).collect() == []


def test_pieces_of_long_documents_start_with_what_is_left():
    assert best_fit.piece_bounds(1024) == [(0, 1024)] and best_fit.piece_bounds(5) == [(0, 5)]
    assert best_fit.piece_bounds(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def fails(rows):
    out = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        e = any((y or "") == t and x is not None and (i is None or x < i) for x, y, _ in rows)
        own = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), e)
        out.append((lang or "", {f for f, x in zip("ABCDE", own, strict=True) if x}, i))
    return out


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    own, out = fails(rows), {}
    for part in {p for p, _, _ in own}:
        mine = [(f, i) for p, f, i in own if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [(m, i) for m, i in mine if f in m and not m & before]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    sum(not m & (before | {f}) for m, _ in mine), len(gone), sum(f in m and bool(m & before) for m, _ in mine), sum(m == {f} for m, _ in mine),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit_retracts_as_smaller_ids_arrive(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long + " #", long.upper(), "short", None, "", "same " * 300]
    rows = [(1000 - 7 * k, texts[k % len(texts)], ("en", "de", None, "")[k % 4]) for k in range(60)]
    # copies of one text in every file, ids falling from file to file; repeated rows; null ids
    rows += [(500 - k, long, "en") for k in range(60)] + [(441, long, "fr"), (441, long, "fr"), (None, long, "en"), (None, "only without an id", "en")]
    labels = [(441, 1, 0), (441, 0, 1), (1000, 1, 1), (993, None, None), (None, 1, 1), (7, 1, 1)] + [(i, k % 2, k % 3 == 0 and 1 or 0) for k, (i, _, _) in enumerate(rows[:40]) if i != 1000]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path = str(tmp_path / "docs")
    for k in range(6):  # files that are read one after the other
        docs(spark, rows[20 * k : 20 * k + 20] if k < 5 else rows[100:]).withColumns({"key": F.lit(1), "mask": F.lit("x"), "n": F.lit("y")}).coalesce(1).write.mode("append").parquet(path)
    want = audited(rows, labels)
    for batches in (1, 3, 100):
        got = filter_audit.audit(spark, path, lab, batches)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) == 600 * 4


def test_filter_audit_of_a_single_file_and_of_none(spark, tmp_path):
    path, none = str(tmp_path / "one"), str(tmp_path / "none")
    docs(spark, [(2, "a b", "en"), (1, "a b", "en")]).coalesce(1).write.parquet(path)
    file = next(str(p) for p in (tmp_path / "one").glob("part-*.parquet"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(spark, file, no_labels).collect())) == audited([(2, "a b", "en"), (1, "a b", "en")], [])
    docs(spark, []).write.parquet(none)
    assert filter_audit.audit(spark, none, no_labels).collect() == []


def test_a_task_hands_on_what_it_held_and_starts_again(spark):
    rows = spark.createDataFrame([(bytearray([k % 5]), 1, 100 - k, "en") for k in range(50)], "key binary, mask int, id long, part string").coalesce(1)
    out = filter_audit.combined(rows, held=3).collect()
    assert sum(r.n for r in out) == 50 and {r.mask for r in out if r.key is None} == {1 | filter_audit.COPY}
    assert {bytes(r.key): r.id for r in sorted((r for r in out if r.key is not None), key=lambda r: -r.id)} == {bytes([k]): 100 - (45 + k) for k in range(5)}
