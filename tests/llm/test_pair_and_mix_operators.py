"""Near copies, mixing, packing, archives and the pipeline."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sediment.llm import packing, simhash_dedup, source_mix, warc
from sediment.llm.common import materialize, scratch_path
from sediment.llm.components import components
from sediment.llm.queries import tokenizer_path

EDGE = [(1, None), (2, ""), (3, "\n"), (4, "A b c d e f g"), (4, "A b c d e f g"), (None, "a b"), (5, "x " * 60_000), (6, "a\tb C d e f g\x1cé")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, a string, p string, id string"


def frame(spark, rows, sources=("s",)):
    return spark.createDataFrame([(i, t, None, sources[k % len(sources)], None, "f", "a", "p", "i") for k, (i, t) in enumerate(rows)], DOCS)


def brute_print(t, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^ \t-\r]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= bits:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, sf):
    rows = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(5)
    base = rows[3][1].split()
    for k in range(40):
        w = base[:]
        w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((5000 + k, " ".join(w)))
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints, 4)
    got = simhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in want}
    kept = {r.doc_id for r in simhash_dedup.keep_one(frame(spark, rows)).collect()}
    assert kept == set(want.values())


def test_near_duplicates_edge_rows(spark):
    got = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(frame(spark, EDGE)).collect()), key=repr)
    assert len(got) == len(EDGE) and {(1, 1), (2, 1), (3, 1), (4, 4)} <= set(got) and (None, None) in got
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = [r.doc_id for r in simhash_dedup.keep_one(frame(spark, EDGE)).collect()]
    assert sorted(kept, key=repr) == sorted({1, 4, 5, 6, None} & {*kept, 1, 4}, key=repr) and kept.count(4) == 1


@pytest.mark.parametrize("bits,block", [(2, 1024), (4, 1024), (4, 8), (7, 16), (8, 1024)])
def test_links_connect_what_brute_force_connects(spark, bits, block):
    rng = random.Random(bits)
    prints = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        prints.add(c)
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(1, bits + 2)):
                x ^= 1 << b
            prints.add(x)
    rows = spark.createDataFrame([(simhash_dedup._long(x),) for x in prints], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in components(simhash_dedup.links(rows, max_bits=bits, block=block)).collect()}
    want = brute_components({x: x for x in sorted(prints)}, bits)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for x in prints:
        by_got[got.get(x, x)].add(x)
        by_want[want[x]].add(x)
    assert {frozenset(v) for v in by_got.values()} == {frozenset(v) for v in by_want.values()}


def brute_alike(rows, words=5, likeness=0.8):
    """The smallest id of each component of texts whose shingle sets are alike, over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and find(i) != find(j):
                small, large = sorted((len(sets[i]), len(sets[j])))
                if sets[i] == sets[j] or small >= likeness * large and len(sets[i] & sets[j]) >= likeness * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


@pytest.mark.parametrize("block", [16, 256])
def test_near_copies_of_the_pipeline_are_those_of_the_shingle_sets(spark, sf, monkeypatch, block):
    import corpus_pipeline as cp

    monkeypatch.setattr(simhash_dedup, "SETS", block)
    rng, rows = random.Random(12), []
    for k in range(40):
        base = [f"w{k}x{rng.randrange(10**6)}" for _ in range(300)]
        for cut in (0, 5, 9, 16):
            w = list(base)
            for at in rng.sample(range(300), cut):
                w[at] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    # one large group: copies of one text with one word changed
    rows += [(1000 + k, " ".join([*base[:k], "other", *base[k + 1 :]])) for k in range(280)]
    # texts that share most of their words, but too little: they meet in buckets and must stay apart, or join in small groups
    for k in range(60):
        w = list(base)
        for at in range(0, 300, 25):
            w[at] = f"p{k % 12}y{at}"
        for at in rng.sample(range(300), k % 3):
            w[at] = f"q{rng.randrange(10**9)}"
        rows.append((3000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE two"), (2002, "one two")]
    got = [r.doc_id for r in cp.drop_near_copies(spark, frame(spark, rows), sf).collect()]
    assert sorted(got) == sorted(brute_alike(rows))


def test_near_copies_recall_over_similarities(spark):
    """Pairs from 0.8 to 1 alike: all are joined, and pairs below stay."""
    rng, rows, near = random.Random(21), [], 0
    for k in range(400):
        n = rng.randint(30, 600)
        base = [f"{k}x{rng.randrange(10**6)}" for _ in range(n)]
        w = list(base)
        for at in rng.sample(range(n), int(n * rng.uniform(0, 0.035))):
            w[at] = f"e{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
    got = sorted(r.doc_id for r in simhash_dedup.keep_one(frame(spark, rows), words=5, max_bits=4, likeness=0.8).collect())
    want = sorted(brute_alike(rows))
    near = 800 - len(want)
    assert near > 200 and 400 - near > 20
    assert set(want) <= set(got) and len(got) - len(want) <= 0.01 * near


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(40)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[200 + k] for k in range(40)} | {got[100]}) == 1 and got[300] == got[301]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        left = total - sum(done.values())
        want = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if want[s] > 3 * sizes[s]]
        if not over:
            return {**done, **want}
        done |= {s: 3 * sizes[s] for s in over}


def test_mix_targets_and_totals(spark):
    rng = random.Random(3)
    rows, src = [], []
    for s, n in (("a", 3000), ("b", 30), ("é", 200), ("c", 1), (None, 60), ("d", 400)):
        for _ in range(n):
            rows.append((len(rows), "w " * rng.choice([0, 5, 50, 300, 2000] if n < 1000 else [10, 20, 80])))
            src.append(s)
    df = spark.createDataFrame([(i, t, s, "x") for (i, t), s in zip(rows, src, strict=True)], "doc_id long, text string, source string, target string")
    got = {r.doc_id: r for r in source_mix.mix(df, block=256).collect()}
    again = {r.doc_id: r.taken for r in source_mix.mix(df.repartition(7), block=256).collect()}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t in rows:
        n = len(t.split())
        assert got[i].size == n and got[i].taken <= 3 * n and got[i].taken == again[i]
        sizes[src[i]] += n
        taken[src[i]] += got[i].taken
        longest[src[i]] = max(longest[src[i]], n)
    want = brute_targets(sizes)
    for i, _ in rows:
        assert got[i].target == pytest.approx(want[src[i]]) and got[i].source_size == sizes[src[i]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1


@pytest.mark.parametrize("block", [64, 4096])
def test_mix_reaches_targets_with_a_giant_and_beside_a_larger_source(spark, block):
    rng = random.Random(8)
    rows = [("a", 100_000), *[("a", rng.randint(50, 1000)) for _ in range(300)], *[("b", rng.randint(50, 1000)) for _ in range(40)], *[("c", rng.randint(50, 1000)) for _ in range(900)]]
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    taken, want = defaultdict(int), {}
    for r in source_mix.mix(df, block=block).collect():
        s = rows[r.doc_id][0]
        taken[s], want[s] = taken[s] + r.taken, r.target
    assert len(want) == 3 and all(abs(taken[s] - want[s]) <= 2 for s in want), (taken, want)


def test_longest_first_keeps_probabilities_and_fillable_rests():
    got = [source_mix.longest_first(np.array([100_000, 40_000]), 0.5, 300_000, k) for k in range(2000)]
    assert np.mean([t for t, _ in got], 0) == pytest.approx([0.5, 0.5], abs=0.05)
    assert all(t @ [100_000, 40_000] + rest * 160_000 == pytest.approx(150_000) for t, rest in got)
    assert all(source_mix.longest_first(np.array([900]), 0.9, 1000, k)[0][0] == 1 for k in range(50))


def test_mix_edge_rows(spark):
    out = source_mix.mix(frame(spark, EDGE, ("s", None))).collect()
    assert len(out) == len(EDGE) and all(r.taken <= 3 * r.size for r in out)
    with pytest.raises(ValueError, match="block"):
        source_mix.mix(frame(spark, EDGE), block=2)
    assert source_mix.mix(frame(spark, [])).count() == 0
    rows = source_mix.mixed_rows(frame(spark, EDGE, ("s", None)))
    assert rows.columns == frame(spark, []).columns and rows.count() >= 1


def test_mixed_rows_are_those_of_the_mix(spark):
    """Also where rows are equal, or equal but for a column that the mix does not weigh."""
    rows = [(k % 7, f"w{k % 7} " * 40, "a", k % 2) for k in range(400)] + [(100 + k, "x " * (20 + k), "b", 0) for k in range(90)] + [(1, None, None, 0)] * 3 + [(2, "", None, 0), (3, "one two", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang long").select("doc_id", "text", "source", F.col("lang").alias("__row"))
    taken = Counter()
    for r in source_mix.mix(docs, block=64, identity=tuple(docs.columns)).collect():
        taken[r.doc_id] += r.copies
    got = [tuple(r) for r in source_mix.mixed_rows(docs, block=64).collect()]
    assert Counter(r[0] for r in got) == +taken and set(got) <= set(rows)
    n = Counter(rows)
    assert all(k <= 3 * n[r] for r, k in Counter(got).items())
    words = sum(len(r[1].split()) for r in got if r[2] == "b")
    assert abs(words - brute_targets({"a": 16000, "b": sum(20 + k for k in range(90)), None: 2})["b"]) <= 55


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:04}{chr(rng.choice([97, 233, 0x4E00, 0x1F600]))}": rng.choice([0, 1, 5, 100, 10**6]) * rng.randint(1, 9) for k in range(500)} | {None: rng.randint(0, 50), "": 3}
    if seed == 3:
        sizes = {"a": 0, None: 0}
    rows = [(s, n) for s, n in sizes.items() if n < 2] + [(s, x) for s, n in sizes.items() if n >= 2 for x in (n // 2, n - n // 2)]
    got = {r.source: (r.source_size, r.target) for r in source_mix.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s][0] == sizes[s] and got[s][1] == pytest.approx(want[s], rel=1e-9) for s in sizes)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, s = rng.uniform(0.05, 0.95, 500), rng.integers(1, 900, 500).astype(float)
    out = source_mix.flight(p, s, 4)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and out @ s == pytest.approx(p @ s, abs=1e-3)


def check_packing(rows, got, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for seq in by_seq.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at and n > 0
            at += n
        assert at <= window
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_packing_is_an_exact_cover(spark, sf):
    odd = ["it's  x<|endoftext|>y", "é é ́b Straße ÀÉ ΣΑΣ İx ﬁ ３", "don't'll 한글", "a\x85b\x1fc <|startoftext|>", "“quotes” — dashes… 🙂🙂"]
    rows = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + list(enumerate(odd)) + [(10, None), (11, ""), (12, "w " * 9000)]
    cut = packing.pieces(frame(spark, rows), tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    got = packing.pack(cut, group=300).collect()
    check_packing(rows, got)
    n = sum(r.length for r in got)
    assert n / (2048 * len({r.sequence_id for r in got})) > 0.9
    assert packing.pack(packing.pieces(frame(spark, []), tokenizer_path())).count() == 0
    assert packing.pack(packing.pieces(frame(spark, EDGE), tokenizer_path())).filter("doc_id is null").count() == 1


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_differencing_partitions(k):
    x = np.random.default_rng(k).integers(1, 400, 200)
    sums, first, _, nxt = packing.difference(x, k)
    seen = []
    for s, i in zip(sums.tolist(), first.tolist(), strict=True):
        own = []
        while i >= 0:
            own.append(i)
            i = int(nxt[i])
        assert s == x[own].sum()
        seen += own
    assert sorted(seen) == list(range(200)) and len(sums) == k and sums.max() - sums.min() <= 400


PAGES = "page_id long, url string, html string, first string, digest string"


@pytest.mark.parametrize("segment,chunk", [(1 << 20, 1 << 18), (70, 16)])
def test_warc_round_trip(spark, segment, chunk):
    long = "".join(f"<p>línea {k}\r\n\r\nWARC/1.1\r\n" for k in range(60))
    texts = [(1, long), (2, long), (3, "short"), (4, "short"), (5, None), (6, ""), (7, "é" * 50), (8, "é" * 50), (9, "é" * 49), (10, "é" * 49), (None, long), (3, "other " * 30), (3, "other " * 30), (11, "\n\n\n" + "x" * 200 + "\n")]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", t, "f", "d") for i, t in texts], PAGES)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(pages.repartition(3), path, segment=segment)
    rows = warc.read_warc(spark, path, chunk=chunk).collect()
    last = [r for r in rows if r["last"]]
    want = []
    for i, t in texts:
        b = (t or "").encode()
        same = [x for x, u in texts if (u or "").encode() == b and x is not None]
        first = min(same) if len(b) >= 100 and sum((u or "").encode() == b for _, u in texts) > 1 else None
        again = first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in last]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    one = sorted((r for r in rows if r.page_id == "1"), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.chunk) for r in one) == long.encode() and all(len(r.chunk) <= chunk for r in one)
    at, sha = 0, hashlib.sha256()
    for r in one:
        sha.update(bytes(r.chunk))
        at += len(r.chunk)
        assert r.bytes_so_far == at and r.digest_so_far == sha.hexdigest()
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def placed(spark, name, data):
    """A folder with one archive of these bytes."""
    out = scratch_path(spark, "changed").removeprefix("file://").removeprefix("file:")
    os.makedirs(out)
    with (gzip.open if name.endswith(".gz") else open)(f"{out}/{name}", "wb") as f:
        f.write(data)
    return out


@pytest.fixture(scope="module")
def archive(spark):
    """The bytes of an archive of pages of 300 to 3000 bytes, most in segments, and the pages."""
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice(["<p>word</p>", "\r\n\r\n", "\n", "é", "WARC/1.1\r\n"]) for _ in range(rng.randint(100, 600)))) for k in range(60)]
    path = scratch_path(spark, "archive")
    warc.write_warc(spark.createDataFrame([(i, "u", t, "f", "d") for i, t in texts], PAGES), path, segment=700)
    return b"".join(gzip.open(f).read() for f in sorted(glob.glob(path.removeprefix("file://").removeprefix("file:") + "/part-*.gz"))), texts


def test_warc_cut_and_damaged_archives_are_told(spark, archive):
    whole, texts = archive
    rng = random.Random(3)
    for cut in [len(whole) // 2, *(rng.randrange(1, len(whole) - 8) for _ in range(4))]:
        p = placed(spark, "x.gz", whole[:cut])
        try:
            got = warc.read_warc(spark, p, strict=False).filter("last").collect()
        except PythonException:
            continue  # cut inside a header
        assert got and [r.problem for r in got[:-1]] == [None] * (len(got) - 1)
        complete = sum(r.payload_digest == hashlib.sha256(texts[int(r.page_id)][1].encode()).hexdigest() for r in got)
        assert complete == sum(r.problem is None for r in got) < len(texts)
        if any(r.problem for r in got):
            with pytest.raises(PythonException, match="bytes"):
                warc.read_warc(spark, p).collect()
    at = whole.index(b"<p>word", len(whole) // 3)
    bad = placed(spark, "x.gz", whole[:at] + b"<q>" + whole[at + 3 :])
    assert [r.problem for r in warc.read_warc(spark, bad, strict=False).filter("problem is not null").collect()] == ["payload differs from its digest"]
    with pytest.raises(PythonException, match="differs from its digest"):
        warc.read_warc(spark, bad).collect()
    # the second segment of a page goes
    first = whole.index(b"WARC-Segment-Number: 2\r\n")
    first = whole.rindex(b"WARC/1.1\r\nWARC-Type: continuation", 0, first)
    third = whole.index(b"WARC/1.1\r\nWARC-Type: ", first + 20)
    with pytest.raises(PythonException, match="continuation|payload of"):
        warc.read_warc(spark, placed(spark, "x.gz", whole[:first] + whole[third:])).collect()
    with pytest.raises(PythonException, match="starts with"):
        warc.read_warc(spark, placed(spark, "x.gz", b"HTTP/1.1 200 OK\r\n\r\n" + whole)).collect()


def test_warc_uncompressed_archives_are_put_together(spark, archive):
    whole, texts = archive
    plain = placed(spark, "x.warc", whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = warc.read_warc(spark, plain, chunk=500)
        assert spark.read.text(plain).rdd.getNumPartitions() > 8
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {int(r.page_id): r.payload_digest for r in rows if r["last"]} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts}
    one = b"".join(bytes(r.chunk) for r in sorted((r for r in rows if r.page_id == "5"), key=lambda r: r.chunk_no))
    assert one == texts[5][1].encode()


def test_warc_awkward_ids_and_long_lines(spark):
    ids = ["a\r\nWARC-Type: x", " lead", "", "é%41+b", "plain", None, "a:b\tc"]
    texts = ["x" * 3_000_000, "y" * 200, "z" * 200, "y" * 200, "v", "u", "z" * 200]
    pages = spark.createDataFrame([(i, "u", t, "f", "d") for i, t in zip(ids, texts, strict=True)], PAGES.replace("page_id long", "page_id string"))
    got = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert set(got) == set(ids) and got["a\r\nWARC-Type: x"].payload_digest == hashlib.sha256(texts[0].encode()).hexdigest()
    assert got["é%41+b"].refers_to == " lead" and got["a:b\tc"].refers_to == "" and got[" lead"].record_type == "response"


def test_warc_reader_gives_the_same_for_any_pieces(archive):
    whole, texts = archive
    rng = random.Random(4)
    for most in (1, 7, 1000, 10**6):
        reader, at, rows = warc._Reader("f", 400, True), 0, []
        while at < len(whole):
            n = rng.randint(1, most)
            rows += reader.feed(whole[at : at + n])
            at += n
        rows += reader.close()
        assert [hashlib.sha256(texts[int(r[7])][1].encode()).hexdigest() for r in rows if r[5]] == [r[10] for r in rows if r[5]] and len([r for r in rows if r[5]]) == 60


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    own = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    plain = " ".join(max((r.text for r in own.filter("lang = 'en'").collect()), key=len).split()[:90])
    extra = [(10_001, None), (10_002, ""), (10_003, "\n \n"), (10_004, "12 34 !! 56"), (10_005, plain), (10_005, plain), (None, plain + " x"), (10_006, f"{plain}\n" * 400), (10_007, "漢字仮名交じり文" * 30)]
    docs = own.unionByName(spark.createDataFrame([(i, t, None, "src1" if k % 2 else None, None) for k, (i, t) in enumerate(extra)], own.schema))
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, sf), name)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == list(cp.COLUMNS) and docs.schema.simpleString() == own.schema.simpleString()
        came, left = [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()]
        if name == "language_id":
            gone = {r[1] for r in came} - {r[1] for r in left}
            assert gone == {None, "", "\n \n", "12 34 !! 56", "漢字仮名交じり文" * 30} and len(left) == len(came) - 5
            assert all(r[2] is not None for r in left)
        if name == "line_dedup":
            want = brute_lines([(r[0], r[1]) for r in came])
            assert sorted(((r[0], r[1]) for r in left), key=repr) == sorted(want, key=repr) and all(r[4] == len(r[1]) for r in left)
        if name == "simhash_dedup":
            want = brute_alike([(r[0] if r[0] is not None else 10**9, r[1]) for r in came])
            assert sorted(r[0] if r[0] is not None else 10**9 for r in left) == sorted(want) and set(left) <= set(came)
        if name == "source_mix":
            check_mix(came, left)
        if name == "packing":
            check_packed(came, docs.collect())
    n = cp.run(spark, sf).count()
    assert n > 0
    empty = own.limit(0)
    for name, stage in cp.STAGES:
        empty = materialize(stage(spark, empty, sf), name)
        assert empty.count() == 0


def brute_lines(rows, least=10):
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(i, "\n".join(x for x in (t or "").split("\n") if n[key(x)] < least or not key(x))) for i, t in rows]


def check_mix(came, left):
    """Sources reach their targets within half of their longest document; no row more often than three times."""
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    total, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in came:
        total[s] += size(t)
        longest[s] = max(longest[s], size(t))
    for _, t, _, s, _ in left:
        taken[s] += size(t)
    for s, want in brute_targets(total).items():
        assert abs(taken[s] - want) <= longest[s] / 2 + 1
    n = Counter(came)
    assert all(k <= 3 * n[r] for r, k in Counter(left).items())


def check_packed(came, got):
    """Every copy of every document in whole, in windows without gaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want, found, by_seq = Counter(), Counter(), defaultdict(list)
    for i, text, *_ in came:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[i] += len(ids)
    for r in got:
        found[r.doc_id] += r.length
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert want == found
    for seq in by_seq.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at and n > 0
            at += n
        assert at <= 2048
