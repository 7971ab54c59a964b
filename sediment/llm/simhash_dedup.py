"""Operator 6: near duplicates by SimHash, with candidates from pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .common import bound_arrow, materialize, row_place
from .components import components

BITS = 64
#: Members of a bucket that one task compares with one another, or with as many others.
BLOCK = 512
#: Min-hash keys of a document, each over so many minima: pairs 0.8 alike share a key with probability 0.999, at 0.3 with 0.02.
BANDS, ROWS = 24, 6
#: Shingle sets of one block, and about the bytes of them, that one task compares with one another or with another block.
SETS, SET_BYTES = 256, 16 << 20


def hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included, of the text with A-Z lower-cased; fewer words are one shingle, no words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    n = max(1, len(w) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(starts, ends[len(w) - n :].tolist(), strict=True)), np.uint64, n)


def simhash(h: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of ``h``; as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of the text; 0 without words."""
    return simhash(hashes(text, words, seed))


def fingerprints(text: Column, words: int = 4) -> Column:
    """A long column; its bits are the fingerprint."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return of(text)


def segments(max_bits: int) -> list[int]:
    """Masks of max_bits + 1 consecutive segments of the fingerprint, laid in a ring."""
    m = max_bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(m)]


def chain_masks(max_bits: int) -> list[tuple[int, int]]:
    """(start segment, mask) of each index table.

    With max_bits + 1 segments, fingerprints that differ in max_bits bits or
    fewer have a segment from which every chain of l segments differs in
    l - 1 bits at most. Hence that segment is equal, and the two after it
    differ in two bits at most: cut into four pieces, two of them are equal.
    A mask holds the first segment and one choice of two pieces.
    """
    seg, m, out = segments(max_bits), max_bits + 1, []
    chain = min(3, m)
    for i in range(m):
        tail = [1 << b for k in range(1, chain) for b in range(BITS) if seg[(i + k) % m] >> b & 1]
        budget = chain - 1
        pieces = [sum(tail[len(tail) * p // (2 * budget) : len(tail) * (p + 1) // (2 * budget)]) for p in range(2 * budget)]
        out += [(i, seg[i] | sum(c)) for c in combinations(pieces, budget)]
    return out


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(f: np.ndarray, start: int, seg: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of ``f`` pass every chain from ``start`` and then the full Hamming check.

    The chain of three segments prunes all pairs at once; longer ones and the
    full check see what is left.
    """
    x = f[:, None] ^ f[None, :]
    near = np.bitwise_count(x & np.bitwise_or.reduce(seg[[(start + k) % len(seg) for k in range(min(3, len(seg)))]])) < min(3, len(seg))
    a, b = np.nonzero(near)
    left, total = x[a, b], np.zeros(len(a), np.uint8)
    fits = np.ones(len(a), bool)
    for k in range(len(seg)):
        total += np.bitwise_count(left & seg[(start + k) % len(seg)])
        fits &= total <= k
    ok = np.zeros_like(near)
    ok[a, b] = fits & (np.bitwise_count(left) <= max_bits)
    return ok


def _chained(x: int, start: int, seg: list[int], max_bits: int) -> bool:
    """The same for one pair, given its differing bits."""
    total = 0
    for k in range(len(seg)):
        total += (x & seg[(start + k) % len(seg)]).bit_count()
        if total > k:
            return False
    return x.bit_count() <= max_bits


def _forest(ok: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    label = np.arange(len(ok))
    while True:
        new = np.where(ok, label[None, :], len(ok)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(prints: DataFrame, fp: str = "fp", max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in ``max_bits`` bits or fewer.

    They connect all that should be connected, though not every pair: within
    one bucket a spanning forest is enough. Buckets with one member are
    dropped after counting; one with more than ``block`` members is cut into
    blocks that are compared pairwise, so no task holds more than two blocks
    and no pair is missed.
    """
    masks, masks_of = chain_masks(max_bits), segments(max_bits)
    seg = np.array(masks_of, np.uint64)
    starts = [i for i, _ in masks]
    keys = prints.select(F.col(fp).alias("f"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_long(m))) for _, m in masks])).alias("j", "k"))
    sizes = materialize(keys.groupBy("j", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    own = F.pmod(F.xxhash64("f"), F.col("nb"))
    members = keys.join(sizes, ["j", "k"]).withColumn("nb", F.ceil(F.col("n") / block)).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = members.select("j", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "f")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray, last: bool) -> tuple[np.ndarray, list[np.ndarray]]:
            """Edges of the groups that end in ``rows``; the last group may go on in the next batch."""
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            bounds = [0, *cut.tolist(), len(rows)]
            out = []
            for x, y in zip(bounds[:-1], bounds[1:] if last else bounds[1:-1], strict=False):
                if y - x == 2:
                    pair = rows[x:y, 4].copy().view(np.uint64)
                    if _chained(int(pair[0] ^ pair[1]), starts[rows[x, 0]], masks_of, max_bits):
                        out.append(pair[:, None])
                elif y - x > 2:
                    f = rows[x:y, 4].copy().view(np.uint64)
                    root = _forest(_linked(f, starts[rows[x, 0]], seg, max_bits))
                    tied = np.flatnonzero(root != np.arange(len(f)))
                    if len(tied):
                        out.append(np.stack([f[tied], f[root[tied]]]))
            return (np.concatenate(out, 1) if out else np.zeros((2, 0), np.uint64)), ([] if last else [rows[bounds[-2] :]])

        def batch(e: np.ndarray) -> pa.RecordBatch:
            e = np.unique(e, axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1))
                e, held = found(np.concatenate(held), False)
                if e.size:
                    yield batch(e)
        if held:
            yield batch(found(np.concatenate(held), True)[0])

    group = ["j", "k", "lo", "hi"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Fingerprints are made once and written; equal ones are one node. Nodes
    within ``max_bits`` bits are linked, links are followed to components, and
    ids meet their component by fingerprint. No link, component or
    fingerprint goes to the driver.

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows repeat their result. Null ids take part, but a component of
    null ids only has a null component_id. Other columns are not read.
    """
    bound_arrow(docs.sparkSession)
    rows = materialize(docs.select(F.col(id).alias("id"), fingerprints(F.col(text), words).alias("fp")), "prints")
    return rows.join(fingerprint_components(rows, max_bits), "fp").select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id"))


def fingerprint_components(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id) for each distinct ``fp`` of ``rows`` (id, fp)."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes, "fp", max_bits))
    node_root = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    node_root = materialize(node_root, "roots")
    smallest = materialize(node_root.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return materialize(node_root.join(smallest, "root").select("fp", "component_id"), "classes")


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, in order."""
    return np.unique(hashes(text, words))


_MIXERS = np.random.default_rng(20111).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def set_keys(shingles: np.ndarray) -> tuple[int, list[int]]:
    """A hash of the set, and its min-hash keys; none for an empty set."""
    whole = xxhash.xxh64_intdigest(shingles.tobytes())
    if not len(shingles):
        return whole, []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        x = shingles[k : k + 1024, None] * _MIXERS[0] + _MIXERS[1]
        low = np.minimum(low, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    return whole, [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, ROWS))]


_KEYS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _keys(text: Column, words: int) -> Column:
    """Fingerprint, hash and size of the shingle set, and its min-hash keys, from one pass over the words."""

    @F.pandas_udf(_KEYS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                h = hashes(t, words)
                own = np.unique(h)
                node, bands = set_keys(own)
                rows.append((simhash(h), _long(node), len(own), np.array(bands, np.uint64).view(np.int64)))
            yield pd.DataFrame(rows, columns=["fp", "node", "size", "bands"])

    # marked so that the optimiser does not run it once for each field
    return of.asNondeterministic()(text)


def _sets(text: Column, words: int) -> Column:
    @F.pandas_udf("binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, words).tobytes() for t in batch], dtype=object)

    return of(text)


def alike(sets: list[np.ndarray], likeness: float) -> np.ndarray:
    """Which pairs of sets (distinct values, in order) have a Jaccard similarity of ``likeness`` or more."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    shared = np.zeros((n, n), np.int64)
    if n < 8:
        for i, j in combinations(range(n), 2):
            if min(size[i], size[j]) >= likeness * max(size[i], size[j]) - 1e-9:
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        own, (value, at, times) = np.repeat(np.arange(n), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        keep = times[at] > 1
        own, at = own[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        # values that two sets hold or more, some columns at a time
        for k in range(0, int((times > 1).sum()), 4096):
            x, y = np.searchsorted(at, (k, k + 4096))
            m = np.zeros((n, 4096), np.float32)
            m[own[x:y], at[x:y] - k] = 1
            shared += (m @ m.T).astype(np.int64)
    union = size[:, None] + size[None, :] - shared
    return (shared >= likeness * union - 1e-9) & (union > 0)


def confirmed(dealt: DataFrame, sets: DataFrame, group: list[str], likeness: float) -> DataFrame:
    """Edges (a, b) that connect, in each group of ``dealt`` (node and ``group``), all pairs of sets that are alike."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        root = _forest(alike([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], likeness) | np.eye(len(node), dtype=bool))
        tied = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[tied], "b": node[root[tied]]})

    return materialize(dealt.hint("merge").join(sets.select("node", "shingles"), "node").groupBy(*group).applyInArrow(run, "a long, b long"), "confirmed")


def _blocks(n: Column, size: Column) -> Column:
    """So many blocks that one has about SETS sets and SET_BYTES bytes of them at most."""
    return F.greatest(F.lit(1), F.ceil(n / SETS), F.ceil(8 * size / SET_BYTES)).cast("long")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def candidates(nodes: DataFrame, max_bits: int, likeness: float) -> tuple[DataFrame, DataFrame]:
    """(stars, members) of ``nodes`` (node, size, fp, bands): edges (a, b, size of a) to be compared, and the buckets they come from.

    A bucket is the nodes that share a min-hash key; its lead is the smallest,
    and a star is its other nodes with the lead, without those whose size
    alone rules a similarity out. Buckets with the same nodes are one. Nodes
    with fingerprints within ``max_bits`` bits, which the chains of ``links``
    find, are added to the stars.
    """
    keys = nodes.select(F.explode("bands").alias("k"), "node", "size")
    sums = [F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(20111), "node")).alias("s2")]
    shared = keys.groupBy("k").agg(F.min("node").alias("lead"), F.min_by("size", "node").alias("lead_size"), F.count(F.lit(1)).alias("n"), *sums).filter("n > 1")
    buckets = shared.groupBy("n", "s1", "s2", "lead", "lead_size").agg(F.min("k").alias("k")).drop("s1", "s2")
    members = materialize(keys.join(materialize(buckets, "buckets"), "k"), "members")
    fits = F.least("size", "lead_size") >= likeness * F.greatest("size", "lead_size") - 1e-9
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    to = lambda x, y: prints.select(F.col("fp").alias(x), F.col("lead").alias(y))
    by_print = links(prints.select("fp"), "fp", max_bits).withColumnsRenamed({"a": "fa", "b": "fb"}).join(to("fa", "a"), "fa").join(to("fb", "b"), "fb").select("a", "b")
    same_print = nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    edges = members.filter(fits).select(F.col("node").alias("a"), F.col("lead").alias("b")).unionByName(by_print).unionByName(same_print).filter("a <> b").distinct()
    return materialize(edges.join(nodes.select(F.col("node").alias("a"), "size"), "a"), "stars"), members


def alike_classes(rows: DataFrame, text: DataFrame, words: int, max_bits: int, likeness: float) -> DataFrame:
    """(node, component_id) of ``rows`` (id, place, fp, node, size, bands): components of pairs whose shingle sets are ``likeness`` alike.

    ``text`` (place, text) has the texts. Documents with one shingle set are
    one node. Stars are compared first, in blocks of their nodes with the
    lead, and pairs that are alike link. What is left to compare is pairs of
    one bucket that no links connect: in each bucket the nodes outside its
    largest component meet all others, in blocks. So a group of copies costs
    its size, however large it is, and no pair of a bucket is passed over.
    """
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("place").alias("place"), F.first("bands").alias("bands")), "nodes")
    stars, members = candidates(nodes, max_bits, likeness)
    several = members.filter((F.col("n") > 2) & (F.col("node") != F.col("lead")))
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(several.select("node")).distinct()
    wanted = materialize(nodes.select("node", "place").join(wanted, "node"), "wanted")
    # merged at every size, so that small tables show what large ones cost
    sets = materialize(text.join(wanted.hint("merge"), "place").select("node", _sets(F.col("text"), words).alias("shingles")), "sets")

    per = materialize(stars.groupBy("b").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("nb")), "blocks")
    rays = stars.join(per, "b").select(F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.col("nb")).alias("block"), F.col("a").alias("node"))
    first = confirmed(rays.unionByName(per.select(F.col("b").alias("lead"), _each(F.col("nb")).alias("block"), F.col("b").alias("node"))), sets, ["lead", "block"], likeness)

    labels = materialize(components(first), "labels")
    open_ = materialize(several.join(labels, "node", "left").select("k", "node", "size", F.coalesce("root", "node").alias("label")), "open")
    shares = open_.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = shares.groupBy("k").agg(F.max(F.struct("n", "size", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("labels > 1")
    of_most, of_rest = _blocks(F.col("most.n"), F.col("most.size")), _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    mixed = materialize(mixed.select("k", F.col("most.label").alias("most"), of_most.alias("nm"), of_rest.alias("nr")), "mixed")
    left = open_.join(mixed, "k").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("most"), F.col("nm")).otherwise(F.col("nr"))))
    large, small = left.filter("label = most"), left.filter("label <> most")
    dealt = large.select("k", F.lit(0).alias("part"), _each(F.col("nr")).alias("x"), F.col("own").alias("y"), "node")
    dealt = dealt.unionByName(small.select("k", F.lit(0).alias("part"), F.col("own").alias("x"), _each(F.col("nm")).alias("y"), "node"))
    # one block of the rest is compared within itself in each of the former
    among = small.filter("nr > 1").select("k", F.lit(1).alias("part"), "own", _each(F.col("nr")).alias("other"), "node")
    dealt = dealt.unionByName(among.select("k", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node"))
    second = confirmed(dealt, sets, ["k", "part", "x", "y"], likeness)

    roots = components(first.unionByName(second))
    node_root = materialize(nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "roots")
    smallest = node_root.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(node_root.join(smallest, "root").select("node", "component_id"), "classes")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4, likeness: float | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, of which one stays in each component: that with the smallest id.

    With ``likeness`` links join documents whose sets of word shingles have
    that Jaccard similarity or more, and fingerprints within ``max_bits``
    bits only name candidates, beside min-hash keys; without, fingerprints
    within ``max_bits`` link. Null and empty texts are alike. Of rows that
    repeat an id and text one stays. Where a component has null ids only, one
    row of each of its texts stays (without ``likeness``: fingerprints).
    """
    bound_arrow(docs.sparkSession)
    keys = _keys(F.col(text), words) if likeness is not None else F.struct(fingerprints(F.col(text), words).alias("fp"))
    printed = materialize(docs.withColumn("__keys", keys), "printed").select("*", row_place().alias("__place"))
    rows = printed.select(F.col(id).alias("id"), F.col("__place").alias("place"), "__keys.*")
    if likeness is not None:
        classes, of = alike_classes(rows, printed.select(F.col("__place").alias("place"), F.col(text).alias("text")), words, max_bits, likeness), "node"
    else:
        classes, of = fingerprint_components(rows.select("id", "fp"), max_bits).select("fp", "component_id"), "fp"
    stay = rows.join(classes, of).filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", of).agg(F.min("place").alias("__stays"))
    return printed.join(materialize(stay.select("__stays"), "stay").hint("merge"), F.col("__place") == F.col("__stays"), "left_semi").select(*docs.columns)
