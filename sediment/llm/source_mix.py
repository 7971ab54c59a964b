"""Operator 3: mixes sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import number_rows
from .common import hash128, materialize, row_place

#: Documents that one task balances at a time.
BLOCK = 4096
#: A document is long if it has more than MEANS times the mean words of its source and more than one part in SHARE of all of them.
MEANS, SHARE = 8, 1024
_TINY = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null: 0."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"[ \t-\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share
    the total by weight; a target stops at ``most`` times its source's size
    and what it can't take is shared again. Each round shares what the stopped
    sources leave among the others, which raises their level for a unit of
    weight and may stop more of them; the rounds end when none is stopped any
    more. A round is one sum over the table of sources, which may have very
    many rows: they are numbered in ranges, and the driver holds one number.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    per = number_rows(per, [F.col("source").asc_nulls_last()], "no")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("no"), F.lit(len(weights))).cast("int")).cast("double")
    per = materialize(per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "weights")
    level = 0.0
    while True:
        over = F.col("cap") < level * F.col("w")
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0))
        rest, open_ = per.agg(left, F.sum(F.when(~over, F.col("w")))).first()
        now = rest / open_ if open_ else None
        # every source is stopped, or none more than before
        if now is None or now <= level * (1 + 1e-12):
            break
        level = now
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return materialize(per.select("source", "n", "source_size", target.alias("target")), "targets")


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The cube method's flight: moves ``p`` until at most two are not 0 or 1, keeping sum(p) and sum(p * size).

    Three open documents have one direction in the null space of the two
    constraints; the step goes to a face of the cube, to either side with the
    probability that keeps each inclusion probability.
    """
    p, s, rng = p.astype(float).tolist(), size.astype(float).tolist(), random.Random(seed)
    open_, nxt, n = [], 0, len(p)
    while True:
        while len(open_) < 3 and nxt < n:
            if _TINY < p[nxt] < 1 - _TINY:
                open_.append(nxt)
            nxt += 1
        if len(open_) == 3:
            a, b, c = open_
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(open_) == 2 and s[open_[0]] == s[open_[1]]:
            u = (1.0, -1.0)
        else:
            break
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(open_, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(open_, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(open_, u, strict=True):
            p[i] += step * x
        still = []
        for i in open_:
            if p[i] <= _TINY or p[i] >= 1 - _TINY:
                p[i] = float(p[i] > 0.5)
            else:
                still.append(i)
        open_ = still
    return np.array([float(x > 0.5) if x <= _TINY or x >= 1 - _TINY else x for x in p])


def longest_first(size: np.ndarray, fraction: float, total: float, seed: int) -> tuple[np.ndarray, float]:
    """Decides the documents of ``size``, longest first: (taken, fraction of the source's other words to take).

    Each is taken with the fraction that is wanted of what is left, which
    keeps inclusion probabilities, unless only one choice leaves a rest that
    the other documents can fill; where none does, the nearer one is made.
    """
    rng, want, left = random.Random(seed), fraction * total, float(total)
    taken = np.zeros(len(size))
    for i, s in enumerate(size.tolist()):
        left -= s
        miss = [max(0.0, -w, w - left) for w in (want, want - s)]
        taken[i] = rng.random() * (left + s) < want if miss[0] == miss[1] else miss[1] < miss[0]
        want -= s * taken[i]
    return taken, min(1.0, max(0.0, want / left)) if left > 0 else 0.0


def _decided(group: pa.Table) -> pa.Table:
    k1, k2, size, p = (group.column(c).to_numpy() for c in ("k1", "k2", "size", "p"))
    order = np.lexsort((k2, k1, -size))
    taken, rest = longest_first(size[order], float(p[0]), float(group.column("source_size")[0].as_py()), int(k1[order[0]]))
    out = np.empty(len(p))
    out[order] = taken
    group = group.set_column(group.schema.get_field_index("p"), "p", pa.array(out))
    return group.append_column("rest", pa.array(np.full(len(p), rest)))


def landing(p: np.ndarray, size: np.ndarray, want: float) -> np.ndarray:
    """Rounds the last two or fewer open documents to what comes nearest to ``want`` words, then mends the rest.

    What no rounding reaches is mended by exchanging one taken document for
    one that is not, or by taking or leaving one, the best such step first,
    until none comes nearer by half a word.
    """
    at = np.flatnonzero((p > 0) & (p < 1))
    fixed = float(np.dot(np.where((p > 0) & (p < 1), 0, p), size))
    ways = [[m >> k & 1 for k in range(len(at))] for m in range(1 << len(at))]
    p[at] = min(ways, key=lambda w: (abs(fixed + float(np.dot(w, size[at])) - want), w))
    while abs(off := want - float(np.dot(p, size))) > 0.5:
        # a step takes ``b`` and leaves ``a``; either may be no document, of size 0
        a, b = np.append(np.flatnonzero(p == 1), -1), np.append(np.flatnonzero(p == 0), -1)
        sa, sb = np.where(a < 0, 0, size[a]), np.where(b < 0, 0, size[b])
        order = np.argsort(sb, kind="stable")
        near = np.searchsorted(sb[order], sa + off)
        to = order[np.stack([np.maximum(near - 1, 0), np.minimum(near, len(b) - 1)], 1)]
        miss = np.abs(off - (sb[to] - sa[:, None]))
        i, j = divmod(int(miss.argmin()), 2)
        if miss[i, j] >= abs(off) - 0.5:
            break
        if a[i] >= 0:
            p[a[i]] = 0.0
        if b[to[i, j]] >= 0:
            p[b[to[i, j]]] = 1.0
    return p


def spread(p: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Marks up to ``n`` settled documents, half of them taken ones, evenly over the order of size."""
    marked = np.zeros(len(p), bool)
    for side in (np.flatnonzero(p == 0), np.flatnonzero(p == 1)):
        side = side[np.argsort(size[side], kind="stable")]
        marked[side[np.unique(np.linspace(0, len(side) - 1, min(n // 2, len(side))).astype(int))]] = True
    return marked


def _balanced(block: int, first: bool):
    def run(group: pa.Table) -> pa.Table:
        k1, k2, salt, size, p = (group.column(c).to_numpy() for c in ("k1", "k2", "salt", "size", "p"))
        blocks, own = group.column("blocks")[0].as_py(), group.column("block")[0].as_py()
        order = np.lexsort((salt, k2, k1))
        moved, spare = flight(p[order], size[order], int(k1[order[0]])), np.zeros(len(p), bool)
        if blocks == 1:
            moved = landing(moved, size[order], float(np.dot(p[order], size[order])))
        elif first and own * (share := max(2, block // blocks)) < block:
            spare[order] = spread(moved, size[order], share)
        out = np.empty(len(p))
        out[order] = moved
        group = group.set_column(group.schema.get_field_index("p"), "p", pa.array(out))
        return group.set_column(group.schema.get_field_index("spare"), "spare", pa.array(spare))

    return run


def _hashes(docs: DataFrame, seed: int, columns: tuple[str, ...]) -> tuple[Column, Column]:
    """Hashes of a row by ``columns``; nulls and empty texts differ by their place."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return hash128(F.lit(seed), *parts)


def salted(sizes: DataFrame, block: int) -> DataFrame:
    """``sizes``, as ``materialize`` has read them, with salt: a number by place for rows that repeat hashes often, else 0.

    Rows are dealt to blocks by hash and salt, so that equal rows spread over
    blocks like any others. Those that occur less than an eighth of a block
    keep to their hash, which no layout of files changes.
    """
    hot = sizes.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 8 > block).drop("n")
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return sizes.withColumn("salt", F.lit(0).cast("long"))
    placed = sizes.withColumn("salt", F.xxhash64(row_place()))
    met = placed.join(hot, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    return met.withColumn("salt", F.when(F.col("h1").isNotNull(), F.col("salt")).otherwise(0)).drop("h1", "h2")


def block_of(level: int) -> Column:
    return F.pmod(F.xxhash64("k2", "salt", F.lit(level)), F.col("blocks"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, seed: int = 17, identity: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, k1, k2 (hashes of the row), size, source_size, target, copies, taken.

    A source whose target is r times its size takes each of its documents
    floor(r) times, and once more with probability r - floor(r). The few long
    documents of a source are decided first, and what they leave of the target
    is the probability of the others. Those are decided by the cube method: in
    blocks of one source, probabilities move inside the null space of two
    constraints, words and documents, until at most two documents of a block
    are open. Open documents go on to the next level in fewer blocks, until
    one block of the source is left; levels are counted for each source by
    itself. There the last two or fewer are landed on the nearest word total,
    and what is missing is mended by exchanges among the block's documents and
    a spread of at most ``block`` documents that the first level has settled.
    A hot source is many blocks. Only hashes and sizes move; the order inside
    a block is that of the hashes, so reruns agree.

    Null and empty texts have size 0, are taken as 0 words and take no part in
    the balancing. A null source is a source of its own, the last. Repeated
    rows are documents of their own, and those that fill much of a block
    spread over all of them. Null ids are kept. The hashes are of id
    and text, or of the columns named in ``identity``; others are not read.
    ``block`` must be 8 or more, so that each level has fewer open documents.
    """
    if block < 8:
        raise ValueError("block must be 8 or more")
    k1, k2 = _hashes(docs, seed, identity or (id, text))
    sizes = materialize(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), k1.alias("k1"), k2.alias("k2"), word_count(F.col(text)).alias("size")), "sizes")
    sizes = salted(sizes, block)
    targets = source_targets(sizes, weights, most)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    copies = F.least(F.floor(ratio + _TINY), F.lit(most))
    targets = targets.withColumn("whole", copies.cast("long")).withColumn("part", F.when(ratio - copies > _TINY, ratio - copies).otherwise(0.0)).withColumnRenamed("source", "of")
    names = ["id", "source", "k1", "k2", "salt", "size", "source_size", "target", "whole", "p", "blocks", "spare"]

    def joined(to: DataFrame, part: Column) -> DataFrame:
        rows = sizes.join(to, F.col("source").eqNullSafe(F.col("of"))).withColumn("p", F.when(F.col("size") > 0, part).otherwise(0.0))
        long_ = (F.col("part") > 0) & (F.col("size") * F.col("n") > MEANS * F.col("source_size")) & (F.col("size") * SHARE > F.col("source_size"))
        return rows.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("spare", F.lit(False)).withColumn("long", long_).select(*names, "long")

    # fewer than SHARE rows a source
    longs = joined(targets, F.col("part")).filter("long").select(*names)
    longs = materialize(longs.groupBy("source").applyInArrow(_decided, longs.withColumn("rest", F.lit(0.0)).schema), "long")
    rests = longs.groupBy(F.col("source").alias("over")).agg(F.min("rest").alias("rest"))
    rows = joined(targets.join(rests, F.col("of").eqNullSafe(F.col("over")), "left").drop("over"), F.coalesce("rest", "part")).filter("not long").select(*names)
    open_ = F.col("p").between(_TINY, 1 - _TINY)
    most_rows = (targets.agg(F.max("n")).first()[0] or 0)
    settled, live, n, level = longs.drop("rest").unionByName(rows.filter(~open_)), rows.filter(open_), max(1, -(-most_rows // block)), 0
    while True:
        # what the first level has settled waits for its source's last block
        ready, waiting = live.filter(open_ | (F.col("blocks") == 1)), live.filter(~open_ & (F.col("blocks") > 1))
        dealt = ready.withColumn("block", block_of(level))
        moved = materialize(dealt.groupBy("source", "block").applyInArrow(_balanced(block, level == 0), dealt.schema).drop("block"), "flight")
        goes_on = (F.col("blocks") > 1) & (open_ | F.col("spare"))
        settled = settled.unionByName(moved.filter(~goes_on))
        if n == 1:
            break
        # at most two documents of a block are open
        live = moved.filter(goes_on).unionByName(waiting).withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        n, level = -(-2 * n // block), level + 1
    total = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return settled.select(F.col("id").alias(id), "k1", "k2", "size", "source_size", "target", total).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Rows that are equal in every column are one entry, which comes out as
    often as all of them together were taken.
    """
    columns = tuple(docs.columns)
    taken = mix(docs, id, text, source, seed=seed, identity=columns, **options)
    taken = materialize(taken.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).alias("__rows")), "taken")
    k1, k2 = _hashes(docs, seed, columns)
    hashed = docs.withColumn("__a", k1).withColumn("__b", k2)
    same = (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2"))
    out = hashed.join(taken.filter("__copies > 0 and __rows = 1"), same)
    repeated = taken.filter("__copies > 0 and __rows > 1")
    if not repeated.isEmpty():
        # equal rows are made one where they are read, so that one that fills a third of the table is counted, not moved
        once = hashed.join(repeated.select("__k1", "__k2"), same, "left_semi").groupBy("__a", "__b").agg(F.first(F.struct(*map(F.col, columns))).alias("__row"))
        out = out.unionByName(once.select("__row.*", "__a", "__b").join(repeated, same))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)
