"""Conversation turns, long-term memory, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions import similarity
from ..scratch import materialize
from .relational import last_n

#: Entries of a slice and asks of a block, about.
SLICE, BLOCK = 4096, 1024


def recent(turns: DataFrame, n: int = DEFAULT.recent_turns) -> DataFrame:
    """The last ``n`` turns of each conversation and user."""
    return last_n(turns, ["conv_id", "user_id"], [F.desc("id")], n)


def long_term(memory: DataFrame, now: Column, k: int = DEFAULT.memory_top_k, vector: Column | None = None) -> DataFrame:
    """Per user the ``k`` live entries nearest to ``vector``, or the newest without one."""
    live = memory.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if vector is None:
        return last_n(live, ["user_id"], [F.desc("updated_at"), F.desc("id")], k)
    near = live.filter("embedding is not null").withColumn("dist", F.round(1 - similarity.cosine(F.col("embedding"), vector), 6))
    return last_n(near.filter("dist is not null"), ["user_id"], [F.col("dist"), F.col("id")], k)


def recalled(memory: DataFrame, asks: DataFrame, now: Column, k: int = DEFAULT.memory_top_k) -> DataFrame:
    """(ask_id, user_id, id, dist, rn): for each ask its user's ``k`` nearest live entries, or the newest if it has no vector.

    asks: ask_id, user_id, vector (null: newest entries, dist null); ask_id is
    unique. Entries that expired go, and for an ask with a vector those that
    have none or none of any length. Ties go by id. A user without live
    entries gives no rows; rows with a null user meet none.

    Entries meet asks by user, so a batch of asks reads the memory once. A
    user's asks are dealt to blocks and the entries to slices by hash, by how
    many there are; a block meets a slice in one product of matrices, and
    only the ``k`` best of each ask leave it. So a user who holds a third of
    all entries is not one task's, and no row a pair is made, though each
    entry is compared with each ask of its user.
    """
    live = memory.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("user_id", "id", "updated_at", "embedding")
    live, asks = materialize(live.filter("user_id is not null"), "live"), asks.select("ask_id", "user_id", "vector")
    parts = lambda df, size, name: df.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    sizes = parts(live, SLICE, "slices").join(parts(asks, BLOCK, "blocks"), "user_id")
    dealt = lambda id, n: F.pmod(F.xxhash64(id), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    entries = live.join(sizes, "user_id").select(*live.columns, dealt("id", "slices").alias("slice"), every("blocks").alias("block"))
    asked = asks.join(sizes, "user_id").select(*asks.columns, dealt("ask_id", "blocks").alias("block"), every("slices").alias("slice"))
    kinds = {"ask_id": asks.schema["ask_id"].dataType, **{c: live.schema[c].dataType for c in ("user_id", "id")}, "dist": T.DoubleType(), "updated_at": live.schema["updated_at"].dataType}
    out = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    met = entries.groupBy("user_id", "slice", "block").cogroup(asked.groupBy("user_id", "slice", "block")).applyInArrow(lambda own, some: _nearest(own, some, k), out)
    newest = F.when(F.col("dist").isNull(), F.col("updated_at"))
    best = met.withColumn("rn", F.row_number().over(Window.partitionBy("ask_id").orderBy("dist", newest.desc_nulls_last(), F.when(F.col("dist").isNull(), -F.col("id")).otherwise(F.col("id"))))).filter(F.col("rn") <= k)
    return best.select("ask_id", "user_id", "id", "dist", "rn")


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, matrix, lengths) of the vectors by dimension, in double precision; those of no length or with a null go."""
    flat = column.combine_chunks()
    dims, out = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False), {}
    for d in np.unique(dims[dims > 0]).tolist():
        at = np.flatnonzero(dims == d)
        values = flat.take(pa.array(at)).flatten()
        whole = ~np.isin(np.arange(len(at)), np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) // d)
        m = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.sqrt((m * m).sum(1))
        whole &= norm != 0
        out[d] = at[whole], m[whole], norm[whole]
    return out


def _nearest(entries: pa.Table, asks: pa.Table, k: int, step: int = 64) -> pa.Table:
    """The ``k`` nearest entries of a slice for each ask of a block, or the newest for an ask without a vector."""
    ids, who, which, dist = entries["id"].to_numpy(), [], [], []
    newest = pc.sort_indices(entries, [("updated_at", "descending"), ("id", "descending")]).to_numpy()[:k]
    recent = np.flatnonzero(asks["vector"].is_null().to_numpy())
    who.append(np.repeat(recent, len(newest)))
    which.append(np.tile(newest, len(recent)))
    dist.append(np.full(len(which[0]), np.nan))
    own, wanted = _vectors(entries["embedding"]), _vectors(asks["vector"])
    for d in own.keys() & wanted.keys():
        (at, m, norm), (of, q, length) = own[d], wanted[d]
        for x in range(0, len(of) if len(at) else 0, step):
            far = np.round(1 - (q[x : x + step] @ m.T) / (length[x : x + step, None] * norm), 6) + 0.0
            worst = np.partition(far, min(k, len(at)) - 1, 1)[:, min(k, len(at)) - 1]
            for i, row in enumerate(far):
                near = np.flatnonzero(~(row > worst[i]))
                near = near[np.lexsort((ids[at[near]], row[near]))[:k]]
                who.append(np.full(len(near), of[x + i]))
                which.append(at[near])
                dist.append(row[near])
    who, which = pa.array(np.concatenate(who).astype(np.int64)), np.concatenate(which).astype(np.int64)
    # a distance may be no number; only newest entries have none
    none = np.arange(len(which)) < len(recent) * len(newest)
    rows = entries.select(["user_id", "id", "updated_at"]).take(pa.array(which))
    return pa.table({"ask_id": asks["ask_id"].take(who), "user_id": rows["user_id"], "id": rows["id"], "dist": pa.array(np.concatenate(dist), pa.float64(), mask=none), "updated_at": rows["updated_at"]})


def counters(offered: DataFrame) -> DataFrame:
    """Per conversation: turns offered (what its counter adds) and stored (blank ones are not), which may differ."""
    return offered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("offered"), F.count_if(F.length(F.btrim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n"))) > 0).alias("stored"))


def pending(turns: DataFrame, offsets: DataFrame, every: int = DEFAULT.summarize_every) -> DataFrame:
    """Conversations with ``every`` turns or more beyond their summary offset: (conv_id, user_id, n, upto)."""
    waiting = turns.join(offsets, "conv_id", "left").filter(F.col("id") > F.coalesce("summarized_upto", F.lit(0)))
    return waiting.groupBy("conv_id", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("upto")).filter(F.col("n") >= every)


def advance(offsets: DataFrame, done: DataFrame) -> DataFrame:
    """Offsets after summaries of ``done`` (conv_id, upto), whether or not they gave facts."""
    return offsets.select("conv_id", "summarized_upto").unionByName(done.select("conv_id", F.col("upto").alias("summarized_upto"))).groupBy("conv_id").agg(F.max("summarized_upto").alias("summarized_upto"))


def fact_lines(text: Column, most: int = 7) -> Column:
    """Lines of a summary without bullets and numbers; blank ones go; ``most`` at most."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""), r"^\s+|\s+$", ""))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, most)


def forget(user_ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the users' rows."""
    return [t.join(user_ids.select("user_id"), "user_id", "left_anti") for t in tables]


def day_thread(user: Column, ts: Column) -> Column:
    """One thread a user and UTC day."""
    return F.concat_ws("-", user, F.date_format(ts, "yyyyMMdd"))


def previous_user_turn(turns: DataFrame) -> DataFrame:
    """Turns with the text of the latest user turn before them in the conversation."""
    w = Window.partitionBy("conv_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def retrieval_query(question: Column, previous: Column, most: int = 600) -> Column:
    return F.right(F.concat_ws("\n", previous, question), F.lit(most))


def history_problems(turns: DataFrame, most: int = 100, longest: int = 32_000, total: int = 200_000) -> DataFrame:
    """(conv_id, problem) of each history: too many messages, one too long, too long together, or not ending with the user.

    System messages are not counted; null where all is well.
    """
    own = turns.filter("role <> 'system'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content")).alias("total"), F.max_by("role", "id").alias("last"))
    why = F.when(F.col("n") > most, "messages").when(F.col("longest") > longest, "length").when(F.col("total") > total, "total").when(F.col("last") != "user", "last")
    return own.select("conv_id", why.alias("problem"))


def read_through(chunks: DataFrame, budget: int, least: int) -> DataFrame:
    """(chunk_id, file_id, body, partial): chunks of each file in order of (seq, chunk_id) while their characters fit ``budget``.

    The first that does not fit is cut if more than ``least`` characters are
    left. A chunk has a character or more (empty ones go), so the budget also
    bounds how many chunks of a file can fit: tasks keep that many of each
    file, lengths only, and texts are joined to the few that are shown.
    """
    sizes = chunks.select("file_id", "seq", "chunk_id", F.length("chunk_text").alias("n")).filter("n > 0")
    order = Window.partitionBy("file_id").orderBy("seq", "chunk_id")
    near = sizes.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= budget + 1)
    placed = near.withColumn("used", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("left", F.lit(budget) - F.col("used") + F.col("n"))
    shown = placed.filter((F.col("used") <= budget) | (F.col("left") > least)).select("chunk_id", "left", (F.col("used") > budget).alias("partial"))
    cut = F.concat(F.substr("chunk_text", F.lit(1), F.col("left").cast("int")), F.lit("…"))
    return shown.join(chunks.select("chunk_id", "file_id", "chunk_text"), "chunk_id").select("chunk_id", "file_id", F.when(F.col("partial"), cut).otherwise(F.col("chunk_text")).alias("body"), "partial")


def memory_block(entries: DataFrame, group: str = "user_id") -> DataFrame:
    """(group, block): one line for each entry in order of id; blank entries go.

    Entries of a group are gathered, so they must be few, as ``recent`` and
    ``long_term`` give them.
    """
    line = F.concat(F.lit("- ["), F.coalesce("kind", F.lit("fact")), F.lit("] "), F.btrim("content"))
    rows = entries.filter(F.length(F.btrim(F.coalesce("content", F.lit("")))) > 0).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("r"))
    return rows.select(group, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("block"))
