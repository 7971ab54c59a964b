"""An inverted file of vectors: k-means cells as partitions, and searches that read only the cells they need."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Options
from ..scratch import materialize
from .retrieval import KEPT, Best, bounded, rank

#: Vectors that the centres are fitted on at most, cells, rounds of fitting, cells that a query looks into first.
SAMPLE, CELLS, ROUNDS, PROBES = 16_384, 64, 12, 8
#: Vectors that a task compares at once.
BLOCK = 2048
#: Rounded distances may hide this much.
_SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """rows: (chunk_id, embedding, cell) with a partition for each cell; centres of length one; radii: the widest angle of a cell's rows to its centre."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _units(vectors: pd.Series | list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of those given have a length."""
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(1))
    return m[norm > 0] / norm[norm > 0][:, None], norm > 0


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def fit_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: centres of length one. A cell that loses all its vectors starts again at the one farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(1))
        far = np.argsort(near.max(1))
        for k, cell in enumerate(np.flatnonzero(norm < 1e-12).tolist()):
            sums[cell], norm[cell] = sample[far[k % len(far)]], 1.0
        centres = sums / norm[:, None]
    return centres


def build(corpus: DataFrame, path: str, dim: int, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Deals every vector of ``dim`` numbers to the cell of its nearest centre, written to ``path`` with a partition for each cell.

    Centres are fitted on ``sample`` vectors at most, those of the smallest
    hash of their id; every vector is indexed. Rows without a vector, with one
    of another dimension or of no length are left out, as the exact search
    leaves them out. A cell with too many rows for a task is written by several.
    """
    spark = corpus.sparkSession
    own = corpus.filter((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0)).select("chunk_id", "embedding")
    first = own.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(sample).collect()
    centres = fit_centres(_units([r.embedding for r in first])[0], cells) if first else np.zeros((0, dim))
    share = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), BLOCK):
                part = pdf.iloc[k : k + BLOCK]
                near = _units(part["embedding"])[0] @ share.value.T
                cell = near.argmax(1)
                yield part.assign(angle=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)), cell=cell.astype(np.int32))

    dealt = own.mapInPandas(deal, "chunk_id long, embedding array<float>, angle double, cell int") if first else spark.createDataFrame([], "chunk_id long, embedding array<float>, angle double, cell int")
    dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    rows = spark.read.schema("chunk_id long, embedding array<float>, angle double, cell int").parquet(path)
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r.cell], sizes[r.cell] = r.radius, r.n
    return VectorIndex(rows.drop("angle"), centres, radii, sizes)


def _searched(index: VectorIndex, qids: np.ndarray, units: np.ndarray, wanted: np.ndarray, limit: int) -> DataFrame:
    """(qid, chunk_id, dist) of each task's best ``limit`` rows of each query in the cells that it wants; other cells' files are not read."""
    cells = np.flatnonzero(wanted.any(0)).tolist()
    share = index.rows.sparkSession.sparkContext.broadcast((qids, units, wanted))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, units, wanted = share.value
        best = Best(len(qids), limit)
        for pdf in batches:
            for cell, own in pdf.groupby("cell"):
                asked = np.flatnonzero(wanted[:, cell])
                for k in range(0, len(own), BLOCK):
                    part = own.iloc[k : k + BLOCK]
                    m, _ = _units(part["embedding"])
                    values = np.full((len(part), len(qids)), np.inf)
                    values[:, asked] = (np.round(1 - units[asked] @ m.T, 6) + 0.0).T
                    best.add_all(values, part["chunk_id"].to_numpy())
        yield best.rows(qids)

    return index.rows.filter(F.col("cell").isin(cells)).mapInPandas(near, KEPT).select("qid", "chunk_id", F.col("value").alias("dist"))


def search(queries: DataFrame, index: VectorIndex, options: Options = DEFAULT, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(qid, chunk_id, dist, rn) as ``vector_axis`` gives them, from the cells nearest to each query.

    First the ``probes`` cells whose centres are nearest are read. With
    ``exact``, so is every other cell that could hold a nearer row than the
    last one found: none lies nearer than the angle to the centre less the
    cell's radius. Without, the answer is approximate. Queries without a
    vector, with one of no length or of another dimension have no rows.
    """
    dim, limit = index.centres.shape[1], options.axis_limit
    rows = bounded(queries.filter(F.size("qvec") == dim).select("qid", "qvec"), options).collect()
    if not rows or not len(index.centres):
        return rank(queries.sparkSession.createDataFrame([], "qid long, chunk_id long, dist double"), F.col("dist"), F.col("chunk_id"), limit=limit)
    units, has = _units([r.qvec for r in rows])
    qids = np.array([r.qid for r in rows], np.int64)[has]
    angles = _angles(units, index.centres)
    wanted = np.zeros(angles.shape, bool)
    np.put_along_axis(wanted, np.argsort(angles, 1)[:, :probes], True, 1)
    wanted &= index.sizes > 0
    order = (F.col("dist"), F.col("chunk_id"))
    found = rank(_searched(index, qids, units, wanted, limit), *order, limit=limit)
    if not exact:
        return found
    found = materialize(found, "probed").drop("rn")
    last = {r.qid: r.d for r in found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("d")).filter(F.col("n") == limit).collect()}
    reach = np.arccos(np.clip(1 - np.array([last.get(q, 2.0) for q in qids.tolist()]) - _SLACK, -1, 1))
    more = ~wanted & (angles - index.radii <= reach[:, None] + _SLACK) & (index.sizes > 0)
    both = found.unionByName(_searched(index, qids, units, more, limit)) if more.any() else found
    return rank(both, *order, limit=limit)
