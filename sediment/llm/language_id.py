"""Operator 9: language by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, in_share, materialize

#: Buckets of hashed n-grams; about so many labelled texts are fitted for each language; languages at most (a model has 64 KB
#: for each, on the driver and in each worker); centroids for each.
BUCKETS, SAMPLE, LANGUAGES, CENTROIDS = 4096, 400, 512, 4
#: A text is rejected when its cosine distance to its centroid is this many times the largest of the centroid's own
#: sample, and not below the least nor above the most that a reach may be.
MARGIN, LEAST_REACH, MOST_REACH = 1.5, 0.85, 0.97
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the n-grams of two and three bytes of the lower-case text, letters and blanks only, by hashed bucket."""
    b = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(buckets, np.float32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for code in (b[:-1] << np.uint32(8) | b[1:], b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:] | np.uint32(1 << 24)):
        out += np.bincount((code * np.uint32(2654435761)) >> shift, minlength=buckets)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Inverse document frequencies, unit centroids, their languages and the distance beyond which each rejects."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], reach: np.ndarray) -> None:
        self.idf, self.centroids, self.langs, self.reach = idf, centroids, langs, reach

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.sqrt(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; a text without letters is rejected as ``und``."""
        live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        for k in range(0, len(live), 128) if self.langs else ():
            part = live[k : k + 128]
            cos = self.weigh(np.stack([ngram_counts(texts[i]) for i in part])) @ self.centroids.T
            best = cos.argmax(1)
            for i, j, c in zip(part, best, cos[np.arange(len(part)), best], strict=True):
                out[i] = (self.langs[j], float(min(max(c, 0.0), 1.0)), bool(1 - c > self.reach[j]))
        return out


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest points; no randomness."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, (x @ c.T).argmax(1)


def _packed(counts: np.ndarray) -> bytes:
    """The buckets that are not empty and their counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n, out = len(data) // 6, np.zeros(BUCKETS, np.float32)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return out


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES, k: int = CENTROIDS, margin: float = MARGIN) -> Model:
    """Fits on about ``sample`` texts of each label.

    The different texts of each label are counted, which sets for each a bound
    on the hash of the text, so that a label of few texts that are repeated
    often keeps all of them. Texts under the bound are made one for each
    label, in tasks first, and counted into n-gram vectors. One
    sum gives the inverse document frequencies, and one task a label finds
    its centroids; only these, 64 KB a label, reach the driver. More than
    ``languages`` labels are an error. Rows whose text or label is null, or
    whose text has no letter, are not used; a text that is repeated under one
    label is used once. ``id`` is not read.
    """
    spark = labelled.sparkSession
    bound_arrow(spark)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    labels = rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t"), 0.02).alias("n")).limit(languages + 1).collect()
    if len(labels) > languages:
        raise ValueError(f"more than {languages} labels; fit with a larger ``languages``")
    if not labels:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    shares = spark.createDataFrame([(r["l"], min(1.0, 1.2 * sample / r["n"])) for r in labels], "of string, share double")
    # one row a label, at most ``languages``
    picked = rows.join(F.broadcast(shares), F.col("l") == F.col("of")).filter(in_share(F.col("share"), F.col("t"))).select("l", "t").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["t"].map(lambda t: _LETTER.search(t) is not None)]
            yield pd.DataFrame({"l": pdf["l"], "v": [_packed(ngram_counts(t)) for t in pdf["t"]]})

    vectors = materialize(picked.mapInPandas(count, "l string, v binary").distinct(), "grams")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for v in pdf["v"]:
                df[np.frombuffer(v, "<u2", len(v) // 6)] += 1
            n += len(pdf)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS + 1), "n": np.append(df, n)})

    sums = vectors.mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    df[[r["bucket"] for r in sums]] = [r["n"] for r in sums]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(np.sqrt(np.stack([_unpacked(v) for v in sorted(pdf["v"])])) * idf)
        c, own = _cluster(unit, k)
        far = [float((1 - unit[own == j] @ c[j]).max()) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"l": key[0], "c": [x.astype("<f4").tobytes() for x in c], "reach": [min(max(margin * x, LEAST_REACH), MOST_REACH) for x in far]})

    # about ``sample`` vectors a group
    found = sorted(vectors.groupBy("l").applyInPandas(centroids, "l string, c binary, reach double").collect(), key=lambda r: (r["l"], bytes(r["c"])))
    return Model(idf, np.array([np.frombuffer(r["c"], "<f4") for r in found]).reshape(-1, BUCKETS), [r["l"] for r in found], np.array([r["reach"] for r in found]))


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    Every text is read whole; lang_pred is a learned label wherever the text
    has a letter, else ``und``. ``rejected`` marks texts that lie farther from
    their nearest centroid than that centroid reaches, and those without
    letters. Ties go to the first centroid by label. Null and empty texts are
    ``und`` with score 0; repeated rows repeat their result. Columns of
    ``docs`` stay, but for any with the three new names. Nothing is shuffled.
    """
    bound_arrow(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sizes at the top of this module

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(share.value.predict(list(batch)), columns=["lang_pred", "score", "rejected"])

    # marked so that the optimiser does not run it once for a filter and again for its columns
    of = of.asNondeterministic()
    names = ("lang_pred", "score", "rejected")
    out = docs.select(*[c for c in docs.columns if c not in names], of(F.col(text)).alias("__of"))
    return out.select(*[F.col(c) for c in out.columns if c != "__of"], *[F.col(f"__of.{c}").alias(c) for c in names])
