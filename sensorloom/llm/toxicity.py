"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_binary
from .hashing import gram_features, text_chunks, word_hashes


@dataclass(frozen=True)
class ToxicModel:
    """Sparse weights: positions and values, with the bias; without labels bias is None."""

    bits: int
    features: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float | None


def ftrl(examples: list, labels: list, size: int, bias: float, alpha: float, beta: float, l1: float, l2: float, epochs: int):
    """Weights (dense array, last one the bias) after FTRL-proximal passes over binary feature lists.

    Every coordinate has its own rate from its squared gradients n and a lazily applied
    L1 threshold on z; the bias starts at the prior and is not regularised.
    """
    import numpy as np

    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    b, bn = bias, 0.0
    for _ in range(epochs):
        for idx, y in zip(examples, labels):
            w = weights(idx)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
            bn += g * g
            b -= alpha * g / (1 + bn**0.5)
    return weights(np.arange(size)), b


def example_features(bodies: list[bytes], bits: int) -> list:
    """Sorted distinct features of each text."""
    import numpy as np

    out: list = []
    for a, b in text_chunks(bodies):
        f, o = gram_features(*word_hashes(bodies[a:b]), bits)
        key = np.unique((o << bits) + f)
        out += [k & ((1 << bits) - 1) for k in np.split(key, np.searchsorted(key, np.arange(1, b - a) << bits))]
    return out


def train_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 8000, shards: int = 1, bits: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 10,
) -> ToxicModel:
    """Fit on at most max_rows labelled documents, chosen by a hash of the id, one text for each id.

    The sample's bound is max_rows whatever the tables' size, so its ids are broadcast.
    Each shard of it is learned in its own task and the shards' weights are averaged; the
    driver gets non-zero weights only. A text reaches its shard as distinct features, so a
    task holds no texts. Rows without a label or id are left out; of several labels of an id
    the largest counts, of several texts that of the smallest hash.
    """
    picked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array(example_features(b.column(1).to_pylist(), bits), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), lists], names=["doc_id", "y", "h", "features"])

    seen = rows.select("doc_id", "body", "y", F.xxhash64("body").alias("h")).mapInArrow(features, "doc_id long, y int, h long, features array<long>")
    one = seen.groupBy("doc_id").agg(F.min(F.struct("h", "y", "features")).alias("e")).select("doc_id", "e.y", "e.features")
    size = 1 << bits

    def learn(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        examples, y = pdf["features"].tolist(), pdf["y"].to_numpy(dtype=float)
        order = np.random.default_rng(0).permutation(len(y))
        prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        w, bias = ftrl([examples[i] for i in order], [y[i] for i in order], size, prior, alpha, beta, l1, l2, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.r_[at, -1], "weight": np.r_[w[at], bias], "rows": len(y)})

    learned = one.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(learn, "feature long, weight double, rows long")
    mixed = learned.groupBy("feature").agg(F.sum(F.col("weight") * F.col("rows")).alias("weight"), F.sum("rows").alias("rows")).orderBy("feature").collect()
    if not mixed:
        return ToxicModel(bits, (), (), None)
    total = mixed[0]["rows"]  # the bias (feature -1) is in every shard
    return ToxicModel(bits, tuple(r["feature"] for r in mixed[1:]), tuple(r["weight"] / total for r in mixed[1:]), mixed[0]["weight"] / total)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (probability of label 1) and predicted (score >= threshold).

    A feature counts once per document, however often it stands in its whole text. Null,
    empty and wordless texts get the bias's score; a model without labels scores 0. Repeated
    rows are scored each. An empty table gives no rows. Other columns are not read. Narrow:
    no shuffle; the weights sent along are the non-zero ones of a table of fixed size.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((model.bits, model.features, model.weights, model.bias))  # plain values: executors need not know the class

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits, features, weights, bias = sent.value
        size = 1 << bits
        table = np.zeros(size)
        table[np.array(features, dtype=np.int64)] = weights
        for b in batches:
            bodies = b.column(1).to_pylist()
            total = np.full(len(bodies), bias if bias is not None else -np.inf)
            for lo, hi in text_chunks(bodies):
                f, o = gram_features(*word_hashes(bodies[lo:hi]), bits)
                live = np.flatnonzero(table[f])
                key = np.unique(o[live] * size + f[live])
                total[lo:hi] += np.bincount(key // size, weights=table[key & (size - 1)], minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            p[np.isneginf(total)] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_binary(docs, id_col, text_col, score, "doc_id long, score double, predicted int")


def held_out(id_col: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves the remainder `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
