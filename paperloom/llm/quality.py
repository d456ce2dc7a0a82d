"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is the hashed three-byte runs in it, and the tenth into which the share of
its repeated six-byte runs falls, log-scaled and weighted by rarity.
A truncated singular value decomposition of a bounded labelled sample gives the
latent space; the sample's vectors are broadcast. Every document's exact cosines
to all of them are computed in blocks, and its nearest neighbours vote with
their labels, weighted by similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm._common import chunks, may_train, texts_of, with_arrow_columns

BUCKETS = 4096
DIM = 48
#: Labelled rows that the model holds at most, about.
SAMPLE = 3000
NEIGHBOURS = 15
#: Power of the cosine in a vote.
SHARPNESS = 4
LEAST = 0.3


#: Steps of the share of repeated runs, and the count that stands for the step.
STEPS = 10
STEP_COUNT = 20_000


def counts_of(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often the three-byte runs of the text fall into each bucket, and after the buckets its step of repetition. No text: all zero."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(buckets + STEPS, np.int64)
    if not len(a):
        return out
    a = np.concatenate((a, np.zeros(max(0, 6 - len(a)), np.uint32)))
    runs = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
    out[:buckets] = np.bincount((runs >> np.uint32(33 - buckets.bit_length())).astype(np.int64), minlength=buckets)
    double = runs[:-3] * np.uint32(31) ^ runs[3:]
    again = 1 - len(np.unique(double)) / len(double)
    out[buckets + min(STEPS - 1, int(again * STEPS))] = STEP_COUNT
    return out


@dataclass
class QualityModel:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.rarity
        v = x @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of label 1 among the votes; where nothing votes, the sample's share."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        prior = float(self.labels.mean())
        counts = np.stack([counts_of(x, len(self.rarity) - STEPS) for x in texts])
        near = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        out = np.where(total > 0, (votes * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), prior)
        return np.clip(np.where(counts.sum(axis=1) > 0, out, prior), 0, 1)


def decompose(counts: np.ndarray, labels: np.ndarray, dim: int = DIM, seed: int = 3) -> QualityModel:
    """Randomised truncated singular value decomposition of the weighted counts."""
    n, buckets = counts.shape
    if not n:
        return QualityModel(np.ones(buckets, np.float32), np.zeros((buckets, dim), np.float32), np.zeros((0, dim), np.float32), labels)
    rarity = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x = np.log1p(counts.astype(np.float32)) * rarity
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    dim = min(dim, n, buckets)
    q = np.random.default_rng(seed).normal(size=(buckets, min(dim + 16, buckets))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = QualityModel(rarity, (q @ v.T)[:, :dim].astype(np.float32), np.zeros((0, dim), np.float32), labels.astype(np.float64))
    model.vectors = model.embed(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> QualityModel:
    """Learns from the texts and ``quality`` of labelled rows that may train; about ``sample`` of them, drawn by a hash of their ids."""
    known = labels.filter(may_train() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    n = known.count()
    drawn = known.filter(F.xxhash64("doc_id", F.lit("quality")).bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24) < sample / max(n, 1)).orderBy("doc_id").limit(2 * sample)
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([zlib.compress(counts_of(x, buckets).astype(np.uint32).tobytes(), 1) for x in texts_of(batch)], pa.binary())]

        return compute

    rows = with_arrow_columns(texts, [T.StructField("counts", T.BinaryType())], make).select("label", "counts").orderBy(F.xxhash64("counts"), "counts", "label").limit(2 * sample).collect()  # the same order, however the rows are dealt
    counts = np.zeros((len(rows), buckets + STEPS), np.uint32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return decompose(counts, np.array([r["label"] for r in rows], np.float64))


def classify(docs: DataFrame, model: QualityModel, least: float = LEAST) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``least``) of each whole text.

    A null or empty text gets the sample's share of label 1; a model without
    labels gives all 0.5. Rows repeat as they are; a column of ``docs`` with a
    new column's name goes; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch)
            scores = np.concatenate([held.score(texts[a:b]) for a, b in chunks(texts, 64, 1_000_000)] or [np.zeros(0)])
            return [pa.array(scores), pa.array((scores >= least).astype(np.int32))]

        return compute

    return with_arrow_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
