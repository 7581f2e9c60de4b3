"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's features are its hashed byte trigrams, weighted by log counts and inverse
document frequency, and the shares of repeated words, capitals, digits and
punctuation.  A truncated singular value decomposition of a bounded sample
of labelled texts gives the latent space; the sample's vectors, at most
``2 * SAMPLE_PER_LABEL`` of ``DIMENSIONS`` numbers, are broadcast.  Every document
is compared with all of them by blocked cosine products, and its ``NEIGHBOURS`` nearest
vote for their label with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import few_by_hash, modest_batches, read

FEATURES = 4096
#: After the trigrams: words, words equal to the one before, bytes, and bytes of three kinds.
STYLE = 6
STYLE_WEIGHT = 1.5
DIMENSIONS = 48
SAMPLE_PER_LABEL = 1000
NEIGHBOURS = 25
SHARPNESS = 4
THRESHOLD = 0.3
#: Documents whose counts are held together, and bytes hashed together.
BLOCK = 256
HELD_BYTES = 1 << 20


_BYTE = np.arange(256)
_KINDS = np.stack([(_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57),
                   (_BYTE > 32) & (_BYTE < 127) & ~((_BYTE >= 48) & (_BYTE <= 57))
                   & ~((_BYTE >= 65) & (_BYTE <= 90)) & ~((_BYTE >= 97) & (_BYTE <= 122))]).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES + STYLE) counts; no trigrams for under three bytes."""
    out = np.zeros((len(texts), FEATURES + STYLE), np.float32)
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - 2, 0), HELD_BYTES):
            b = np.frombuffer(data[at:at + HELD_BYTES + 2], np.uint8).astype(np.uint32)
            key = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)
            out[i, :FEATURES] += np.bincount(key >> np.uint32(20), minlength=FEATURES)
        words = data.lower().split()
        out[i, FEATURES:FEATURES + 3] = len(words), sum(map(bytes.__eq__, words, words[1:])), len(data)
        out[i, FEATURES + 3:] = _KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return out


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigrams by log count and idf, of length one, then the shares."""
    x = np.log1p(raw[:, :FEATURES]) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    n_words, same, n_bytes = raw[:, FEATURES:FEATURES + 3].T
    shares = np.concatenate([(same / np.maximum(n_words, 1))[:, None],
                             raw[:, FEATURES + 3:] / np.maximum(n_bytes, 1)[:, None]], axis=1)
    return np.concatenate([x, STYLE_WEIGHT * np.sqrt(shares)], axis=1)


@dataclass
class Model:
    idf: np.ndarray  # (FEATURES,)
    basis: np.ndarray  # (FEATURES + 4, DIMENSIONS)
    vectors: np.ndarray  # (labelled, DIMENSIONS), length one
    labels: np.ndarray
    prior: float

    def latent(self, raw: np.ndarray) -> np.ndarray:
        v = weighted(raw, self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' similarity; the prior without a feature."""
        out = np.full(len(raw), self.prior)
        known = raw[:, :FEATURES].any(axis=1)
        if known.any() and len(self.labels):
            near = self.latent(raw[known]) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[at]).sum(axis=1)
            out[known] = np.where(total > 0, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def fit(raw: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space and labelled vectors from the sample's counts."""
    if not len(labels):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES + STYLE - 2, 1), np.float32),
                     np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    idf = np.log((1 + len(raw)) / (1 + (raw[:, :FEATURES] > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(raw, idf)
    # right singular vectors from the Gram matrix of the (bounded) sample
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = np.argsort(values)[::-1][:DIMENSIONS]
    top = top[values[top] > 1e-8]
    basis = (x.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), labels.astype(np.float64),
                  float(labels.mean()))
    model.vectors = model.latent(raw).astype(np.float32)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            raw = counts(part.column(3).to_pylist())
            yield pa.record_batch([*part.columns[:3], pa.array([r.tobytes() for r in raw], pa.binary())],
                                  names=["label", "doc_id", "h", "raw"])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = SAMPLE_PER_LABEL):
    """Counts and labels of at most ``per_label`` documents of each label, chosen by hash of the id.

    Where doc_ids repeat in ``docs``, the first ``4 * per_label`` rows by doc_id and hash of the text.
    """
    known = (labels.where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = few_by_hash(known.withColumn("h", F.xxhash64("doc_id")), "label", "h", per_label, 2).select("doc_id", "label")
    rows = (docs.join(F.broadcast(chosen), "doc_id")
            .select(F.col("label").cast("int"), F.col("doc_id").cast("string"), F.xxhash64("text").alias("h"), "text")
            .mapInArrow(_features, "label int, doc_id string, h long, raw binary")
            .orderBy("doc_id", "h", "raw").limit(4 * per_label).select("label", "raw").toPandas())
    rows = rows.sort_values(["label", "raw"])
    raw = np.stack([np.frombuffer(r, np.float32) for r in rows["raw"]]) if len(rows) else np.zeros((0, FEATURES + STYLE), np.float32)
    return raw, rows["label"].to_numpy()


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and score (0 to 1); only ``text`` is an input.

    A text under three bytes, and a null one, gets the share of label 1 in the sample.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                raw = np.zeros((BLOCK, FEATURES + STYLE), np.float32)  # always one shape: the same sums anywhere
                raw[:part.num_rows] = counts(part.column(part.num_columns - 1).to_pylist())
                s = np.round(m.score(raw)[:part.num_rows], 6)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s)],
                                                 names=[*part.schema.names[:-1], "score"])

    chosen = docs.select(*keep, "text")
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(*sample(docs, labels, fold(F.col("doc_id")) != 0))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
