"""Quality scores by nearest-neighbour voting in a latent space.

A text's profile is how often each triple of character kinds (small, capital, digit, space, each sign)
occurs in it, how long its words are and how often words repeat at short distance. Profiles of a bounded
sample of labelled rows (SAMPLE_ROWS) are weighted by inverse document frequency and decomposed; the
labelled vectors in the latent space are broadcast. Every document is projected, its exact cosines with
all labelled vectors are computed block by block, and the nearest NEIGHBOURS vote with weights that rise
with the cosine.

Defined results: null and empty texts have an empty profile and get the share of label 1 in the sample;
without labelled rows every score is 0.5; repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel, labelled

SAMPLE_ROWS = 3000
TRIPLES = 1920
LENGTHS = 32
LAGS = 4
WIDTH = TRIPLES + LENGTHS + LAGS
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 16


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    kind[65:91] = 1
    kind[48:58] = 2
    for i in range(128):
        if not chr(i).isalnum():
            kind[i] = 5 + i % 59
    kind[[32, 9, 11, 12, 13]] = 3
    kind[10] = 4
    return kind


KIND = _kinds()


def profiles(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of square-rooted shares for each text; the parts of a row are scaled alike."""
    words = kernel.find_words(texts)
    n = len(words.at) - 1
    data, offsets = words.data, words.offsets
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) > 2:
        kind = KIND[data]
        triple = (kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:]
        slot = (triple * 2654435761 >> 7) % TRIPLES
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        out[:, :TRIPLES] = np.bincount(owner[:-2][inside] * TRIPLES + slot[inside], minlength=n * TRIPLES).reshape(n, TRIPLES)
    owner = words.owner()
    size = np.minimum(words.ends - words.starts, LENGTHS) - 1
    out[:, TRIPLES : TRIPLES + LENGTHS] = np.bincount(owner * LENGTHS + size, minlength=n * LENGTHS).reshape(n, LENGTHS)
    hashes = words.hashes()
    for lag in range(1, LAGS + 1):
        if len(hashes) > lag:
            same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
            out[:, TRIPLES + LENGTHS + lag - 1] = np.bincount(owner[lag:][same], minlength=n)
    for part in (slice(0, TRIPLES), slice(TRIPLES, TRIPLES + LENGTHS)):
        out[:, part] /= np.maximum(out[:, part].sum(1, keepdims=True), 1)
    out[:, TRIPLES + LENGTHS :] /= np.maximum(words.counts, 1)[:, None]
    return np.sqrt(out)


class Model:
    """Weights, projection and the labelled vectors of the sample."""

    def __init__(self, rows: np.ndarray, y: np.ndarray):
        self.base = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        seen = (rows > 0).sum(0)
        self.weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        x = rows * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if len(x) else (None, np.zeros((WIDTH, 1)))
        self.axes = vectors[:, ::-1][:, :RANK].astype(np.float32)
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(rows), 0.5)
        z = self._unit((rows * self.weight) @ self.axes)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.y))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        vote = (weight * self.y[near]).sum(1) / np.maximum(total, 1e-30)
        return np.where((total > 1e-12) & (rows.any(1)), vote, self.base)


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> Model:
    chosen = labelled.sample(docs, labels, label, rows, keep)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in profiles(part.column("text"))], pa.binary())], ["doc_id", "y", "profile"]
                )

    found = chosen.mapInArrow(profile, "doc_id bigint, y double, profile binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.frombuffer(b"".join(found.column("profile").to_pylist()), np.float32).reshape(-1, WIDTH)
    return Model(x, found.column("y").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.score(profiles(part.column("text"))), pa.float64())], ["doc_id", "score"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(vote, "doc_id bigint, score double")
