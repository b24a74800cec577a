"""Counting fingerprints of a whole corpus through compact shuffles.

Rows are dealt into chunks by ranges of doc_id. Each task sends, per hash range, the sorted distinct fingerprints
of its chunks as compressed differences; one reducer per hash range merges them and answers each chunk with the
fingerprints that matter to it. That moves five to seven bytes a window in place of a row.
Both the number of chunks and the number of hash ranges follow the size of the input, so no group grows
with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel

CHUNK_BYTES = 24 << 20
BUCKET_BYTES = 8 << 20
LOWEST = -(1 << 63)
FRAGMENT = "bucket int, chunk int, blob binary"


def encode(values: np.ndarray, tags: np.ndarray | None = None, chunks: np.ndarray | None = None) -> bytes:
    """Sorted values with one byte of tag each, and with ``chunks`` the number of each value's chunk, in as few bytes as it takes."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = step.view(np.uint8).reshape(-1, 8).T.tobytes()
    tail = (np.zeros(len(values), np.uint8) if tags is None else tags.astype(np.uint8)).tobytes()
    wide = (int(chunks.max()).bit_length() + 7) // 8 if chunks is not None and len(chunks) else 0
    owners = chunks.astype("<u4").view(np.uint8).reshape(-1, 4).T[:wide].tobytes() if wide else b""
    return zstandard.ZstdCompressor(level=1).compress(bytes([wide]) + planes + tail + owners)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, tags, chunks), chunks 0 where none were given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    wide, raw = int(raw[0]), raw[1:]
    n = len(raw) // (9 + wide)
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1)
    chunks = np.zeros((4, n), np.uint8)
    chunks[:wide] = raw[9 * n :].reshape(wide, n)
    return np.cumsum(step, dtype=np.uint64), raw[8 * n : 9 * n], np.ascontiguousarray(chunks.T).view("<u4").reshape(-1).astype(np.int32)


def decode_all(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All values of a chunk's answers, sorted, with their tags."""
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    blobs = table.column("blob")
    parts = [decode(blobs[int(i)].as_py()) for i in order]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, at which place) for each wanted value."""
    if not len(sorted_values):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.searchsorted(sorted_values, wanted)
    place[place == len(sorted_values)] = 0
    return sorted_values[place] == wanted, place


class Ranges:
    """Bounds of the doc_id ranges and the number of hash ranges for one input."""

    def __init__(self, docs: DataFrame, bytes_per_value: float, value_bytes: float, chunk_bytes: int = CHUNK_BYTES):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(tasks, math.ceil(total / chunk_bytes))
        at = [(i + 1) / chunks for i in range(chunks - 1)]
        found = (
            docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in at]), F.lit(max(10_000, 20 * chunks))).alias("b")).first()[0]
            if at else None
        )
        self.bounds = np.unique(np.array(found or [], dtype=np.int64))
        self.buckets = max(tasks, math.ceil(total / value_bytes * bytes_per_value / BUCKET_BYTES))

    def chunk_of(self, ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """A null id comes before all others."""
        return np.searchsorted(self.bounds, ids.cast(pa.int64()).fill_null(LOWEST).to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array)
                               else ids.combine_chunks().cast(pa.int64()).fill_null(LOWEST).to_numpy(), "left").astype(np.int32)

    def chunk(self, doc_id: Column) -> Column:
        ranges = self

        @F.arrow_udf("int")
        def of(ids: pa.Array) -> pa.Array:
            return pa.array(ranges.chunk_of(ids))

        return of(doc_id)


def fragments(chunks: np.ndarray, values: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Per hash range one row: the distinct values of each chunk, with how often each occurs (255 at most) as the tag.

    The row names the smallest of its chunks, the blob how far each value's chunk is from that. A row per chunk and hash range
    would hold single values where the rows of a task come from all chunks: their number grew with chunks times ranges.
    A value's range is told by its leading bits; ``bits`` is how many bits a value has.
    """
    if not len(values):
        return
    order = np.lexsort((chunks, values))
    values, chunks = values[order], chunks[order].astype(np.int64)
    heads = np.flatnonzero(first_of_pair(values, chunks))
    n = np.minimum(np.diff(heads, append=len(values)), 255)
    own, chunks = values[heads], chunks[heads]
    lead = (own >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.searchsorted(lead, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            s = slice(edges[b], edges[b + 1])
            least = int(chunks[s].min())
            yield b, least, encode(own[s], n[s], chunks[s] - least)


def fragment_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "chunk", "blob"])


def answers(sent: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Merge each hash range. ``decide`` gets (values, chunks, counts) sorted by value and chunk, one row for
    each value and chunk, and returns (which rows to answer, their tags)."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [decode(b.as_py()) for b in table.column("blob")]
        values = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
        chunks = np.concatenate([p[2] + c for p, c in zip(parts, table.column("chunk").to_numpy())])
        order = np.lexsort((chunks, values))
        values, counts, chunks = values[order], counts[order], chunks[order]
        heads = np.flatnonzero(first_of_pair(values, chunks))
        values, chunks, counts = values[heads], chunks[heads], np.add.reduceat(counts, heads)
        wanted, tags = decide(values, chunks, counts)
        told = np.flatnonzero(wanted)
        told = told[np.argsort(chunks[told], kind="stable")]
        rows = []
        for own in np.split(told, np.flatnonzero(np.diff(chunks[told])) + 1) if len(told) else []:
            rows.append((bucket, int(chunks[own[0]]), encode(values[own], tags[own])))
        del values, counts, chunks, order, heads, parts
        kernel.give_back()
        return pa.Table.from_batches([fragment_batch(rows)])

    return sent.groupBy("bucket").applyInArrow(merge, FRAGMENT)


def first_of_pair(values: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by value and chunk, begin a new pair."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (chunks[1:] != chunks[:-1])
    return new


def first_of_value(values: np.ndarray) -> np.ndarray:
    """Index of the group of equal values that each (sorted) row belongs to."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.cumsum(new) - 1
