"""Substring dedup: Rabin-Karp hashes of every 13-word window, counted over the whole corpus.

A word goes if a window over it also starts in a document with a smaller doc_id. Repeated windows that
overlap or touch merge into maximal removal intervals.

Chunks are ranges of doc_id, so "seen in an earlier chunk" needs no id beside the hash; inside a chunk
the ids are compared themselves. Windows are compared by 64-bit hashes: on n windows about n*n / 2**65
pairs of different windows are taken for equal, under 0.001 on 10**8.

Defined results: null or empty texts have no words; a null doc_id counts as the smallest; rows that share
a doc_id don't remove each other's words; texts shorter than a window keep all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm import exchange, kernel

WIDTH = 13
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept string"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.string()),
])


def _windows(texts: pa.Array | pa.ChunkedArray, width: int) -> tuple[kernel.Words, np.ndarray, np.ndarray]:
    words = kernel.find_words(texts)
    value, begin = kernel.window_hashes(words.hashes(), words.at, width)
    return words, value, begin


def _repeated_before(values: np.ndarray, chunks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose value also stands in an earlier chunk."""
    group = exchange.first_of_value(values)
    first = np.zeros(len(values), bool)
    if len(values):
        first[np.unique(group, return_index=True)[1]] = True
    return ~first, np.zeros(len(values), np.uint8)


def _cover(begin: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``begin``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.subtract.at(change, begin + width, 1)
    return np.cumsum(change[:-1]) > 0


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def remove_repeats(docs: DataFrame, width: int = WIDTH, carry: bool = False, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans of removed words, kept words joined by a space), a row per document.

    With ``carry`` each row also has its input row as the struct ``row``. ``chunk_bytes`` is how much text a task settles at once.
    """
    extra = [F.struct("*").alias("row")] if carry else []
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    result = StructType.fromDDL(RESULT)
    if carry:
        result = result.add(docs.schema["row"])
    ranges = exchange.Ranges(docs, bytes_per_value=5.5, value_bytes=6, chunk_bytes=chunk_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text", 8 << 20, 10_000):
                part = batch.slice(a, b - a)
                words, value, begin = _windows(part.column("text"), width)
                chunk = ranges.chunk_of(part.column("doc_id"))[words.owner()[begin]]
                yield exchange.fragment_batch(list(exchange.fragments(chunk, value, ranges.buckets, 64)))

    def settle(rows: pa.Table, seen: pa.Table) -> pa.Table:
        earlier, _ = exchange.decode_all(seen)
        ids = rows.column("doc_id").combine_chunks()
        key = ids.fill_null(exchange.LOWEST).to_numpy()
        kept_windows = []
        for a, b in kernel.blocks(rows, "text"):
            words, value, begin = _windows(rows.column("text").slice(a, b - a), width)
            kept_windows.append((words.counts, value, begin, words.owner()[begin] + a))
        value = np.concatenate([w[1] for w in kept_windows]) if kept_windows else np.zeros(0, np.uint64)
        owner = np.concatenate([w[3] for w in kept_windows]) if kept_windows else np.zeros(0, np.int64)
        order = np.lexsort((key[owner], value)) if len(value) else np.zeros(0, np.int64)
        group = exchange.first_of_value(value[order])
        least = key[owner[order]][np.unique(group, return_index=True)[1]] if len(value) else key[:0]
        gone_window = np.zeros(len(value), bool)
        gone_window[order] = key[owner[order]] > least[group] if len(value) else False
        gone_window |= exchange.find(earlier, value)[0]
        out: dict[str, list] = {n: [] for n in ARROW.names}
        done = 0
        texts = rows.column("text")
        row = 0
        for counts, v, begin, _ in kept_windows:
            gone = _cover(begin[gone_window[done : done + len(v)]], int(counts.sum()), width)
            done += len(v)
            at = np.concatenate([[0], np.cumsum(counts)])
            for d in range(len(counts)):
                own = gone[at[d] : at[d + 1]]
                words = (texts[row].as_py() or "").encode().split()
                removed = int(own.sum())
                out["doc_id"].append(ids[row].as_py())
                out["n_words"].append(len(words))
                out["n_removed"].append(removed)
                out["spans"].append(_spans(own) if removed else [])
                out["kept"].append(b" ".join(compress(words, ~own) if removed else words).decode())
                row += 1
        found = pa.Table.from_pydict(out, schema=ARROW)
        del out, kept_windows, value, owner, order, group, gone_window, earlier
        kernel.give_back()
        return found.append_column("row", rows.column("row")) if carry else found

    replies = exchange.answers(docs.mapInArrow(send, exchange.FRAGMENT), _repeated_before)
    chunked = docs.withColumn("chunk", ranges.chunk(F.col("doc_id")))
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, result)


def cut_repeats(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """``docs`` without repeated passages, columns as they are; rows that lose every word go.

    A text that loses nothing stays as it is, white space included; others are their kept words joined by a space.
    """
    out = remove_repeats(docs, width, carry=True, chunk_bytes=chunk_bytes).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
