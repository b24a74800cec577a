"""Ranked lexical search turned round: the queries are indexed, the documents are streamed past them.

Terms are runs of letters and digits of ASCII and of all other characters beyond ASCII, A to Z lower-cased.

1. An inverted index over the items' terms (term -> items, with how often each holds it) is built and broadcast. Items are taken in
   blocks of at most ``ITEM_TERMS`` terms in all, one after the other, so the index has a fixed bound whatever their number.
2. One pass over the documents counts what the weights need: documents and terms in all, and documents holding each
   indexed term.
3. A second pass streams each document's counts of indexed terms through the postings, sums the scores of the items
   they reach and keeps the ``top`` best documents of each item in a bounded heap for each task.
4. The tasks' heaps are merged by groups of tasks first, then for each item, so no merge grows with documents.

Scores are integers, but for the weight: w = floor(1000 ln((2 N + 2) / (2 df + 1))).
Terms are matched by 64-bit hashes of their bytes: a document's term is taken for another one of T indexed ones with
a probability of T / 2**64.

Defined results: null and empty texts have no term; items without a term, or with no match, have no row; the rows of one item_id are
one item with the terms of all its different texts; rows of one doc_id are documents of their own; a null doc_id comes after all others of
its score; other columns of the inputs are not looked at; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import kernel

TOP = 10
ITEM_TERMS = 200_000
# Sums of one block of documents: documents x items.
CELLS = 2_000_000
# Heaps are merged in this many groups of tasks before the last merge.
MERGE_GROUPS = 256
NULL_ID = (1 << 63) - 1
FOUND = "item int, doc_id bigint, score bigint, part int"


def terms_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every term."""
    words = kernel.find_words(texts, fold=True, between=kernel.SIGNS)
    return words.owner(), words.hashes()


def counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times), one row for each text and term."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return owner[head], term[head], np.diff(np.append(head, len(term)))


@dataclass
class Index:
    """Postings of each term: items[at[t]:at[t + 1]] hold terms[t], times[...] times each."""

    terms: np.ndarray
    at: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int

    @classmethod
    def of(cls, texts: list[str]) -> Index:
        item, term, times = counted(*terms_of(pa.array(texts, pa.string())))
        order = np.lexsort((item, term))
        terms, head = np.unique(term[order], return_index=True)
        return cls(terms, np.append(head, len(term)), item[order], times[order].astype(np.int64), len(texts))

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text in all, and (text, indexed term, times)."""
        owner, term = terms_of(texts)
        n = np.bincount(owner, minlength=len(texts))
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        there = self.terms[place] == term
        return n, *counted(owner[there], place[there])


@dataclass
class Statistics:
    """Documents with a term, their terms in all, and the weight of each indexed term."""

    n_docs: int
    n_terms: int
    weight: np.ndarray


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of a bounded number of terms, read one after the other."""
    texts = F.collect_set(F.col("text").cast("string"))
    rows = items.where("text IS NOT NULL").groupBy("item_id").agg(F.array_join(F.sort_array(texts), "\n").alias("text"))
    ids, block, held = [], [], 0
    for row in rows.orderBy("item_id").toLocalIterator():
        n = len(terms_of(pa.array([row["text"]]))[0])
        if block and held + n > ITEM_TERMS:
            yield ids, block
            ids, block, held = [], [], 0
        if n:
            ids.append(row["item_id"])
            block.append(row["text"])
            held += n
    if block:
        yield ids, block


def statistics(docs: DataFrame, index: Index) -> Statistics:
    """One pass that sends, for each batch, the sums over its documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, docs_, terms = np.zeros(len(own.terms), np.int64), 0, 0
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                n, _, term, _ = own.hits(batch.column("text").slice(a, b - a))
                df += np.bincount(term, minlength=len(df))
                docs_, terms = docs_ + int((n > 0).sum()), terms + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[docs_, terms], df[held]])),
        ], ["term", "n"])

    found = docs.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))
    n_docs = sums.get(-2, 0)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(t, 0) + 1))) for t in range(len(index.terms))]
    return Statistics(n_docs, sums.get(-1, 0), np.array(weight, np.int64))


class Heaps:
    """The best documents of each item; the root of a heap is the one to go next."""

    def __init__(self, items: int, top: int):
        self.top, self.rows = top, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def update(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.rows[item]
        for entry in zip(scores.tolist(), (-ids).tolist()):
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.top:
            self.least[item] = heap[0][0]

    def offer(self, sums: np.ndarray, ids: np.ndarray) -> None:
        """``sums`` has a row for each document and a column for each item."""
        doc, item = np.nonzero(sums >= self.least)
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            own = doc[a:b]
            if len(own) > self.top:
                # of one block, only documents as good as its own top can enter
                score = sums[own, item[a]]
                own = own[score >= np.partition(score, len(score) - self.top)[len(score) - self.top]]
            self.update(int(item[a]), sums[own, item[a]], ids[own])


def scores(index: Index, stats: Statistics, texts: pa.Array) -> np.ndarray:
    """The score of every document (row) for every item (column)."""
    n, doc, term, tf = index.hits(texts)
    m = 25 + (75 * n * stats.n_docs) // max(stats.n_terms, 1)
    part = stats.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    reach = np.diff(index.at)[term]
    ends = np.cumsum(reach)
    posting = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - reach, reach) + np.repeat(index.at[term], reach)
    out = np.zeros(len(texts) * index.n_items, np.int64)
    np.add.at(out, np.repeat(doc, reach) * index.n_items + index.items[posting], np.repeat(part, reach) * index.times[posting])
    return out.reshape(len(texts), index.n_items)


def _search(docs: DataFrame, index: Index, stats: Statistics, top: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast((index, stats))
    rows = max(1, CELLS // index.n_items)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        heaps = Heaps(own.n_items, top)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for a, b in kernel.blocks(batch, "text", rows=rows):
                heaps.offer(scores(own, known, batch.column("text").slice(a, b - a)), ids[a:b])
        item = np.repeat(np.arange(own.n_items), [len(h) for h in heaps.rows])
        flat = np.array([e for h in heaps.rows for e in h], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(item, pa.int32()), pa.array(-flat[:, 1]), pa.array(flat[:, 0]), pa.array(np.zeros(len(item), np.int32)),
        ], ["item", "doc_id", "score", "part"])

    heaps = docs.mapInArrow(stream, FOUND).withColumn("part", F.spark_partition_id())
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    merged = heaps.withColumn("group", F.col("part") % MERGE_GROUPS).withColumn("rank", best("item", "group")).where(F.col("rank") <= top)
    ranked = merged.drop("rank").withColumn("rank", best("item")).where(F.col("rank") <= top)
    return ranked.select("item", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 of every item."""
    spark = docs.sparkSession
    item_type = dict(items.dtypes)["item_id"]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint")
    for ids, texts in _blocks(items):
        index = Index.of(texts)
        found = _search(docs, index, statistics(docs, index), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_type}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
