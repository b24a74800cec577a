"""Benchmark decontamination with spaced seeds.

Words are runs of letters and digits, lower case. A seed is the hash of the words that a mask selects at
one place; words that it ignores may differ. The seeds of all benchmark items are joined to those of every
training text; each hit names a pair and an alignment, and along the alignment the longest stretch is
looked for in which at least 80 % of the words agree, the first and the last among them. It is an overlap from 13 words on, or over a whole
item that is shorter. With up to two substitutions, every stretch of 13 words has a hit of these masks.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_WORDS`` words (an item that is larger
is a block of its own), each block is broadcast and joined to all training texts, so memory is bounded
for benchmarks of any size.

Defined results: null or empty texts and items match nothing; items under five words are too short to tell
a leak from chance and are not searched; repeated rows are reported each; equal items are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel

MASKS = ("11111", "111101", "110111", "1011011")
LEAST_WORDS = 13
LEAST_ITEM = 5
AGREE = 0.8
BLOCK_WORDS = 1_000_000
RESULT = "doc_id bigint, item_id bigint, doc_start int, doc_stop int, item_start int, n_words int, n_agree int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("doc_start", "doc_stop", "item_start", "n_words", "n_agree")]])
# Signs beyond ASCII that part words; fixed values.
SIGNS = "“”„«»‘’–—…·   "


def _plain(text: str):
    return F.lower(F.translate(text, SIGNS, " " * len(SIGNS)))


def _seeds(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place of its first word) of every mask at every place inside one text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    values, places = [], []
    for k, mask in enumerate(MASKS):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        value = np.full(n, k + 1, np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                value = value * np.uint64(kernel.BASE) + hashes[j : j + n]
        begin = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
        values.append(kernel.mix(value[begin]))
        places.append(begin)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(places)


class Block:
    """Items of one block: word hashes, where each item begins, and their seeds in sorted order."""

    def __init__(self, table: pa.Table):
        words = kernel.find_words(table.column("text"), between=kernel.SIGNS)
        self.ids = table.column("item_id").to_pylist()
        self.hashes, self.at = words.hashes(), words.at
        seed, place = _seeds(self.hashes, self.at)
        order = np.argsort(seed, kind="stable")
        self.seed, self.place = seed[order], place[order]
        self.item = np.searchsorted(self.at, self.place, "right") - 1


def longest_agreement(equal: np.ndarray) -> tuple[int, int]:
    """(start, stop) of the longest stretch with at least 80 % true that begins and ends on true; the first of several."""
    if not equal.any():
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -4.0))])
    low = np.minimum.accumulate(np.where(equal, total[:-1], np.inf))
    stops = np.flatnonzero(equal) + 1
    starts = np.searchsorted(-low, -total[stops], "left")
    best = int(np.argmax(stops - starts))
    return int(starts[best]), int(stops[best])


def _overlaps(batch: pa.RecordBatch, block: Block) -> dict[tuple[int, int], tuple]:
    """Best overlap of each (row, item): (n_words, n_agree, doc_start, item_start)."""
    words = kernel.find_words(batch.column("_plain"), between=kernel.SIGNS)
    hashes = words.hashes()
    seed, place = _seeds(hashes, words.at)
    low = np.searchsorted(block.seed, seed, "left")
    low[low == len(block.seed)] = 0
    hit = np.flatnonzero(block.seed[low] == seed) if len(block.seed) else np.zeros(0, np.int64)
    low, place = low[hit], place[hit]
    n = np.searchsorted(block.seed, seed[hit], "right") - low
    which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(place, n)
    row, item = np.searchsorted(words.at, place, "right") - 1, block.item[which]
    shift = (place - words.at[row]) - (block.place[which] - block.at[item])
    best: dict[tuple[int, int], tuple] = {}
    for r, i, d in np.unique(np.stack([row, item, shift], 1), axis=0):
        doc, own = hashes[words.at[r] : words.at[r + 1]], block.hashes[block.at[i] : block.at[i + 1]]
        first, last = max(0, -d), min(len(own), len(doc) - d)
        equal = own[first:last] == doc[first + d : last + d]
        start, stop = longest_agreement(equal)
        if stop - start >= max(LEAST_ITEM, min(LEAST_WORDS, len(own))):
            found = (int(stop - start), int(equal[start:stop].sum()), -int(start + first + d), int(start + first))
            best[int(r), int(i)] = max(best.get((int(r), int(i)), found), found)
    return {k: (n, a, -d, s) for k, (n, a, d, s) in best.items()}


def _blocks(benchmark: DataFrame) -> Iterator[pa.Table]:
    """The benchmark in pieces of bounded size; nothing larger reaches the driver at once."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), _plain("text").alias("text"))
    sized = items.where("text IS NOT NULL").withColumn("n", F.size(F.split("text", " ")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    pieces = math.ceil(total / BLOCK_WORDS) or 1
    for k in range(pieces):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == k).select("item_id", "text") if pieces > 1 else sized.select("item_id", "text")
        table = part.toArrow()
        if table.num_rows:
            yield table


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest overlap of every (document, item) pair that has one, in word positions."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _plain("text").alias("_plain"))

    def against(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for a, b in kernel.blocks(batch, "_plain"):
                    part = batch.slice(a, b - a)
                    rows = [
                        (part.column("doc_id")[r].as_py(), block.ids[i], at, at + n, own, n, agree)
                        for (r, i), (n, agree, at, own) in sorted(_overlaps(part, block).items())
                    ]
                    if rows:
                        yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(ARROW.names, zip(*rows))}, schema=ARROW)

        return texts.mapInArrow(scan, RESULT)

    spark = docs.sparkSession
    parts = [against(spark.sparkContext.broadcast(Block(t))) for t in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they are."""
    spark, schema = docs.sparkSession, docs.schema
    for table in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Block(table))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, b in kernel.blocks(batch, "_plain"):
                    for r, _ in _overlaps(batch.slice(a, b - a), shared.value):
                        clean[a + r] = False
                yield batch.filter(pa.array(clean)).drop_columns(["_plain"])
            kernel.give_back()

        docs = docs.withColumn("_plain", _plain("text")).mapInArrow(scan, schema)
    return docs
