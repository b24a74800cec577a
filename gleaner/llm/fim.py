"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

A text is cut at unit ends. A unit is a word with the white space before it; white space at the end of a text is a
unit of its own. Texts are laid in blocks of ``BLOCK`` UTF-8 bytes. A Fenwick tree over the blocks holds their
unit ends, a second one their code points. A binary-lifting descent through the first finds the block of
a unit's end and, on its way, sums the second; only that block is then read to locate the end.

Both cut points, the form and the order depend on the seed and doc_id alone, so a retried task repeats them.

Defined results: null and empty texts, and texts that hold a sentinel, stay plain; a null doc_id is drawn like the empty
id; a text that is only white space is one unit; repeated rows get equal results; other columns of the
input are not looked at, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Options:
    """``plain`` and ``spm`` are percentages: of all texts, and of those that are not plain."""

    seed: int = 42
    plain: int = 50
    spm: int = 80


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree over ``counts``: node i (from 1) sums the i & -i counts that end with the i-th."""
    total = np.concatenate([[0], np.cumsum(counts)])
    node = np.arange(1, len(counts) + 1)
    return np.concatenate([[0], total[node] - total[node & (node - 1)]])


def descend(tree: np.ndarray, beside: np.ndarray, k: int) -> tuple[int, int, int]:
    """The number of leading blocks that hold fewer than k together, their sum, and their sum in ``beside``."""
    at = got = other = 0
    step = 1 << ((len(tree) - 1).bit_length() - 1) if len(tree) > 1 else 0
    while step:
        nxt = at + step
        if nxt < len(tree) and got + tree[nxt] < k:
            at, got, other = nxt, got + int(tree[nxt]), other + int(beside[nxt])
        step >>= 1
    return at, got, other


class Cutter:
    """Unit ends of one text, given as its UTF-8 bytes."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        ends, points = [], []
        step = max(block, kernel.SEGMENT // block * block)
        for a in range(0, len(data), step):
            b = min(a + step, len(data))
            starts = np.arange(0, b - a, block)
            ends.append(np.add.reduceat(self._ends(a, b), starts, dtype=np.int64))
            points.append(np.add.reduceat((data[a:b] & 0xC0) != 0x80, starts, dtype=np.int64))
        none = np.zeros(0, np.int64)
        self.units = fenwick(np.concatenate(ends) if ends else none)
        self.points = fenwick(np.concatenate(points) if points else none)
        self.n = int(sum(int(e.sum()) for e in ends))

    def _ends(self, a: int, b: int) -> np.ndarray:
        """For each byte from a to b: is it the last one of a unit?"""
        space = kernel.SPACE[self.data[a : b + 1]]
        out = np.ones(b - a, bool)
        inner = len(space) - 1
        out[:inner] = ~space[:inner] & space[1:]
        return out

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k <= 0:
            return 0, 0
        skipped, seen, points = descend(self.units, self.points, k)
        a = skipped * self.block
        b = min(a + self.block, len(self.data))
        end = int(np.flatnonzero(self._ends(a, b))[k - seen - 1]) + 1
        return a + end, points + int(((self.data[a : a + end] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the id and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def arrange(doc_id: int | None, data: np.ndarray, options: Options) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    cutter = Cutter(data)
    text = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    h1, h2, h3, h4 = draws(doc_id, options.seed)
    if not text or h3 % 100 >= options.plain or any(m in text for m in marks):
        return cutter.n, "plain", None, None, text
    first, second = sorted((h1 % (cutter.n + 1), h2 % (cutter.n + 1)))
    (a, a_chars), (b, b_chars) = cutter.cut(first), cutter.cut(second)
    p, s, m = marks
    head, mid, tail = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < options.spm
    output = b"".join([s, tail, p, head, m, mid] if spm else [p, head, s, tail, m, mid])
    return cutter.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, output


def fill_in_middle(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                data, at = kernel.text_buffers(part.column("text"))
                done = [arrange(i, data[at[d] : at[d + 1]], options) for d, i in enumerate(part.column("doc_id").to_pylist())]
                n, form, prefix, middle, output = zip(*done)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text again, from output and form alone. No part holds a sentinel, so each stands at its first occurrence."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after = lambda mark: F.substring_index(out, mark, -1)
    until = lambda part, mark: F.substring_index(part, mark, 1)
    head = F.when(form == "spm", until(after(PREFIX), MIDDLE)).otherwise(until(after(PREFIX), SUFFIX))
    tail = F.when(form == "spm", until(after(SUFFIX), PREFIX)).otherwise(until(after(SUFFIX), MIDDLE))
    return F.when(form == "plain", out).otherwise(F.concat(head, after(MIDDLE), tail))
