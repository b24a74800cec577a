"""Packing token sequences with non-negative least squares.

Texts are tokenized once and stored. What is longer than a sequence is cut into whole sequences; the
remainders are counted by length (in units of eight tokens, rounded up). Combinations of two or three lengths that
fill a sequence are enumerated, and non-negative least squares finds how often each is to be used so that
they use up the counts. The solution is rounded down to what the counts hold; what it leaves over is
packed greedily, one remainder after the other, cut where a sequence is full. The first part loses at most
seven tokens a piece, the second part none but in its last sequence.

Only the 256 length counts reach the driver. Remainders get their place from their rank within a length.

Ids are those of the ``tokenizers`` library with byte_bpe_50k.json, text of special tokens being ordinary
text, followed by the id 1. They come from ``tiktoken`` with the same vocabulary, as it is faster; the tests hold them equal.
Its pattern overflows the stack on about a million white-space characters in a row, so a run of LONG_RUN or
more is given to the merges as the one piece that the pattern would make of it.

Defined results: a null text is empty, its one id is 1; a null doc_id and repeated rows are documents of
their own; an empty table has no pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.numbering import number_rows
from gleaner.session import cut_lineage

LENGTH = 2048
UNIT = 8
DEPTH = 3
END_ID = 1
LONG_RUN = 100_000
# Unicode's white space, as the pattern takes it; Python's own class has four signs more.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
TOKENS = "doc_id bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, made once in a process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_ids(codec, text: str) -> list[int]:
    """Ids of a text of any kind. Of a run of spaces before a word the last one is not part of the run's piece."""
    ids, at = [], 0
    if len(text) >= LONG_RUN:
        for run in SPACES.finditer(text):
            start, stop = run.span()
            if stop - start >= LONG_RUN:
                stop -= stop < len(text)
                ids += codec.encode_ordinary(text[at:start])
                ids += codec._encode_single_piece(text[start:stop])
                at = stop
    return ids + codec.encode_ordinary(text[at:])


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n, ids): ids as compressed 16-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            n, blobs = [], []
            for text in batch.column("text"):
                ids = token_ids(codec, text.as_py() or "")
                ids.append(END_ID)
                n.append(len(ids))
                blobs.append(pack.compress(np.array(ids, dtype="<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, TOKENS)


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` lengths that sum to ``units``."""
    out = [(units,)]
    for n in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, units), n - 1):
            last = units - sum(head)
            if last >= head[-1]:
                out.append((last, *reversed(head)))
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set (Lawson and Hanson, 1974)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ b
    limit = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        open_ = np.where(used, -np.inf, gain)
        best = int(np.argmax(open_))
        if open_[best] <= limit:
            break
        used[best] = True
        while True:
            on = np.flatnonzero(used)
            try_ = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (try_ > 0).all():
                break
            low = try_ <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - try_[low], 1e-300))
            x[on] += step * (try_ - x[on])
            used[on[low & (x[on] <= 1e-12)]] = False
            x[~used] = 0
            if not used.any():
                return x
        x[:] = 0
        x[on] = try_
        gain = a.T @ (b - a @ x)
    return x


def plan(counts: np.ndarray, units: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, place in it): which remainders make which sequence.

    counts[k] is how many remainders have k units.
    """
    total = int(counts.sum())
    if not total:
        return []
    choices = combinations(units)
    a = np.zeros((units, len(choices)))
    for j, c in enumerate(choices):
        for k in c:
            a[k - 1, j] += 1
    times = non_negative_least_squares(a, counts[1:] / total) * total
    left, used, out, sequence = counts.copy(), np.zeros_like(counts), [], 0
    for j in np.argsort(-times, kind="stable"):
        lengths, each = np.unique(choices[j], return_counts=True)
        n = int(min(np.floor(times[j] + 1e-6), *(left[k] // m for k, m in zip(lengths, each))))
        if n <= 0:
            continue
        for place, k in enumerate(choices[j]):
            out.append((int(k), int(used[k]), int(used[k]) + n, sequence, place))
            used[k] += n
            left[k] -= n
        sequence += n
    return out


def _totals(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Adds before_<value>: the sum over all rows that come earlier in ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    sums = spread.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = sums.select("_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = local.join(before, "_part")
    return joined.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_{v}") for v in values}).drop("_part", *[f"_{v}" for v in values])


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32 bit)."""
    spark = docs.sparkSession
    tokens = cut_lineage(tokenize(docs, vocabulary or default_vocabulary()).withColumn("row", F.monotonically_increasing_id()))
    units = length // UNIT
    light = tokens.select("row", "n", F.floor(F.col("n") / length).alias("whole"), (F.col("n") % length).alias("rest"))
    light = light.withColumn("unit", F.ceil(F.col("rest") / UNIT).cast("int"))
    counts = np.zeros(units + 1, np.int64)
    for r in light.where("rest > 0").groupBy("unit").agg(F.count("*").alias("n")).collect():
        counts[r["unit"]] = r["n"]
    spans = plan(counts, units)
    windows = max([s[3] + s[2] - s[1] for s in spans], default=0)
    ranked = number_rows(light.where("rest > 0"), ["row"], "_at", by=("unit",)).withColumn("_at", F.col("_at") - 1)
    # at most units * DEPTH rows
    steps = F.broadcast(spark.createDataFrame(spans, "unit int, a bigint, b bigint, first bigint, place int"))
    inside = F.col("_at").between(F.col("a"), F.col("b") - 1)
    planned = ranked.join(steps, "unit").where(inside).select(
        "row", (F.col("first") + F.col("_at") - F.col("a")).alias("sequence"), "place", "rest"
    )
    earlier = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    planned = planned.select("row", "sequence", F.coalesce(F.sum("rest").over(earlier), F.lit(0)).alias("offset"))
    rows = light.join(planned, "row", "left").withColumn("over", F.when(F.col("sequence").isNull(), F.col("rest")).otherwise(0))
    rows = _totals(rows, "row", ["whole", "over"])
    last = rows.agg(F.sum("over")).first()[0] or 0
    after = windows + -(-last // length)
    begin = F.col("whole") * length
    one = lambda start, size, sequence, offset: F.struct(
        start.cast("bigint").alias("start"), size.cast("bigint").alias("length"), sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset")
    )
    whole = F.when(F.col("whole") > 0, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1), lambda i: one(i * length, F.lit(length), F.lit(after) + F.col("before_whole") + i, F.lit(0))
    )).otherwise(F.array())
    at, end = F.col("before_over"), F.col("before_over") + F.col("over")
    cut = F.transform(
        F.sequence(F.floor(at / length), F.floor((end - 1) / length)),
        lambda s: one(begin + F.greatest(s * length, at) - at, F.least((s + 1) * length, end) - F.greatest(s * length, at), F.lit(windows) + s, F.greatest(s * length, at) - s * length),
    )
    rest = F.when(F.col("sequence").isNotNull(), F.array(one(begin, F.col("rest"), F.col("sequence"), F.col("offset")))).when(F.col("over") > 0, cut).otherwise(F.array())
    pieces = rows.select("row", F.concat(whole, rest).alias("pieces"))

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc, n, blob, parts in zip(*[batch.column(c) for c in ("doc_id", "n", "ids", "pieces")]):
                ids = np.frombuffer(unpack.decompress(blob.as_py()), "<u2").astype("<u4")
                for p in parts.as_py():
                    a, size = p["start"], p["length"]
                    out.append((doc.as_py(), a, size, n.as_py(), p["sequence_id"], p["offset"], ids[a : a + size].tobytes()))
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return tokens.select("row", "doc_id", "n", "ids").join(pieces, "row").drop("row").mapInArrow(slice_, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
