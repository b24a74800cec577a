"""64-bit fingerprints, Hamming distance and array signal metrics."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.session import bind

FAR = 99  # distance when either fingerprint is missing


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_or_far(a: Column, b: Column) -> Column:
    return F.coalesce(hamming64(a, b), F.lit(FAR))


def bits_from_hex(text: Column) -> Column:
    """16 hex digits to a signed bit pattern; decoded in halves, as the top half may exceed 2^63."""
    def half(start: int) -> Column:
        return F.conv(F.substring(text, start, 8), 16, 10).cast("bigint")

    ok = text.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hex_from_bits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def fingerprint64(vector: Column) -> Column:
    """One bit per element of a 64-element vector: is it above the vector's median?"""
    def fold(b: Column) -> Column:
        median = (b["sorted"][31] + b["sorted"][32]) / 2
        return F.aggregate(
            b["values"],
            F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > median).cast("bigint")),
        )

    values = vector.cast("array<double>")
    bound = F.struct(values.alias("values"), F.sort_array(values).alias("sorted"))
    return F.when(F.size(vector) == 64, bind(bound, fold))


def token_profile(text: Column) -> Column:
    """64 counts of the whole text's words, each word hashed to one of 64 symbols.

    Stays in one row and one stage: no explode of the words and no shuffle. Whole Arrow batches go to Python, where a word
    that a task has met before is not hashed again; an expression would hash every word and count each symbol apart.
    """
    return _profiles()(text.cast("binary"))


def _profiles():
    @F.pandas_udf("array<double>")
    def profiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = re.compile(rb"[ \n\r\t]+").split
        symbol: dict[bytes, int] = {}

        def profile(content: bytes | None) -> list[float] | None:
            if content is None:
                return None
            if len(symbol) > 200_000:
                symbol.clear()
            counts = [0.0] * 64
            for word, n in Counter(split(content)).items():
                place = symbol.get(word)
                if place is None:
                    place = hashlib.md5(word, usedforsecurity=False).digest()[0] >> 2  # the first base64 digit
                    if len(word) <= 64:
                        symbol[word] = place
                counts[place] += n
            return counts

        for contents in batches:
            yield contents.map(profile)

    return profiles


def second_difference_variance(vector: Column) -> Column:
    """Population variance of v[i-1] - 2 v[i] + v[i+1]: low means a flat, featureless signal."""
    def spread(v: Column) -> Column:
        diffs = F.transform(
            F.sequence(F.lit(1), F.size(v) - 2), lambda i: v[i - 1] - v[i] * 2 + v[i + 1]
        )
        return bind(diffs, _variance)

    return F.when(F.size(vector) >= 3, bind(vector.cast("array<double>"), spread))


def _sum(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def _variance(values: Column) -> Column:
    """Population variance by Welford's running mean, step for step as DuckDB's, so that rows that tie in one tie in both."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + (x - mean) * (x - acc["mean"])).alias("squares"))

    return F.aggregate(values, start, step, lambda acc: acc["squares"] / acc["n"])


def mean_level(vector: Column) -> Column:
    return _sum(vector.cast("array<double>")) / F.size(vector)


def level_stddev(vector: Column) -> Column:
    return F.sqrt(bind(vector.cast("array<double>"), _variance))


def clipped_fraction(vector: Column, threshold: Column | float) -> Column:
    """Share of elements above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.size(F.filter(vector.cast("array<double>"), lambda x: x > limit)) / F.size(vector)


def edge_density(vector: Column, threshold: float) -> Column:
    """Share of elements whose step to the next element exceeds the threshold."""
    def count(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: F.abs(v[i + 1] - v[i]))
        return F.size(F.filter(steps, lambda s: s > threshold)) / F.size(v)

    return F.when(F.size(vector) >= 2, bind(vector.cast("array<double>"), count))


# --- pigeonhole blocks ------------------------------------------------------------------------


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` near-equal slices of 64 bits."""
    base, extra = divmod(64, blocks)
    bounds, shift = [], 0
    for i in range(blocks):
        width = base + (1 if i < extra else 0)
        bounds.append((shift, width))
        shift += width
    return bounds


def equal_blocks_for(max_distance: int, expected: int) -> int:
    """Blocks that a key must join so that ``expected`` words share a key by chance less than once.

    More blocks make longer keys, and more keys per word: 2 give 16 bits at distance 6, 3 give 21, 4 give 25.
    """
    equal = 1
    while 64 * equal // (max_distance + equal) < math.log2(max(expected, 2)):
        equal += 1
    return equal


def block_masks(max_distance: int, equal_blocks: int = 2) -> Column:
    """Constant array of (chosen, mask): every choice of ``equal_blocks`` blocks.

    With ``max_distance + equal_blocks`` blocks, two words within ``max_distance`` agree on at
    least ``equal_blocks`` of them, so an equi-join on (chosen, bits & mask) misses no pair.
    ``chosen`` is the set of blocks as a bit mask.
    """
    bounds = block_bounds(max_distance + equal_blocks)
    return F.array(
        *[
            F.struct(
                F.lit(sum(1 << i for i in chosen)).alias("chosen"),
                F.lit(_signed(sum(((1 << bounds[i][1]) - 1) << bounds[i][0] for i in chosen)))
                .cast("bigint").alias("mask"),
            )
            for chosen in combinations(range(len(bounds)), equal_blocks)
        ]
    )


def first_shared_blocks(a: Column, b: Column, max_distance: int, equal_blocks: int = 2) -> Column:
    """Mask of the lowest ``equal_blocks`` blocks on which both words agree.

    Keeping a candidate only under this choice emits every pair once, with no distinct afterwards.
    """
    diff = a.bitwiseXOR(b)
    agree = F.lit(0)
    for i, (shift, width) in enumerate(block_bounds(max_distance + equal_blocks)):
        mask = F.lit(_signed(((1 << width) - 1) << shift)).cast("bigint")
        agree = agree + F.when(diff.bitwiseAND(mask) == 0, 1 << i).otherwise(0)
    rest = agree
    for _ in range(equal_blocks):
        rest = rest.bitwiseAND(rest - 1)  # drops the lowest set bit
    return agree - rest


def _interleaved(parts: int) -> list[int]:
    return [sum(1 << bit for bit in range(part, 64, parts)) for part in range(parts)]


def part_masks(max_distance: int) -> Column:
    """Constant array of (part, mask): 64 bits dealt in turn to ``max_distance + 1`` parts.

    Two words within ``max_distance`` agree on a whole part. The bits of a part lie in all blocks, so few of them are already in
    a key of ``block_masks``: a part splits a bucket of such a key further.
    """
    return F.array(*[
        F.struct(F.lit(i).alias("part"), F.lit(_signed(mask)).cast("bigint").alias("mask"))
        for i, mask in enumerate(part_bits(max_distance))
    ])


def part_bits(max_distance: int) -> list[int]:
    """The masks of ``part_masks`` as plain numbers."""
    return _interleaved(max_distance + 1)


def first_shared_part(a: Column, b: Column, max_distance: int) -> Column:
    """The lowest part on which both words agree, null if there is none."""
    diff = a.bitwiseXOR(b)
    return F.coalesce(*[
        F.when(diff.bitwiseAND(F.lit(_signed(mask)).cast("bigint")) == 0, F.lit(i)) for i, mask in enumerate(_interleaved(max_distance + 1))
    ])


def probe_radii(max_distance: int, blocks: int) -> list[int]:
    """How many bits may differ in each block, -1 for none, so that words within ``max_distance`` meet in one block.

    With distance = blocks * s + a the first a + 1 blocks stand s bits and the others s - 1: words that exceed
    that everywhere differ in more than ``max_distance`` bits together.
    """
    s, a = divmod(max_distance, blocks)
    return [s if i <= a else s - 1 for i in range(blocks)]


def probe_cost(max_distance: int, blocks: int, pool: int) -> float:
    """Rows that a word of a pool causes: its probes, and the words that they meet by chance."""
    cost = 0.0
    for (_, width), radius in zip(block_bounds(blocks), probe_radii(max_distance, blocks)):
        probes = sum(math.comb(width, k) for k in range(radius + 1))
        cost += probes + probes * pool / 2**width
    return cost


def blocks_for_pool(max_distance: int, pool: int) -> int:
    """The number of blocks with the least cost for pools of about this many different words."""
    return min(range(3, max_distance + 2), key=lambda m: probe_cost(max_distance, m, pool))


def probe_masks(max_distance: int, blocks: int, probing: bool) -> Column:
    """Constant array of (block, mask, flip). Index rows have a flip of 0; probing rows every flip within the radius."""
    rows = []
    for i, ((shift, width), radius) in enumerate(zip(block_bounds(blocks), probe_radii(max_distance, blocks))):
        mask = ((1 << width) - 1) << shift
        for k in range(radius + 1 if probing else min(radius + 1, 1)):
            for bits in combinations(range(shift, shift + width), k):
                rows.append((i, _signed(mask), _signed(sum(1 << b for b in bits))))
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.lit(m).cast("bigint").alias("mask"), F.lit(f).cast("bigint").alias("flip")) for i, m, f in rows
    ])


def first_probed_block(a: Column, b: Column, max_distance: int, blocks: int) -> Column:
    """The lowest block in which both words are within its radius, so that a pair is kept once."""
    diff, tests = a.bitwiseXOR(b), []
    for i, ((shift, width), radius) in enumerate(zip(block_bounds(blocks), probe_radii(max_distance, blocks))):
        if radius >= 0:
            own = diff.bitwiseAND(F.lit(_signed(((1 << width) - 1) << shift)).cast("bigint"))
            tests.append(F.when(F.bit_count(own) <= radius, F.lit(i)))
    return F.coalesce(*tests)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask
