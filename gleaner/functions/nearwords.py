"""Near words inside buckets, on whole arrays: what a task does with the buckets that a shuffle has brought to it.

Words are 64-bit integers. A row has a role: ``FOUND`` rows may be found, ``SEEKS`` rows look for others, ``BOTH`` do both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FOUND, SEEKS, BOTH = 1, 2, 3
STEP = 1 << 16  # pairs compared at once
SHORT = 256  # runs up to this length are compared together, longer ones each by itself
PLACE = np.array([0, 2, 0, 1], dtype=np.int8)  # order of the roles in a run: seeking only, both, found only

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def bucket_order(role: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts rows of equal keys side by side, and where in it a new run starts."""
    order = np.lexsort((PLACE[role], *keys))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        at = key[order]
        new[1:] |= at[1:] != at[:-1]
    return order, np.flatnonzero(new)


def near_in_runs(word: np.ndarray, role: np.ndarray, starts: np.ndarray, distance: int, hot: int, parts: list[int]) -> Pairs:
    """(i, j) of every pair of a run within the distance of which one row seeks and the other may be found, each pair once.

    Rows are in the order of ``bucket_order``. A run with more than ``hot`` rows is split by the parts of its words.
    """
    if not len(word):
        return
    ends = np.append(starts[1:], len(word))
    only = np.add.reduceat(role == SEEKS, starts, dtype=np.int64)
    seeking = np.add.reduceat(role >= SEEKS, starts, dtype=np.int64)
    size = ends - starts
    short = size <= min(SHORT, hot)
    yield from _short_runs(word, role, starts[short], size[short], only[short], seeking[short], distance)
    for s, e, o, k in zip(starts[~short], ends[~short], only[~short], seeking[~short]):
        if e - s > hot and len(parts) > 1:
            yield from _split(word, role, s, e, distance, parts)
        else:
            yield from _block(word, s, s + o, s + o, e, distance)
            yield from _block(word, s + o, s + k, s + o, e, distance)


def gathered(pairs: Pairs, at_least: int = 10_000) -> Pairs:
    """The same pairs in fewer and larger arrays."""
    held, n = [], 0
    for pair in pairs:
        if len(pair[0]):
            held.append(pair)
            n += len(pair[0])
        if n >= at_least:
            yield tuple(np.concatenate(side) for side in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(side) for side in zip(*held))


def _short_runs(word, role, starts, size, only, seeking, distance: int) -> Pairs:
    run = np.repeat(np.arange(len(starts)), seeking)
    row = starts[run] + _within(seeking)
    begin = np.where(role[row] == SEEKS, starts[run] + only[run], row + 1)
    others = starts[run] + size[run] - begin
    upto = np.cumsum(others)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP)))
        n = others[at:to]
        i, j = np.repeat(row[at:to], n), np.repeat(begin[at:to], n) + _within(n)
        near = np.bitwise_count(word[i] ^ word[j]) <= distance
        yield i[near], j[near]
        at = to


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each group of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _block(word, first, last, others, end, distance: int) -> Pairs:
    """Pairs of rows first..last with rows others..end, of two rows in both the one in order."""
    at = int(first)
    while at < last:
        begin = max(int(others), at + 1) if at >= others else int(others)
        to = min(int(last), at + max(1, STEP // max(1, int(end) - begin)))
        near = np.bitwise_count(word[at:to, None] ^ word[None, begin:end]) <= distance
        i, j = np.divmod(np.flatnonzero(near), int(end) - begin)
        i, j = i + at, j + begin
        keep = i < j
        yield i[keep], j[keep]
        at = to


def _split(word, role, start, end, distance: int, parts: list[int]) -> Pairs:
    """Words within the distance agree on a whole part; a pair counts in the first part that it shares."""
    own, own_role = word[start:end], role[start:end]
    for p, mask in enumerate(parts):
        order, starts = bucket_order(own_role, own & np.uint64(mask))
        for i, j in near_in_runs(own[order], own_role[order], starts, distance, len(own), []):
            i, j = order[i] + start, order[j] + start
            diff = word[i] ^ word[j]
            first = np.ones(len(i), dtype=bool)
            for earlier in parts[:p]:
                first &= (diff & np.uint64(earlier)) != 0
            yield i[first], j[first]


def lowest_shared(diff: np.ndarray, blocks: list[int], equal: int) -> np.ndarray:
    """Bit mask of the lowest ``equal`` blocks on which both words of a pair agree."""
    agree = np.zeros(len(diff), dtype=np.int64)
    for b, mask in enumerate(blocks):
        agree |= ((diff & np.uint64(mask)) == 0).astype(np.int64) << b
    rest = agree
    for _ in range(equal):
        rest = rest & (rest - 1)
    return agree - rest
