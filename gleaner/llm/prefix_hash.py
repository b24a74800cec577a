"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds the hash of every prefix of a sequence, modulo two primes. The hash of any span
follows from two of them, so span equality is one comparison, and the longest common extension of two places is
found by binary search.

A fingerprint is the same array over a text, kept at a few places that the text itself names. Word ends are
places; the hash of the last ``WINDOW`` words there, and how often it occurred before, gives a place its rank (trailing
zero bits). The lowest rank that leaves at most ``PLACES`` places is kept, so short texts keep every word end and
long ones some ``PLACES / 2`` to ``PLACES`` of them; places of a higher rank are among those of a lower one, so two
fingerprints are compared at the higher rank of both. Spans between neighbouring places are then the
letters of two short sequences, with prefix arrays of their own: common runs are grown from equal letters by binary search,
longest first, and each letter is used once. The likeness is the code points in common runs of both, over those of both.

Defined results: null and empty texts have the fingerprint of the empty text, which is like itself (1) and like
nothing else (0); equal texts have equal fingerprints; other columns of the input are not looked at. In ``edited`` rows
of one doc_id follow each other in the order of their texts' hashes, a null doc_id comes after all others, a lone row is
its own next one, repeated rows get equal rows, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two largest primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
PLACES = 64
WINDOW = 3
SEGMENT = 1 << 18
# Text bytes of one range of ``edited``; with more than MOST_RANGES ranges they grow in place of their number.
RANGE_BYTES = 32 << 20
MOST_RANGES = 20_000
LOWEST = -(1 << 63)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime, for i up to n."""
    if which not in _tables or len(_tables[which][0]) <= n:
        p, size = PRIMES[which], max(n + 1, 4096)
        both = []
        for base in (BASES[which], pow(BASES[which], -1, p)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), p)) % np.uint64(p)])
            both.append(table)
        _tables[which] = (both[0], both[1])
    return _tables[which]


class Prefixes:
    """Hashes of all prefixes of a sequence of numbers below 2**30."""

    def __init__(self, symbols: np.ndarray, start: tuple[int, int] = (0, 0)):
        """``start`` is the hash of what precedes the symbols."""
        symbols = symbols.astype(np.uint64) + np.uint64(1)
        self.n = len(symbols)
        self.at = []
        for which, (p, before) in enumerate(zip(PRIMES, start)):
            up, down = _powers(self.n, which)
            p = np.uint64(p)
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(symbols * down[: self.n] % p, out=total[1:])
            own = total % p
            own[1:] = own[1:] * up[: self.n] % p
            self.at.append((own + np.uint64(before) * up[: self.n + 1]) % p if before else own)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number below 2**62 for each span from a to b."""
        out = []
        for which, (p, at) in enumerate(zip(PRIMES, self.at)):
            p = np.uint64(p)
            out.append((at[b] + p - at[a] * _powers(self.n, which)[0][b - a] % p) % p)
        return out[0] << np.uint64(31) | out[1]

    def span(self, a: int, b: int) -> int:
        out = 0
        for which, (p, at) in enumerate(zip(PRIMES, self.at)):
            out = out << 31 | (int(at[b]) - int(at[a]) * int(_powers(self.n, which)[0][b - a])) % p
        return out

    def extension(self, a: int, other: Prefixes, b: int) -> int:
        """The length of the longest common extension of place a here and place b there."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(a, a + mid) == other.span(b, b + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _word_ends(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Places after each word, the hashes of the words and of the text up to there, and of all; a segment at a time."""
    ends, words, upto, start = [], [], [], (0, 0)
    a = 0
    while a < len(text):
        # A word that a segment would cut is begun anew in the next one, unless it fills the segment.
        points = _code_points(text[a : a + SEGMENT + 1])
        space = (points == 32) | ((points >= 9) & (points <= 13))
        stop = min(SEGMENT, len(points))
        if a + stop < len(text):
            breaks = np.flatnonzero(~space[:stop] & space[1 : stop + 1])
            stop = int(breaks[-1]) + 1 if len(breaks) else stop
        points, space = points[:stop], space[:stop]
        prefixes = Prefixes(points, start)
        first = ~space & np.concatenate([[True], space[:-1]])
        last = ~space & np.concatenate([space[1:], [True]])
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        ends.append(end + a)
        words.append(prefixes.spans(begin, end))
        upto.append(np.stack([at[end] for at in prefixes.at], 1))
        start = (int(prefixes.at[0][-1]), int(prefixes.at[1][-1]))
        a += stop
    none = np.zeros((0, 2), np.uint64)
    return np.concatenate(ends or [none[:, 0].astype(np.int64)]), np.concatenate(words or [none[:, 0]]), np.concatenate(upto or [none]), start


def _ranks(words: np.ndarray) -> np.ndarray:
    """Trailing zero bits of each place's hash: of the last words, and of how often they occurred before."""
    value = np.zeros(len(words), np.uint64)
    for j in range(WINDOW):
        value[j:] = value[j:] * np.uint64(0x9E3779B97F4A7C15) + words[: len(words) - j]
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    new = np.ones(len(value), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    head = np.flatnonzero(new)
    seen = np.empty(len(value), np.uint64)
    seen[order] = (np.arange(len(value)) - np.repeat(head, np.diff(np.append(head, len(value))))).astype(np.uint64)
    value += seen * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    low = value & (~value + np.uint64(1))
    return np.where(value == 0, 63, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)).astype(np.uint8)


class Fingerprint:
    """A text's length, and its prefix hashes at the kept places, the last one being its end."""

    def __init__(self, places: np.ndarray, hashes: np.ndarray, ranks: np.ndarray, rank: int):
        self.places, self.hashes, self.ranks, self.rank = places, hashes, ranks, rank
        self._letters: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, text: str | None, most: int = PLACES) -> Fingerprint:
        text = text or ""
        ends, words, upto, whole = _word_ends(text)
        inner = ends < len(text)
        ends, upto, ranks = ends[inner], upto[inner], _ranks(words)[inner]
        rank = 0
        if len(ends) > most:
            left = len(ends) - np.cumsum(np.bincount(ranks, minlength=64))
            rank = int(np.argmax(left <= most)) + 1
        kept = ranks >= rank
        ends, ranks = ends[kept], ranks[kept]
        hashes = np.concatenate([upto[kept], np.array([whole], np.uint64)])
        return cls(np.append(ends, len(text)).astype(np.int64), hashes, np.append(ranks, 63).astype(np.uint8), rank)

    def text(self) -> str:
        """As one line: its rank and, place by place, distance to the last place, rank and both hashes."""
        table = np.zeros(len(self.places), dtype=[("step", "<u4"), ("rank", "u1"), ("a", "<u4"), ("b", "<u4")])
        table["step"], table["rank"] = np.diff(self.places, prepend=0), self.ranks
        table["a"], table["b"] = self.hashes[:, 0], self.hashes[:, 1]
        return f"{self.rank}:{base64.b64encode(table.tobytes()).decode()}"

    @classmethod
    def read(cls, line: str) -> Fingerprint:
        rank, body = line.split(":", 1)
        table = np.frombuffer(base64.b64decode(body), dtype=[("step", "<u4"), ("rank", "u1"), ("a", "<u4"), ("b", "<u4")])
        hashes = np.stack([table["a"], table["b"]], 1).astype(np.uint64)
        return cls(np.cumsum(table["step"], dtype=np.int64), hashes, table["rank"], int(rank))

    @cached_property
    def length(self) -> int:
        return int(self.places[-1])

    def letters(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Length and hash of every span between neighbouring places of at least this rank."""
        if rank not in self._letters:
            kept = self.ranks >= rank
            places, hashes = self.places[kept], self.hashes[kept]
            size = places.copy()
            size[1:] -= places[:-1]
            out = []
            for which, p in enumerate(PRIMES):
                shift = _powers(SEGMENT, which)[0][np.minimum(size, SEGMENT)]
                for k in np.flatnonzero(size > SEGMENT):
                    shift[k] = pow(BASES[which], int(size[k]), p)
                own = hashes[:, which].copy()
                own[1:] += np.uint64(p) - hashes[:-1, which] * shift[1:] % np.uint64(p)
                out.append(own % np.uint64(p))
            self._letters[rank] = size, out[0] << np.uint64(31) | out[1]
        return self._letters[rank]


def likeness(one: Fingerprint, two: Fingerprint) -> float:
    """Code points in common runs of both texts, over the code points of both."""
    if one.length + two.length == 0 or (one.length == two.length and np.array_equal(one.hashes[-1], two.hashes[-1])):
        return 1.0
    rank = max(one.rank, two.rank)
    (size, letter), (size_two, letter_two) = one.letters(rank), two.letters(rank)
    keys, keys_two = list(zip(size.tolist(), letter.tolist())), list(zip(size_two.tolist(), letter_two.tolist()))
    if set(keys).isdisjoint(keys_two):
        return 0.0
    found: dict[tuple[int, int], list[int]] = {}
    for j, key in enumerate(keys_two):
        found.setdefault(key, []).append(j)
    names = {key: i for i, key in enumerate(dict.fromkeys(keys + keys_two))}
    here, there = (Prefixes(np.array([names[k] for k in own])) for own in (keys, keys_two))
    runs = []
    for i, key in enumerate(keys):
        for j in found.get(key, ()):
            if not (i and j and keys[i - 1] == keys_two[j - 1]):
                runs.append((here.extension(i, there, j), i, j))
    used, used_two, common = np.zeros(len(size), bool), np.zeros(len(size_two), bool), 0
    for run, i, j in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
        free = ~(used[i : i + run] | used_two[j : j + run])
        used[i : i + run] |= free
        used_two[j : j + run] |= free
        common += int(size[i : i + run][free].sum())
    return 2 * common / (one.length + two.length)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [Fingerprint.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([p.length for p in prints], pa.int64()), pa.array([p.text() for p in prints], pa.string()),
            ], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, n_chars bigint, fingerprint string")


# --- each text beside the next one --------------------------------------------------------------

EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Ranges:
    """Ranges of (doc_id, text hash), each of about ``RANGE_BYTES`` of text; a doc_id of many rows is split by the hash."""

    def __init__(self, keyed: DataFrame):
        total, rows = keyed.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.count("*")).first()
        ranges = max(1, min(math.ceil((total or 0) / RANGE_BYTES), rows, MOST_RANGES))
        at = [(i + 1) / ranges for i in range(ranges - 1)]
        ids = keyed.agg(F.percentile_approx("id", F.array(*[F.lit(x) for x in at]), F.lit(max(10_000, 20 * ranges)))).first()[0] if at and rows else []
        bounds, own = [], np.array(ids, np.int64)
        for value, n in zip(*np.unique(own, return_counts=True)):
            bounds += [(int(value), LOWEST + ((j + 1) << 64) // int(n + 1)) for j in range(int(n))] if n > 1 else [(int(value), LOWEST)]
        self.ids = np.array([b[0] for b in bounds], np.int64)
        self.cuts = np.array([b[1] for b in bounds], np.int64)
        # The first row of every range, in the order of the search: the one after the last of the range before.
        self.heads: dict[tuple[int, int], list[int]] = {}
        self.heads = self._heads(keyed)

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of bounds at or below each key, counted from the highest id down."""
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        place = high.copy()
        for k in np.flatnonzero(high > low):
            place[k] = low[k] + np.searchsorted(self.cuts[low[k] : high[k]], hashes[k], "right")
        return (len(self.ids) - place).astype(np.int32)

    def column(self, which: str) -> Column:
        ranges = self

        @F.arrow_udf("int")
        def own(ids: pa.Array, hashes: pa.Array) -> pa.Array:
            return pa.array(ranges.of(ids.to_numpy(), hashes.to_numpy()), pa.int32())

        @F.arrow_udf("array<int>")
        def guest(ids: pa.Array, hashes: pa.Array) -> pa.Array:
            return pa.array([ranges.heads.get(key, []) for key in zip(ids.to_pylist(), hashes.to_pylist())], pa.list_(pa.int32()))

        return (own if which == "own" else guest)("id", "hash")

    def _heads(self, keyed: DataFrame) -> dict[tuple[int, int], list[int]]:
        first = F.max(F.struct("id", "hash"))
        rows = keyed.withColumn("part", self.column("own")).groupBy("part").agg(first.alias("key")).orderBy("part").collect()
        out: dict[tuple[int, int], list[int]] = {}
        for k, row in enumerate(rows):
            out.setdefault((row["key"]["id"], row["key"]["hash"]), []).append(rows[k - 1]["part"])
        return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) of every own row; rows come by part, own rows in order and then the next range's head."""
    last = None
    for batch in batches:
        columns = [batch.column(c) for c in ("part", "guest", "doc_id", "text")]
        for part, guest, doc_id, text in zip(*columns):
            row = (part.as_py(), doc_id.as_py(), text.as_py() or "")
            if last is not None and last[0] == row[0]:
                yield last[1], last[2], row[2]
            last = None if guest.as_py() else row
            # A head that several rows share is needed once; the others find no row before them.


def edited(docs: DataFrame) -> DataFrame:
    """Every text beside an edited one, whose last half comes from the beginning of the next text, by descending doc_id.

    Rows are dealt into ranges of doc_id by their text bytes; each range also gets the row that follows its last
    one, so no text travels twice but one for each range. A task walks its rows in order and holds two texts.
    """
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"),
    )
    ranges = _Ranges(keyed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        known: tuple[str, Fingerprint] | None = None
        for doc_id, text, nxt in _pairs(batches):
            own = known[1] if known is not None and known[0] == text else Fingerprint.of(text)
            half = len(text) // 2
            changed = text[: len(text) - half] + nxt[:half]
            after, change = Fingerprint.of(nxt), Fingerprint.of(changed)
            known = (nxt, after)
            rows.append((
                doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.text(), change.text(),
                likeness(own, change), likeness(own, after),
            ))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    places = F.explode(F.concat(
        F.array(F.struct(ranges.column("own").alias("part"), F.lit(False).alias("guest"))),
        F.transform(ranges.column("guest"), lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest"))),
    ))
    dealt = keyed.select("doc_id", "text", "id", "hash", places.alias("at")).select("doc_id", "text", "id", "hash", "at.part", "at.guest")
    return (
        dealt.repartitionById(len(ranges.ids) + 1, "part").sortWithinPartitions("part", "guest", F.desc("id"), F.desc("hash"))
        .select("part", "guest", "doc_id", "text").mapInArrow(work, EDITED)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))
