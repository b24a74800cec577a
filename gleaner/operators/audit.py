"""Leak scan, export verification and damaged-source checks."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import hashing
from gleaner.functions.text import extension
from gleaner.session import workers_import

# Patterns and placeholders of the leak rules.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEX40 = r"\b[0-9a-f]{40}\b"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
HOME_PATH = r"(?i)(?:c:[/\\]+users[/\\]+|/home/|/users/)([a-z0-9_.-]+)"
PADDED_ID = "^0{30,}[0-9]+$"
OK_DOMAINS = ("example.com", "example.org", "example.net")
OK_USERS = ("you", "yourname", "username", "user", "name", "me")
DENIED_EXT = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".avif",
    ".raw", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2", ".pef", ".srw", ".mp4",
    ".mov", ".avi", ".mkv", ".m4v", ".3gp", ".webm", ".db", ".sqlite", ".sqlite3", ".zip", ".exe",
    ".dll", ".so", ".dylib", ".pdf", ".mp3", ".wav",
)
ATTRIBUTION_FILES = ("LICENSE", "NOTICE", "README.md")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@dataclass(frozen=True)
class Blocklist:
    names: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    known_dates: tuple[str, ...] = ()
    # False: a character between two names bounds one of them only, as in a pattern without lookaround.
    shared_bounds: bool = True


def _hits(rule: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match")))


# A blocklist travels with the job's code and has an automaton in each Python worker, some 100 bytes a character.
BLOCKLIST_CHARS = 2_000_000
LETTERS = frozenset(string.ascii_letters)
FOLD = {ord(upper): lower for upper, lower in zip(string.ascii_uppercase, string.ascii_lowercase)}


def _automaton(words: Sequence[str]) -> ahocorasick.Automaton | None:
    """One automaton over all words; each names its length and its places in the list."""
    places: dict[str, list[int]] = {}
    for place, word in enumerate(words):
        if word:
            places.setdefault(word, []).append(place)
    if not places:
        return None
    found = ahocorasick.Automaton()
    for word, at in places.items():
        found.add_word(word, (len(word), at))
    found.make_automaton()
    return found


def _leftmost(automaton, line: str, whole_words: bool, shared_bounds: bool = True) -> Iterator[tuple[int, int]]:
    """(start, end) from left to right without overlaps; of words that start together the first in the list counts.

    Without ``shared_bounds`` a match takes the characters beside it too, so they bound no further match.
    """
    fits = []
    for last, (length, at) in automaton.iter(line):
        start, end = last + 1 - length, last + 1
        if not whole_words or not (line[start - 1 : start] in LETTERS or line[end : end + 1] in LETTERS):
            fits.append((start, at[0], end))
    free, beside = 0, int(whole_words and not shared_bounds)
    for start, _, end in sorted(fits):
        if max(0, start - beside) >= free:
            free = end + beside
            yield start, end


def _listed(blocklist: Blocklist):
    """Column function: (rule, match) hits of a line for the whole blocklist, in one pass per kind of token."""

    @F.pandas_udf("array<struct<rule:string,match:string>>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings = _automaton([t.lower() for t in blocklist.strings])
        names = _automaton([t.translate(FOLD) for t in blocklist.names])
        dates = _automaton(blocklist.dates)

        def hits(line: str) -> list[dict[str, str]]:
            out = []
            if strings:
                seen = {place for _, (_, at) in strings.iter(line.lower()) for place in at}
                out += [("STRING", blocklist.strings[place]) for place in sorted(seen)]
            if names:
                out += [("NAME", line[a:b]) for a, b in _leftmost(names, line.translate(FOLD), True, blocklist.shared_bounds)]
            if dates:
                out += [("PERSONAL_DATE", line[a:b]) for a, b in _leftmost(dates, line, False)]
            return [{"rule": rule, "match": match} for rule, match in out]

        for lines in batches:
            yield lines.map(hits)

    return listed


def leak_scan(texts: DataFrame, blocklist: Blocklist = Blocklist()) -> DataFrame:
    """path, line, rule, match for every hit in every line of every whole text.

    Input: path, text. One pass without a shuffle. The blocklist is one automaton per kind of token, so a line costs the
    same with ten tokens as with ten thousand; empty tokens are ignored, and a list over ``BLOCKLIST_CHARS`` is refused.
    Names match as whole words, ASCII letters in any case. Rule DATE is advisory, all others fail. Denied extensions and
    texts with a NUL byte report once.
    """
    tokens = (*blocklist.names, *blocklist.strings, *blocklist.dates)
    if sum(map(len, tokens)) > BLOCKLIST_CHARS:
        raise ValueError(f"the blocklist has more than {BLOCKLIST_CHARS} characters; scan with parts of it")
    denied = extension(F.col("path")).isin(*DENIED_EXT)
    binary = F.contains(F.col("text"), F.lit("\0"))
    whole = texts.select(
        "path",
        F.when(denied, F.struct(F.lit("EXTENSION").alias("rule"), extension(F.col("path")).alias("match")))
        .when(binary, F.struct(F.lit("BINARY").alias("rule"), F.lit("NUL").alias("match")))
        .alias("h"),
    ).where("h IS NOT NULL").select("path", F.lit(0).cast("bigint").alias("line"), "h.*")
    lines = texts.where(~denied & ~binary).select(
        "path", F.posexplode(F.split("text", LINE_BREAK, -1)).alias("at", "s")
    ).where("s <> ''")
    s, low = F.col("s"), F.lower("s")
    none = F.array().cast("array<string>")
    # A plain substring test first: most lines never reach the patterns.
    every = lambda pattern, group=0, hint=None: (
        F.regexp_extract_all(s, F.lit(pattern), F.lit(group)) if hint is None
        else F.when(hint, F.regexp_extract_all(s, F.lit(pattern), F.lit(group))).otherwise(none)
    )
    path_like = low.contains("/home/") | low.contains("/users/") | (low.contains("c:") & low.contains("users"))
    rules = [
        _hits("EMAIL", F.filter(every(EMAIL, hint=s.contains("@")), lambda m: ~F.lower(m).rlike(f"({'|'.join(d.replace('.', '[.]') for d in OK_DOMAINS)})$"))),
        _hits("ID", F.filter(every(HEX40, hint=s.rlike("[0-9a-f]{40}")), lambda m: ~m.rlike(PADDED_ID))),
        _hits("HOME", F.filter(every(HOME_PATH, 0, path_like), lambda m: ~F.rtrim(F.lower(F.regexp_extract(m, HOME_PATH, 1)), F.lit(".")).isin(*OK_USERS))),
    ]
    advisory = F.filter(every(ISO_DATE, hint=s.rlike("[0-9]-[0-9]{2}-[0-9]")), lambda m: ~m.isin(*blocklist.known_dates, *blocklist.dates, ""))
    rules.append(_hits("DATE", advisory))
    if any(tokens):
        workers_import(texts.sparkSession)
        credit = F.col("path").isin(*ATTRIBUTION_FILES) & low.contains("copyright")
        rules.append(F.filter("listed", lambda h: (h["rule"] != "NAME") | ~credit))
        lines = lines.withColumn("listed", _listed(blocklist)("s"))
    found = lines.select("path", (F.col("at") + 1).cast("bigint").alias("line"), F.inline(F.concat(*rules)))
    return whole.unionByName(found)


def leak_verdict(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count_if(F.col("rule") != "DATE").alias("hits"),
        F.count_if(F.col("rule") == "DATE").alias("advisories"),
    ).withColumn("clean", F.col("hits") == 0)


def match_by_prefix(exported: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds asset_id to exported files by the id prefix that ends their name; the smallest id wins.

    exported: file (path below the export folder).
    """
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    short = accepted.groupBy(F.substring("asset_id", 1, 8).alias("id8")).agg(F.min("asset_id").alias("asset_id"))
    return exported.withColumn("id8", F.regexp_extract(stem, r"([^_]*)$", 1)).join(short, "id8", "left").drop("id8")


def match_copies(exported: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds asset_id to exported files. Where ids share the prefix (some in every 100,000 ids), the one that the file's bytes
    hash to, else one with the date in the name, else the smallest.

    exported: file, sha1. accepted: asset_id and, if known, date.
    """
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    date = F.col("date") if "date" in accepted.columns else F.lit(None).cast("string")
    ids = accepted.groupBy(F.substring("asset_id", 1, 8).alias("id8")).agg(F.collect_set(F.struct("asset_id", date.alias("date"))).alias("ids"))
    fit = lambda c: F.struct(
        (~F.col("sha1").eqNullSafe(c["asset_id"])).alias("other_bytes"),
        ~F.coalesce(F.contains(stem, F.concat(F.lit("_"), c["date"], F.lit("_"))), F.lit(False)), c["asset_id"].alias("asset_id"),
    )
    return exported.withColumn("id8", F.regexp_extract(stem, r"([^_]*)$", 1)).join(ids, "id8", "left").withColumn(
        "asset_id", F.array_min(F.transform("ids", fit))["asset_id"]
    ).drop("id8", "ids")


def unsorted_folders(exported: DataFrame) -> DataFrame:
    """Folders where a name sort breaks the order of the number prefixes.

    Names sort by their prefix unless one prefix starts with another one of the folder, so it is
    enough to look each prefix's own beginnings up.
    """
    parts = exported.select(
        F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("file", r"([^/_]*)[^/]*$", 1).alias("prefix"),
    ).distinct()
    shorter = parts.where(F.length("prefix") > 1).select(
        "folder",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix") - 1), lambda n: F.substr("prefix", F.lit(1), n))).alias("prefix"),
    )
    return shorter.join(parts, ["folder", "prefix"], "left_semi").select("folder").distinct()


def verify_export(accepted: DataFrame, exported: DataFrame, manifest: DataFrame, has_proof: bool) -> DataFrame:
    """(check, passed, detail): the export audit.

    accepted: asset_id, derivative_edge, staged_sha1 (NULL without a staged file), date if known.
    exported: file, long_edge, sha1. manifest: one row per manifest line.
    """
    matched = match_copies(exported, accepted)
    known = matched.where("asset_id IS NOT NULL")
    one = lambda df, c="n": df.agg(F.count("*").alias(c))
    sides = one(exported, "e").unionByName(one(accepted, "a"), allowMissingColumns=True).unionByName(
        one(manifest, "m"), allowMissingColumns=True
    )
    counts = (
        sides.agg(*[F.max(c).alias(c) for c in "eam"])
        .select(
            F.lit("counts").alias("check"),
            ((F.col("e") == F.col("a")) & (F.col("a") == F.col("m"))).alias("passed"),
            F.format_string("exported=%d accepted=%d manifest=%d", "e", "a", "m").alias("detail"),
        )
    )
    small = known.join(accepted.select("asset_id", "derivative_edge"), "asset_id").agg(
        F.count_if(F.col("long_edge") < F.col("derivative_edge")).alias("n")
    )
    copies = known.groupBy("asset_id").agg(F.max("sha1").alias("shipped_sha1"))
    content = accepted.join(copies, "asset_id", "left").agg(
        F.count_if(~F.coalesce(F.coalesce("staged_sha1", "shipped_sha1") == F.col("asset_id"), F.lit(False))).alias("n")
    )

    def row(df: DataFrame, name: str, what: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.format_string(f"%d {what}", "n").alias("detail")
        )

    proof = accepted.sparkSession.range(1).select(
        F.lit("proof").alias("check"), F.lit(has_proof).alias("passed"), F.lit("found" if has_proof else "missing").alias("detail")
    )
    return (
        counts.unionByName(row(small, "dimensions", "smaller than the derivative"))
        .unionByName(row(one(unsorted_folders(exported)), "ordering", "unsorted folders"))
        .unionByName(proof)
        .unionByName(row(content, "content", "bad"))
    )


# Below these a signal is taken for damaged.
MEAN_MIN = 14.0
STDDEV_MIN = 3.0


def clean_sources(candidates: DataFrame) -> DataFrame:
    """asset_id, source, long_edge: the largest undamaged source of each asset.

    candidates: asset_id, source, long_edge, signal (array). Assets without one are left out.
    """
    signal = F.col("signal")
    good = (hashing.mean_level(signal) >= MEAN_MIN) & (hashing.level_stddev(signal) >= STDDEV_MIN)
    best = candidates.where(good).groupBy("asset_id").agg(
        F.max_by(F.struct("source", "long_edge"), F.struct("long_edge", "source")).alias("b")
    )
    return best.select("asset_id", "b.source", "b.long_edge")
