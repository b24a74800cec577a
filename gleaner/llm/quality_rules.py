"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a test that a text can fail. The cascade measures each rule on a sample of at most
``SAMPLE_ROWS`` rows, how long it takes and how many rows it rejects, and tests the rules in order of
rejections per second. Tests are nested conditions, so the first failure ends a row's work. The order
changes the cost and the rule named as the first failure, never the verdict.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return.
Defined results: null and empty texts have no words and fail ``few_words``.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 500
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    return _with_repeats(_cheap_base(docs, text))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words in place of ``_words``."""
    third = docs.withColumn("_windows", window_hashes(F.col("_words"), F.col("n_words")))
    return third.withColumn("n_repeat_words", repeat_words(F.col("_windows"))).drop("_words", "_windows")


def _cheap_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """The base measures but for the repeated windows, and the words themselves as ``_words``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    kept = list(docs.columns)
    first = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines)
    return first.select(
        *kept, "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )


def window_hashes(words: Column, n_words: Column) -> Column:
    """The hash of every five-word window, in order."""
    starts = F.when(n_words >= WINDOW, F.sequence(F.lit(0), (n_words - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a five-word window found at least twice in the text.

    Most texts have no such window, which a hash set tells. In the others windows are sorted by hash, so
    equal ones are neighbours: n log n for a text of n words.
    """
    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def found(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda i: (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"])
        return F.when(F.size(s) < 2, F.array().cast("array<int>")).otherwise(
            F.array_sort(F.transform(F.filter(places, lambda i: F.coalesce(same(i), F.lit(False))), lambda i: F.get(s, i)["i"]))
        )

    # transform over a one-element array binds each stage once
    at = F.transform(F.transform(F.array(F.array_sort(windows)), found), lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["upto"], i)).alias("n"), (i + WINDOW).alias("upto")),
        lambda a: a["n"],
    ))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), at[0]).otherwise(0).cast("bigint")


def default_rules() -> dict[str, Column]:
    """Rules over the base columns and the text; a rule is true for a row that fails it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    capital = F.size(F.filter(words_of(F.col("text")), lambda w: ~w.rlike("\\p{Ll}") & w.rlike("\\p{Lu}")))
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "many_symbols": 10 * F.col("n_symbols") > 3 * n,
        "long_words": F.col("word_chars") > 25 * n,
        "short_words": F.col("word_chars") < 2 * n,
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.size(F.split(text, "\n"))),
        "shouting": 2 * capital > n,
    }


def order_rules(docs: DataFrame, rules: Mapping[str, Column], base: DataFrame | None = None) -> list[str]:
    """Names by rejections per second on the sample, best first; ties keep the given order.

    A rule's cost is the time of a job that tests it, beyond that of one that reads the same rows and tests nothing.
    """
    sample = docs.limit(SAMPLE_ROWS)
    names = list(rules)
    rejected = sample.agg(F.count("*").alias("rows"), *[F.count_if(rules[n]).alias(n) for n in names]).first()

    def timed(test: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.count_if(test)).first()
        return time.perf_counter() - start

    empty = timed(F.col("n_words") < 0) if "n_words" in docs.columns else 0.0
    score = {name: rejected[name] / max(timed(rules[name]) - empty, 1e-3) for name in names}
    return sorted(names, key=lambda n: -score[n])


def cascade(docs: DataFrame, rules: Mapping[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds ``failed``: the first rule of the cascade that the row fails, null for rows that pass all.

    ``docs`` has the columns that the rules read, for the default rules those of ``with_base``.
    """
    rules = default_rules() if rules is None else rules
    verdict = F.lit(None).cast("string")
    for name in reversed(order or order_rules(docs, rules)):
        verdict = F.when(F.coalesce(rules[name], F.lit(False)), F.lit(name)).otherwise(verdict)
    return docs.withColumn("failed", verdict)


def keep_good(docs: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows that pass all rules, with their columns as they are.

    Repeated windows, the dearest measure, are looked for only in rows that pass the rules before that rule's turn.
    """
    rules = default_rules() if rules is None else rules
    rows = docs.select(F.struct("*").alias("_row"), "text")
    order = order_rules(with_base(rows), rules)
    turn = order.index("repeated_windows") if "repeated_windows" in order else 0
    first = _passing(_cheap_base(rows), rules, order[:turn]) if turn else _cheap_base(rows)
    return _passing(_with_repeats(first), rules, order[turn:]).select("_row.*")


def _passing(rows: DataFrame, rules: Mapping[str, Column], order: list[str]) -> DataFrame:
    """The row number keeps the filter above the measures: pushed below, it would repeat them for every word."""
    numbered = rows.withColumn("_row_no", F.monotonically_increasing_id())
    return cascade(numbered, rules, order).where("failed IS NULL AND _row_no >= 0").drop("failed", "_row_no")
