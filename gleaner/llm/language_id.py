"""Language identification, word first with a back-off to character n-grams.

The model counts words and character n-grams per language on a bounded sample of rows with a language. A
known word adds its log frequency in each language. An unseen word is scored by the mean log frequency of its
known n-grams of the greatest length that has any, from MAX_GRAM characters down to one; word ends are part of the n-grams.
A text gets the language with the highest sum.

The sample is about SAMPLE_ROWS rows a language, chosen by the hash of doc_id, so it's the same at every
run. Words must occur LEAST_COUNT times in it to be known.

Defined results: a null text or one without a letter is ``und`` with score 0; words are runs of letters,
lower case; a tie goes to the first language by name; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
LEAST_COUNT = 3
MAX_GRAM = 5
MAX_LANGUAGES = 1000
MEMO = 200_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred string, score double"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies per language of known words and of n-grams by length."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        self.words = self._logs({k: {w: n for w, n in c.items() if n >= LEAST_COUNT} for k, c in counts.items()})
        self.grams = {}
        for n in range(1, MAX_GRAM + 1):
            by = {}
            for language, own in counts.items():
                by[language] = Counter()
                for w, k in own.items():
                    for g in grams(w, n):
                        by[language][g] += k
            self.grams[n] = self._logs(by)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)))

    def _logs(self, counts: dict[str, dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        """Places of the known strings and their log frequency in each language."""
        known = sorted(set().union(*counts.values())) if counts else []
        table = np.array([[counts[k].get(w, 0) + 0.5 for k in self.languages] for w in known]).reshape(len(known), len(self.languages))
        totals = np.array([sum(counts[k].values()) + 0.5 * len(known) + 1 for k in self.languages])
        return {w: i for i, w in enumerate(known)}, np.log(table / totals)

    def of_word(self, word: str) -> np.ndarray:
        place = self.words[0].get(word)
        if place is not None:
            return self.words[1][place]
        for n in range(min(MAX_GRAM, len(word) + 2), 0, -1):
            index, table = self.grams[n]
            hits = [i for i in map(index.get, grams(word, n)) if i is not None]
            if hits:
                return table[hits].mean(0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = words(text)
        if not self.languages or not any(c.isalpha() for w in own for c in w):
            return UNKNOWN, 0.0
        at = self.at
        if len(at) > MEMO:
            at.clear()
        for w in set(own).difference(at):
            if len(at) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(at)] = self.of_word(w)
            at[w] = len(at)
        total = self.rows[[at[w] for w in own]].sum(0)
        best = int(np.argmax(total))
        return self.languages[best], 1.0 / float(np.exp(np.minimum(total - total[best], 0)).sum())


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of doc_id, text, lang. A language's share of the sample is sample_rows over its rows."""
    rows = rows.where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; map the labels to fewer first")
    if not sizes:
        return Model({})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for language, n in sizes.items():
        wanted = wanted | ((F.col("lang") == language) & (place < sample_rows / n))
    sample = rows.where(wanted).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = {}
        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own.setdefault(language, Counter()).update(words(text.as_py()))
        for language, c in own.items():
            yield pa.RecordBatch.from_pydict({"lang": [language] * len(c), "word": list(c), "n": list(c.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counted = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    for r in counted.toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the posterior of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id bigint, {RESULT}")

