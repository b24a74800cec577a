"""Toxicity by weak supervision.

Voters: a lexicon of words, word beginnings of 5, 7 and 9 bytes (patterns that catch inflected and compounded
forms) and counts of hits. Lexicon and beginnings are counted over at most about LEXICON_ROWS labelled rows, half of them for
each class (all labelled rows up to that number): those in at least LEAST_ROWS
toxic rows of which at least the share PRECISE of their rows is toxic. The OWN_VOTERS commonest are a voter each; the
others share a voter with those in about as many toxic rows, so that all vote and the voters stay few. A voter fires or
not. On a bounded sample (SAMPLE_ROWS) a generative model with the
true class hidden estimates by expectation maximisation how often each voter fires in either class;
voters whose firings correlate beyond what the class explains share their weight. A linear classifier is
then trained on the posterior labels, and it alone scores the documents.

Defined results: null and empty texts fire no voter and get the lowest score; without labelled toxic rows
every score is the classifier's prior; repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel, labelled

SAMPLE_ROWS = 8000
LEXICON_ROWS = 200_000
LEAST_ROWS = 3
PRECISE = 0.85
OWN_VOTERS = 400
BEGINNINGS = (5, 7, 9)
HITS = (1, 2, 4)
ROUNDS = 50


def _marks(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark) of every word and word beginning; a mark is a hash that tells the two apart."""
    words = kernel.find_words(texts, between=kernel.SIGNS)
    owner = words.owner()
    owners, marks = [owner], [words.hashes()]
    for n in BEGINNINGS:
        longer = words.ends - words.starts > n
        starts = words.starts[longer]
        begun = kernel.Words(words.data, words.offsets, starts, starts + n, words.at)
        owners.append(owner[longer])
        marks.append(kernel.mix(begun.hashes() + np.uint64(1)))
    return np.concatenate(owners), np.concatenate(marks)


def share_voters(toxic: np.ndarray) -> np.ndarray:
    """The voter of each mark by its number of toxic rows: its own for the commonest, one for each power of two for the others."""
    order = np.argsort(-toxic, kind="stable")
    voter = np.empty(len(toxic), np.int64)
    voter[order] = np.arange(len(toxic))
    shared = order[OWN_VOTERS:]
    voter[shared] = OWN_VOTERS + np.unique(np.floor(np.log2(toxic[shared])), return_inverse=True)[1]
    return voter


def fired(texts: pa.Array | pa.ChunkedArray, lexicon: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """Which voters fire on each text: those of its lexicon marks, then one per number of distinct hits."""
    owner, mark = _marks(texts)
    own = int(voter.max(initial=-1)) + 1
    votes = np.zeros((len(texts), own + len(HITS)), np.float32)
    distinct = np.zeros(len(texts), np.int64)
    if len(lexicon) and len(mark):
        place = np.searchsorted(lexicon, mark)
        place[place == len(lexicon)] = 0
        hit = lexicon[place] == mark
        text, place = np.divmod(np.unique(owner[hit].astype(np.int64) * len(lexicon) + place[hit]), len(lexicon))
        votes[text, voter[place]] = 1
        distinct = np.bincount(text, minlength=len(texts))
    for k, n in enumerate(HITS):
        votes[:, own + k] = distinct >= n
    return votes


def label_model(votes: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden class for each row, and each voter's weight after sharing among correlated ones."""
    start = votes.any(1)
    post = np.where(start, 0.9, 0.02)
    weight = np.ones(votes.shape[1])
    for turn in range(ROUNDS):
        on, off = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        hit = (post @ votes + 0.5) / (on + 1)
        false = ((1 - post) @ votes + 0.5) / (off + 1)
        if turn % 10 == 5:
            rest = votes - np.outer(post, hit) - np.outer(1 - post, false)
            scale = np.sqrt((rest**2).mean(0)) + 1e-6
            corr = np.abs((rest.T @ rest) / len(votes) / np.outer(scale, scale))
            weight = 1 / np.maximum(1, np.where(corr > 0.3, corr, 0).sum(0))
        prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * np.log(hit / false)) + (1 - votes) @ (weight * np.log((1 - hit) / (1 - false)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, weight


def linear(votes: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.hstack([votes, np.ones((len(votes), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (target - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """The lexicon's marks in order, their voters and the classifier's weights."""

    def __init__(self, lexicon: np.ndarray, voter: np.ndarray, weights: np.ndarray):
        self.lexicon, self.voter, self.weights = lexicon, voter, weights

    def score(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        z = fired(texts, self.lexicon, self.voter) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lower(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.lower(F.col("text").cast("string")))


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS, lexicon_rows: int = LEXICON_ROWS) -> Model:
    """``rows`` bounds the sample of the label model and the classifier, ``lexicon_rows`` the rows of the lexicon's counts."""
    chosen = _lower(labelled.sample(docs, labels, label, rows, keep))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for a, b in kernel.blocks(batch, "text"):
                owner, mark = _marks(batch.column("text").slice(a, b - a))
                pair = np.unique(np.stack([mark, owner.astype(np.uint64)], 1), axis=0)
                own, place, n = np.unique(pair[:, 0], return_index=True, return_counts=True)
                toxic = np.add.reduceat(y[a + pair[:, 1].astype(np.int64)], place) if len(own) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n), pa.array(toxic, pa.float64())], ["mark", "n", "toxic"])

    share = F.col("toxic") / F.col("n")
    counted = _lower(labelled.by_class(docs, labels, label, lexicon_rows, keep)).mapInArrow(count, "mark bigint, n bigint, toxic double")
    found = (
        counted.groupBy("mark").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= LEAST_ROWS) & (share >= PRECISE)).select("mark", "toxic").toArrow()
    )
    lexicon, toxic = found.column("mark").to_numpy().view(np.uint64), found.column("toxic").to_numpy()
    order = np.argsort(lexicon)
    lexicon, voter = lexicon[order], share_voters(toxic[order])
    voters = int(voter.max(initial=-1)) + 1 + len(HITS)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                votes = fired(part.column("text"), lexicon, voter).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([v.tobytes() for v in votes], pa.binary())], ["doc_id", "y", "votes"])

    table = chosen.mapInArrow(vote, "doc_id bigint, y double, votes binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    votes = np.frombuffer(b"".join(table.column("votes").to_pylist()), np.uint8).reshape(-1, voters).astype(np.float64)
    if not len(votes) or not len(lexicon):
        base = float(np.mean(table.column("y").to_numpy())) if len(votes) else 0.0
        return Model(lexicon, voter, np.concatenate([np.zeros(voters), [np.log(max(base, 1e-4) / (1 - min(base, 0.9999)))]]))
    post, _ = label_model(votes, float(table.column("y").to_numpy().mean()))
    return Model(lexicon, voter, linear(votes, post))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")), pa.float64())], ["doc_id", "score"])

    texts = _lower(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return texts.mapInArrow(classify, "doc_id bigint, score double")
