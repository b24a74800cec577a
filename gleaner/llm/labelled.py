"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _labels(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(keep)
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(label).alias("y"))
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_class(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column) -> DataFrame:
    """(doc_id, text, y) of about ``rows`` labelled documents, half of them for each class (0.5 divides the classes).

    A class with fewer rows leaves its room to the other. The chosen ids are at most 1.2 * rows + 200 rows of 16 bytes, so
    they are broadcast and the texts are scanned once without a shuffle. Rows are chosen by the hash of doc_id.
    """
    own = _labels(labels, label, keep).withColumn("high", F.col("y") >= 0.5)
    n = {r["high"]: r["n"] for r in own.groupBy("high").agg(F.count("*").alias("n")).collect()}
    few = min(n.get(True, 0), n.get(False, 0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = None
    for high, total in n.items():
        wanted = max(rows // 2, rows - few)
        part = own.where((F.col("high") == high) & (place < min(1.0, wanted / max(total, 1)))).limit(int(1.2 * min(wanted, total)) + 100)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = own.limit(0)
    return _texts(docs).join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column) -> DataFrame:
    """(doc_id, text, y) of about ``rows`` labelled documents for which ``keep`` (over doc_id) holds.

    Rows are chosen by the hash of doc_id; several labels of one document are averaged. The chosen labels are
    at most 1.2 * rows + 100 rows, which bounds what is broadcast.
    """
    own = _labels(labels, label, keep)
    total = own.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.where(place < min(1.0, rows / max(total, 1))).limit(int(1.2 * rows) + 100)
    return _texts(docs).join(F.broadcast(chosen), "doc_id")
