"""Sinks that hold whole results or nothing new: a failed write leaves the former content as it was."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import export
from gleaner.session import move_folder, remove_folder

MANIFEST = (
    "`order` long, chapter string, chapter_title string, file string, date string, source string, hero int, "
    "event string, tags string, res string, caption string"
)
# Quotes are doubled and line breaks kept inside quotes, so that every text comes back as it was.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def replace_folder(spark: SparkSession, folder: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside the target, then put it in the target's place; on an error delete it again."""
    beside = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    try:
        write(beside)
    except BaseException:
        remove_folder(spark, beside)
        raise
    former = f"{beside}-former"
    moved = move_folder(spark, folder, former)
    move_folder(spark, beside, folder)
    if moved:
        remove_folder(spark, former)


def write_manifest(rows: DataFrame, folder: str) -> None:
    """The manifest as CSV in global order: sorted ranges, so the part files follow one another."""
    ordered = rows.orderBy("order")
    replace_folder(rows.sparkSession, f"{folder}/manifest", lambda path: ordered.write.options(**CSV).csv(path))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows; empty fields are empty texts, as they were written."""
    rows = spark.read.schema(MANIFEST).options(**CSV, mode="FAILFAST").csv(f"{folder}/manifest")
    return rows.fillna("", subset=["event", "tags", "caption"])


def write_captions(rows: DataFrame, folder: str) -> None:
    """One line per captioned file. Line breaks inside a caption become spaces, or they would end the line."""
    lines = export.caption_lines(rows.withColumn("caption", F.regexp_replace("caption", r"[\r\n]+", " "))).orderBy("order").select("value")
    replace_folder(rows.sparkSession, f"{folder}/captions", lines.write.text)


def read_captions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(f"{folder}/captions")


def write_metrics(summary: DataFrame, folder: str, stage: str, run: str) -> None:
    """A stage's one-row summary as (metric, value) rows under its stage and run; the same run again replaces its own."""
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in summary.columns])
    rows = summary.select(F.inline(values)).withColumn("run_at", F.current_timestamp()).coalesce(1)
    replace_folder(summary.sparkSession, f"{folder}/stage={stage}/run={run}", rows.write.parquet)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("metric string, value double, run_at timestamp, stage string, run string").parquet(folder)
