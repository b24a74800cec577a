"""Chapters: contiguous date windows and the assignment of rows to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import Chapter
from gleaner.functions.dates import wall_date
from gleaner.session import dimension


def chapter_dim(spark: SparkSession, chapters: Sequence[Chapter]) -> DataFrame:
    rows = [(c.id, c.label, c.start, c.end, i + 1) for i, c in enumerate(chapters)]
    return dimension(
        spark, rows, "chapter string, title string, start_text string, end_text string, chapter_no int"
    ).withColumns({"start": F.col("start_text").cast("date"), "end": F.col("end_text").cast("date")}).drop(
        "start_text", "end_text"
    )


def contiguity_problems(dim: DataFrame) -> DataFrame:
    """(chapter, problem, expected_start) of a chapter, start, end dimension; no rows means valid."""
    w = Window.orderBy("start")  # a configuration table: a few rows
    seen = dim.withColumn("prev_end", F.lag("end").over(w))
    expected = F.date_add("prev_end", 1)
    kind = (
        F.when(F.col("start") <= F.col("prev_end"), "overlap")
        .when(F.col("start") != expected, "gap")
    )
    problems = F.array_compact(F.array(F.when(F.col("end") < F.col("start"), "reversed"), kind))
    return seen.select("chapter", F.explode(problems).alias("problem"), expected.alias("expected_start"))


def require_contiguous(spark: SparkSession, chapters: Sequence[Chapter]) -> None:
    """Raise before any job over the rows starts; the dimension has a row per chapter."""
    if not chapters:
        raise ValueError("no chapters defined")
    found = contiguity_problems(chapter_dim(spark, chapters)).collect()
    if found:
        raise ValueError("chapters are not contiguous: " + "; ".join(f"{r['chapter']}: {r['problem']}" for r in found))


def assign(assets: DataFrame, chapters: Sequence[Chapter]) -> DataFrame:
    """Adds chapter and clamped ('low', 'high' or NULL). One expression, no join.

    Dates outside the chapters go to the nearest end; rows without a date to the last chapter.
    """
    require_contiguous(assets.sparkSession, chapters)
    day = F.coalesce(wall_date(F.col("best_datetime")), F.lit(chapters[-1].end).cast("date"))
    chapter: Column = F.lit(chapters[0].id)
    for c in chapters[1:]:
        chapter = F.when(F.col("_day") >= F.lit(c.start).cast("date"), F.lit(c.id)).otherwise(chapter)
    clamped = F.when(F.col("_day") < F.lit(chapters[0].start).cast("date"), "low").when(
        F.col("_day") > F.lit(chapters[-1].end).cast("date"), "high"
    )
    return assets.withColumn("_day", day).withColumns({"chapter": chapter, "clamped": clamped}).drop("_day")


def assignment_counts(assigned: DataFrame, dim: DataFrame) -> DataFrame:
    """Rows per chapter, chapters without rows included."""
    counts = assigned.groupBy("chapter").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("clamped") == "low").alias("clamped_low"),
        F.count_if(F.col("clamped") == "high").alias("clamped_high"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dim.select("chapter").join(counts, "chapter", "left").select(
        "chapter", zero("n"), zero("clamped_low"), zero("clamped_high")
    )
