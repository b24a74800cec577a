"""Export order, file names, source choice and the written manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.dates import date_prefix, synthetic_order_time
from gleaner.operators.numbering import number_rows

NO_CHAPTER = 999


def export_order(accepted: DataFrame, chapter_dim: DataFrame) -> DataFrame:
    """Adds chapter_no, chapter_title, index (0-based in the chapter) and order (global, 1-based).

    The global number is the index plus the sizes of the earlier chapters; rows whose file turns out
    to be missing keep their number.
    """
    rows = accepted.join(chapter_dim.select("chapter", "title", "chapter_no"), "chapter", "left").withColumns(
        {
            "chapter_no": F.coalesce("chapter_no", F.lit(NO_CHAPTER)),
            "chapter_title": F.coalesce("title", "chapter"),
            "_date": F.coalesce("best_datetime", F.lit("")),
        }
    ).drop("title")
    numbered = number_rows(rows, ["_date", "asset_id"], "_no", ("chapter_no", "chapter"))
    sizes = numbered.groupBy("chapter_no", "chapter").agg(F.count("*").alias("_n"))
    w = Window.orderBy("chapter_no", "chapter").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(  # one row per chapter
        "chapter_no", F.col("chapter").alias("_chapter"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start")
    )
    joined = numbered.join(
        starts,
        (numbered.chapter_no == starts.chapter_no) & numbered.chapter.eqNullSafe(F.col("_chapter")),
    ).drop(starts.chapter_no)
    return joined.withColumns(
        {"index": F.col("_no") - 1, "order": F.col("_start") + F.col("_no")}
    ).drop("_no", "_start", "_chapter", "_date")


def export_extension(staged: Column, zip_entry: Column, orig_path: Column) -> Column:
    filled = lambda p: F.when(F.coalesce(p, F.lit("")) != "", text.extension(p))
    return F.coalesce(filled(staged), filled(zip_entry), filled(orig_path), F.lit(".jpg"))


def best_source(assets: DataFrame, files: DataFrame, archive: DataFrame) -> DataFrame:
    """Adds source_path and source_kind: the staged file, else an archive entry whose bytes hash to
    the id, else the reduced derivative, else NULL.

    files: path. archive: zip_source, zip_entry, sha1. Several entries may share a name, as camera counters do: the one
    with the asset's bytes counts, and an asset stays one row.
    """
    here = files.select("path").distinct()
    staged = here.select(F.col("path").alias("staged_original_path"), F.lit(True).alias("_staged"))
    derived = here.select(F.col("path").alias("derivative_path"), F.lit(True).alias("_derived"))
    entries = archive.select("zip_source", "zip_entry", F.col("sha1").alias("asset_id"), F.lit(True).alias("_zipped")).distinct()
    option = lambda ok, path, kind: F.when(ok, F.struct(path.alias("path"), F.lit(kind).alias("kind")))
    chosen = F.coalesce(
        option(F.col("_staged"), F.col("staged_original_path"), "original"),
        option(F.col("_zipped"), F.concat_ws("!", "zip_source", "zip_entry"), "original"),
        option(F.col("_derived"), F.col("derivative_path"), "derivative"),
    )
    return (
        assets.join(staged, "staged_original_path", "left")
        .join(derived, "derivative_path", "left")
        .join(entries, ["zip_source", "zip_entry", "asset_id"], "left")
        .withColumns({"source_path": chosen["path"], "source_kind": chosen["kind"]})
        .drop("_staged", "_derived", "_zipped")
    )


def manifest(ordered: DataFrame, label_names: bool = False) -> DataFrame:
    """The eleven manifest fields, in their fixed order, of rows that have a source.

    Input: export_order output with source_kind, ext and the asset columns.
    """
    ext = F.when(F.col("source_kind") == "derivative", ".jpg").otherwise(F.col("ext"))
    date = date_prefix(F.col("best_datetime"))
    plain = text.plain_filename(F.col("index"), date, F.col("asset_id"), ext)
    labelled = text.label_filename(
        F.col("chapter"), F.col("event"), F.col("tags"), F.col("index"), F.col("asset_id"), ext
    )
    number = F.lpad(F.col("chapter_no").cast("string"), 2, "0")
    folder = F.concat(F.when(F.col("chapter_no") > 99, F.col("chapter_no").cast("string")).otherwise(number), F.lit("_"), "chapter")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return ordered.where("source_kind IS NOT NULL").select(
        F.col("order"),
        "chapter",
        "chapter_title",
        F.concat(folder, F.lit("/"), labelled if label_names else plain).alias("file"),
        date.alias("date"),
        F.col("src").alias("source"),
        F.coalesce(F.col("is_hero").cast("int"), F.lit(0)).alias("hero"),
        blank("event").alias("event"),
        blank("tags").alias("tags"),
        F.when(F.col("source_kind") == "original", "full").otherwise("reduced-2560").alias("res"),
        blank("caption").alias("caption"),
    )


def caption_lines(rows: DataFrame) -> DataFrame:
    return rows.where("caption <> ''").select("order", F.concat_ws("\t", "file", "caption").alias("value"))


def order_stamps(ordered: DataFrame) -> DataFrame:
    """(asset_id, stamp): an artificial time that makes a date sort reproduce the order."""
    return ordered.select(
        "asset_id", synthetic_order_time(F.col("chapter_no"), F.col("index")).alias("stamp")
    )
