"""Book documents: one JSON text per spread, and the flat placements table behind them.

A book is a dataset of spread documents plus a templates table, so no task holds a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0"
PAGE = "struct<template:string,title:string,intentional_hero:boolean,cells:array<variant>,fits:array<string>>"
SPREAD = f"id string, chapter string, kind string, `left` {PAGE}, `right` {PAGE}"


def _get(cell: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(cell, path, kind)


def normalize_cell(cell: Column, fallback_id: Column) -> Column:
    """Struct of a cell given as null, an id text or an object.

    Blank captions and incomplete crops read as absent, as does an override without a number; a
    missing cell id becomes ``fallback_id``.
    """
    kind = F.schema_of_variant(cell)
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    asset = F.when(is_text, cell.try_cast("string")).when(is_object, _get(cell, "$.asset_id", "string"))
    edges = [_get(cell, f"$.crop.{e}", "double") for e in "xywh"]
    whole = is_object
    for e in edges:
        whole = whole & e.isNotNull()
    crop = F.when(whole, F.struct(*[v.alias(e) for v, e in zip(edges, "xywh")]))
    dpi = _get(cell, "$.dpi_override.dpi", "string")
    approved = is_object & dpi.isNotNull() & ~dpi.isin("", "0", "0.0", "false")
    override = F.when(
        approved,
        F.struct(
            _get(cell, "$.dpi_override.approved_by", "string").alias("approved_by"),
            dpi.alias("dpi"),
            _get(cell, "$.dpi_override.date", "string").alias("date"),
        ),
    )
    caption_kind = F.schema_of_variant(F.try_variant_get(cell, "$.caption", "variant"))
    caption = F.when(is_object & (caption_kind == "STRING"), _get(cell, "$.caption", "string"))
    return F.struct(
        F.coalesce(F.when(is_object, _get(cell, "$.id", "string")), fallback_id).alias("id"),
        F.nullif(asset, F.lit("")).alias("asset_id"),
        crop.alias("crop"),
        override.alias("dpi_override"),
        F.when(F.trim(caption) != "", caption).alias("caption"),
    )


def parse_spreads(documents: DataFrame) -> DataFrame:
    """spread (0-based), value (JSON text) to spread plus the parsed document."""
    return documents.select("spread", F.from_json("value", SPREAD).alias("d")).select("spread", "d.*")


def flatten_book(spreads: DataFrame) -> DataFrame:
    """One row per cell: spread, side, page_number, chapter, template, title, intentional_hero,
    cell, fit and the normalised cell fields."""
    page = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("p"))
    pages = spreads.select("spread", "chapter", F.explode(F.array(page("left"), page("right"))).alias("s")).select(
        "spread", "chapter", F.col("s.side").alias("side"),
        (F.col("spread") * 2 + F.when(F.col("s.side") == "left", 1).otherwise(2)).alias("page_number"),
        "s.p.*",
    )
    cells = pages.select(
        "spread", "chapter", "side", "page_number", "template", "title", "intentional_hero", "fits",
        F.posexplode("cells").alias("cell", "v"),
    )
    made_up = F.sha1(F.concat_ws("/", "spread", "side", "cell").cast("binary"))
    return cells.select(
        "spread", "chapter", "side", "page_number", "template", "title", "intentional_hero", "cell",
        F.get("fits", F.col("cell")).alias("fit"),
        normalize_cell(F.col("v"), made_up).alias("c"),
    ).select(
        "spread", "chapter", "side", "page_number", "template", "title", "intentional_hero", "cell", "fit",
        F.col("c.id").alias("cell_id"), "c.asset_id", "c.crop", "c.dpi_override", "c.caption",
    )


def nest_book(placements: DataFrame) -> DataFrame:
    """The reverse: (spread, value) with schema-2 cell objects. A spread holds a handful of cells."""
    fields = ("id", "asset_id", "crop", "dpi_override", "caption")
    row = placements.withColumn("id", F.col("cell_id")).select(
        "spread", "chapter", "side", "template", "title", "intentional_hero",
        F.struct("cell", F.struct(*fields).alias("c"), "fit").alias("e"),
    )
    page_keys = ["spread", "chapter", "side", "template"]
    pages = row.groupBy(*page_keys).agg(
        F.first("title").alias("title"), F.first("intentional_hero").alias("intentional_hero"),
        F.array_sort(F.collect_list("e")).alias("e"),
    ).select(
        "spread", "chapter", "side",
        F.struct("template", "title", "intentional_hero", F.col("e.c").alias("cells"), F.col("e.fit").alias("fits")).alias("p"),
    )
    first = lambda side: F.first(F.when(F.col("side") == side, F.col("p")), ignorenulls=True).alias(side)
    return pages.groupBy("spread", "chapter").agg(first("left"), first("right")).select(
        "spread",
        F.to_json(
            F.struct(
                F.sha1(F.concat(F.lit("spread/"), F.col("spread").cast("string")).cast("binary")).alias("id"),
                "chapter", "left", "right",
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )


def migrate_book(documents: DataFrame) -> DataFrame:
    """Spread documents in any accepted form to schema 2: ids everywhere, cells as objects.

    Ids are derived from the place, so a second run changes nothing.
    """
    return nest_book(flatten_book(parse_spreads(documents)))


def page_ids(placements: DataFrame) -> DataFrame:
    """Placed ids only, in book order columns."""
    return placements.where("asset_id IS NOT NULL").select("spread", "side", "cell", "asset_id")
