"""Facets, placement index and catalogue filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.dates import month_key
from gleaner.functions.text import split_tags


def count_where(assets: DataFrame, condition: str | None = None) -> DataFrame:
    return (assets.where(condition) if condition else assets).agg(F.count("*").alias("n"))


def uses_index(placements: DataFrame) -> DataFrame:
    """asset_id, spread, side, cell, n_uses: one row per use, so no asset's uses are collected."""
    counts = placements.groupBy("asset_id").agg(F.count("*").alias("n_uses"))
    return placements.select("asset_id", "spread", "side", "cell").join(counts, "asset_id")


def duplicates(placements: DataFrame) -> DataFrame:
    """Assets placed more than once."""
    return placements.groupBy("asset_id").agg(F.count("*").alias("n_uses")).where("n_uses > 1")


def with_placed(assets: DataFrame, placements: DataFrame) -> DataFrame:
    """Adds placed and n_uses."""
    counts = placements.groupBy("asset_id").agg(F.count("*").alias("n_uses"))
    return assets.join(counts, "asset_id", "left").withColumns(
        {"placed": F.col("n_uses").isNotNull(), "n_uses": F.coalesce("n_uses", F.lit(0))}
    )


def facets(assets: DataFrame) -> DataFrame:
    """(facet, value, n) over one pass: era, event, tag and month values with their row counts."""
    pairs = F.array(
        F.struct(F.lit("era").alias("facet"), F.nullif("chapter", F.lit("")).alias("value")),
        F.struct(F.lit("event").alias("facet"), F.nullif("event", F.lit("")).alias("value")),
        F.struct(F.lit("month").alias("facet"), month_key(F.col("best_datetime")).alias("value")),
    )
    tags = F.transform(
        split_tags(F.col("tags")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))
    )
    return (
        assets.select(F.inline(F.concat(pairs, tags)))
        .where("value IS NOT NULL")
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )


def facet_totals(assets: DataFrame, placements: DataFrame) -> DataFrame:
    return with_placed(assets, placements).agg(
        F.count("*").alias("n"),
        F.count_if("placed").alias("placed_count"),
        F.count_if("favorited").alias("favorited"),
    )


def facet_filter(
    assets: DataFrame,
    placements: DataFrame,
    *,
    favorited: bool = False,
    usage: str | None = None,
    era: str | None = None,
    event: str | None = None,
    tag: str | None = None,
    month: str | None = None,
) -> DataFrame:
    """All given conditions at once. Column filters come first, so they reach the scan."""
    rows = assets
    if favorited:
        rows = rows.where("favorited")
    if era:
        rows = rows.where(F.col("chapter") == era)
    if event:
        rows = rows.where(F.col("event") == event)
    if month:
        rows = rows.where(month_key(F.col("best_datetime")) == month)
    if tag:
        rows = rows.where(F.array_contains(split_tags(F.col("tags")), tag))
    if usage:
        kind = {"used": "left_semi", "unused": "left_anti"}[usage]
        rows = rows.join(placements.select("asset_id"), "asset_id", kind)
    return rows


def theme_filter(assets: DataFrame, theme: str | None = None, untagged: bool = False) -> DataFrame:
    tags = split_tags(F.col("tags"))
    if untagged:
        return assets.where(F.size(tags) == 0)
    return assets.where(F.array_contains(tags, theme)) if theme else assets


def theme_tally(assets: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per theme, for all rows ('*') and for rows without a tag (''): shown, keep, cut."""
    cut = cuts.select("asset_id").distinct().withColumn("_cut", F.lit(True))
    tags = split_tags(F.col("tags"))
    themes = F.concat(F.array(F.lit("*")), F.when(F.size(tags) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(tags)))
    return (
        assets.join(cut, "asset_id", "left")
        .select(F.explode(themes).alias("theme"), F.coalesce("_cut", F.lit(False)).alias("cut"))
        .groupBy("theme")
        .agg(F.count("*").alias("shown"), F.count_if(~F.col("cut")).alias("keep"), F.count_if("cut").alias("cut"))
    )


def capped(df: DataFrame, order: list, shown: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of a list for a report, and how many more there are."""
    rest = df.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(shown), rest
