"""Small report tables and the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import base_name

LISTED = 50


def date_audit(assets: DataFrame) -> DataFrame:
    """(section, label, n): counts by source and confidence, the first low-confidence names, the rest."""
    sides = F.array(
        F.struct(F.lit("source").alias("section"), F.col("date_source").alias("label")),
        F.struct(F.lit("confidence").alias("section"), F.col("date_confidence").alias("label")),
    )
    counts = assets.select(F.inline(sides)).groupBy("section", "label").agg(F.count("*").alias("n"))
    low = assets.where("date_confidence = 'low'")
    names = low.select(base_name(F.col("orig_path")).alias("label"), "asset_id").orderBy("label", "asset_id").limit(LISTED)
    more = low.agg(F.greatest(F.count("*") - LISTED, F.lit(0)).alias("n"))
    return (
        counts.unionByName(names.select(F.lit("low").alias("section"), "label", F.lit(1).cast("bigint").alias("n")))
        .unionByName(more.select(F.lit("low").alias("section"), F.lit("more").alias("label"), "n"))
    )


def resolution_report(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: full and reduced sources, cells below 300 and 240 dpi, and one integrity sample.

    measured: placements with dpi. sources: asset_id, source_kind, sha1, upscaled.
    """
    flags = measured.agg(
        F.count_if(F.col("dpi") < 300).alias("dpi_flags"), F.count_if(F.col("dpi") < 240).alias("below_floor"),
        F.count_distinct("page_number").alias("page_count"),
    )
    checked = (F.col("source_kind") == "original") & ~F.coalesce("upscaled", F.lit(False))
    kinds = sources.agg(
        F.count_if(F.col("source_kind") == "original").alias("full_sources"),
        F.count_if(F.col("source_kind") == "derivative").alias("reduced_sources"),
        F.min(F.when(checked, F.struct("asset_id", "sha1"))).alias("s"),
    )
    parts = flags.unionByName(kinds, allowMissingColumns=True)
    return parts.agg(
        *[F.max(c).alias(c) for c in ("page_count", "dpi_flags", "below_floor", "full_sources", "reduced_sources", "s")]
    ).select(
        "page_count", "dpi_flags", "below_floor", "full_sources", "reduced_sources",
        F.col("s.asset_id").alias("sample_id"), (F.col("s.asset_id").cast("string") == F.col("s.sha1")).alias("sample_matches"),
    )
