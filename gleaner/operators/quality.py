"""Per-source thresholds and the advisory quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import QualityConfig
from gleaner.functions import flags
from gleaner.functions.text import base_name
from gleaner.session import cut_lineage

ACCURACY = 10_000  # items a sketch keeps at full precision; its rank error is about 0.03 %


def value_sketches(df: DataFrame, group: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """(group, sketch): a mergeable quantile sketch of each group's values, of a size that the rows do not change."""
    size = max(8, min(65_535, accuracy))
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def keep_sketches(new_rows: DataFrame, folder: str, run: str, group: str, value: str, accuracy: int = ACCURACY) -> None:
    """Store the sketches of one run's rows; the same run again replaces its own."""
    value_sketches(new_rows, group, value, accuracy).write.mode("overwrite").parquet(f"{folder}/run={run}")


def kept_sketches(spark: SparkSession, folder: str, group: str) -> DataFrame:
    """One sketch per group, merged over all runs."""
    return spark.read.parquet(folder).groupBy(group).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _bracket(sketches: DataFrame, group: str, p: float, slack: float) -> DataFrame:
    """(group, low, high); no bound where the bracket reaches an end or the sketch is empty."""
    at = lambda rank: F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))
    none = F.lit(None).cast("double")
    return sketches.select(
        group,
        (at(p - slack) if p > slack else none).alias("low"),
        (at(p + slack) if p + slack < 1 else none).alias("high"),
    )


def _ranked(rows: DataFrame, bounds: DataFrame, group: str, p: float) -> DataFrame:
    """(group, n, spot, lower, upper, missed): the values around the wanted rank, if the bracket holds it."""
    low, high = F.col("low"), F.col("high")
    # Zones -1 and 1 keep their count and nearest value only; zone 0 keeps every distinct value.
    zone = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
    counted = (
        rows.join(bounds, group, "left")
        .groupBy(group, zone.alias("zone"), F.when(zone == 0, F.col("v")).alias("inside"))
        .agg(F.count("*").alias("c"), F.max("v").alias("top"), F.min("v").alias("bottom"))
        .select(group, "zone", "c", F.when(F.col("zone") == 1, F.col("bottom")).otherwise(F.col("top")).alias("v"))
    )
    every = Window.partitionBy(group)
    spot = (F.col("n") - 1) * p
    at = F.floor(spot)
    ranked = (
        counted.withColumn("upto", F.sum("c").over(every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("c").over(every))
    )
    # The outer zones keep one value each: a wanted rank deeper inside one of them can't be told.
    missed = ((F.col("zone") == -1) & (at < F.col("c") - 1)) | (
        (F.col("zone") == 1) & (at + 1 < F.col("n")) & (at + 1 > F.col("upto") - F.col("c"))
    )
    return ranked.groupBy(group).agg(
        F.first("n").alias("n"),
        F.first(spot).alias("spot"),
        F.min(F.when(F.col("upto") > at, F.col("v"))).alias("lower"),
        F.min(F.when(F.col("upto") > at + 1, F.col("v"))).alias("upper"),
        F.max(missed).alias("missed"),
    )


def group_percentile(
    df: DataFrame, group: str, value: str, percent: float, min_samples: int, accuracy: int = ACCURACY,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentile per group; 0.0 for groups with too few values.

    The built-in exact percentile holds every value of a group in one buffer. Here a sketch brackets the answer, a pass
    over (group, value) counts what lies outside the bracket, and only the distinct values inside it are ranked, so a
    group with a third of all rows stays cheap. ``sketches`` may be those kept from earlier runs (``kept_sketches``), so
    that only new rows were sketched. A sketch errs with a small probability, and a kept one may be out of date: a group
    whose rank lies outside its bracket is counted again with one eight times as wide, at last with none. Rows without a
    group are left out.
    """
    p = percent / 100.0
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    if sketches is None:
        sketches = value_sketches(rows, group, "v", accuracy)
    # Three times the rank error of a sketch of this size.
    slack, done, pending = 6.9 / max(8, min(65_535, accuracy)) ** 0.97, None, rows
    while True:
        found = cut_lineage(_ranked(pending, _bracket(sketches, group, p, slack), group, p))  # a row per group
        held = found.where("NOT missed")
        done = held if done is None else done.unionByName(held)
        if slack >= 1 or not found.where("missed").head(1):
            break
        pending, slack = rows.join(found.where("missed").select(group), group, "left_semi"), slack * 8
    # A value below the threshold is flagged, so a tie must interpolate to the same last digit as quantile_cont.
    part = F.col("spot") - F.floor("spot")
    exact = F.col("lower") * (F.lit(1.0) - part) + F.coalesce("upper", "lower") * part
    return done.select(
        group,
        F.col("n").alias("samples"),
        F.when(F.col("n") >= min_samples, exact).otherwise(0.0).alias("threshold"),
    )


def gate(
    assets: DataFrame, config: QualityConfig, only_missing: bool = True, sketches: DataFrame | None = None
) -> DataFrame:
    """Flags for rows not scored yet, against thresholds over all rows that have a blur value.

    Input: asset_id, src, orig_path, w, h, blur_var, level, blown, edge, saturation, quality_pass.
    Rows without metrics get no flag and do not pass. ``sketches`` of blur_var per src may come from earlier runs.
    """
    limits = group_percentile(
        assets, "src", "blur_var", config.blur_percentile, config.min_samples, sketches=sketches
    ).select("src", "threshold")
    rows = assets.where("quality_pass IS NULL") if only_missing else assets
    measured = F.col("blur_var").isNotNull()
    shot = measured & flags.is_screenshot(base_name(F.col("orig_path")), F.col("w"), F.col("h"), config)
    doc = measured & flags.is_document(F.col("edge"), F.col("saturation"), config)
    return (
        rows.join(limits, "src", "left")
        .select(
            "asset_id", "src",
            shot.alias("is_screenshot"),
            doc.alias("is_document"),
            (measured & (F.col("blur_var") < F.coalesce("threshold", F.lit(0.0)))).alias("is_blurry"),
            (measured & (F.col("level") < config.dark_level_max)).alias("is_dark"),
            (measured & (F.col("blown") > config.blown_fraction_max)).alias("is_blown"),
            measured.alias("_measured"),
        )
        .withColumn(
            "quality_pass",
            F.col("_measured") & ~(F.col("is_screenshot") | F.col("is_document") | F.col("is_blurry")
                                   | F.col("is_dark") | F.col("is_blown")),
        )
        .drop("_measured")
    )


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count("*").alias("total"),
        F.count_if("quality_pass").alias("passed"),
        F.count_if("is_screenshot").alias("screenshots"),
        F.count_if("is_document").alias("documents"),
        F.count_if("is_blurry").alias("blurry"),
        F.count_if(F.col("is_dark") | F.col("is_blown")).alias("dark_or_blown"),
    )
