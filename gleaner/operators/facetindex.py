"""A bitmap index of facet values: a filter is an AND of bitmaps, a count their number of set bits.

Assets are numbered in order of their dates, so that months, eras and events lie in few bitmaps. Of each facet value
the index has one bitmap per 32,768 numbers in which it occurs; bitmaps of rare values are nearly all zeros, which the
compressed files do not keep. Filters and counts read bitmaps of the named facets only, never the assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.dates import month_key
from gleaner.functions.text import split_tags
from gleaner.operators.catalog import with_placed
from gleaner.operators.keyfilter import BITMAP_BITS
from gleaner.operators.numbering import number_rows

FACETS = ("era", "event", "month", "tag")


def _values() -> Column:
    """(facet, value) pairs of a row; the facet 'all' has every row, so that a filter without conditions has a bitmap."""
    pair = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    marks = [
        pair("all", F.lit("")),
        pair("favorited", F.when(F.col("favorited"), "true")),
        pair("usage", F.when(F.col("placed"), "used").otherwise("unused")),
        pair("era", F.nullif("chapter", F.lit(""))),
        pair("event", F.nullif("event", F.lit(""))),
        pair("month", month_key(F.col("best_datetime"))),
    ]
    return F.concat(F.array(*marks), F.transform(split_tags(F.col("tags")), lambda t: pair("tag", t)))


def write_index(assets: DataFrame, placements: DataFrame, folder: str) -> None:
    """Number the assets and write (number, asset_id) and the bitmaps, partitioned by facet."""
    rows = with_placed(assets.select("asset_id", "best_datetime", "chapter", "event", "tags", "favorited"), placements)
    order = [F.asc_nulls_first("best_datetime"), F.col("asset_id")]
    number_rows(rows, order, "number").withColumn("number", F.col("number") - 1).write.mode("overwrite").parquet(f"{folder}/rows")
    numbered = rows.sparkSession.read.parquet(f"{folder}/rows")
    (
        numbered.select("number", F.inline(_values())).where("value IS NOT NULL")
        .groupBy("facet", "value", F.floor(F.col("number") / BITMAP_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("number") % BITMAP_BITS).alias("bits"))
        .write.mode("overwrite").partitionBy("facet").parquet(f"{folder}/bitmaps")
    )


def _bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("value string, bucket long, bits binary, facet string").parquet(f"{folder}/bitmaps")


def filtered(spark: SparkSession, folder: str, conditions: list[tuple[str, str]]) -> DataFrame:
    """(bucket, bits) of the assets that meet all (facet, value) conditions."""
    wanted = sorted(set(conditions)) or [("all", "")]
    meets = F.lit(False)
    for facet, value in wanted:
        meets = meets | ((F.col("facet") == facet) & (F.col("value") == value))
    both = _bitmaps(spark, folder).where(meets).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where(F.col("n") == len(wanted)).select("bucket", "bits")


def count_filtered(spark: SparkSession, folder: str, conditions: list[tuple[str, str]]) -> DataFrame:
    return filtered(spark, folder, conditions).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def ids_filtered(spark: SparkSession, folder: str, conditions: list[tuple[str, str]]) -> DataFrame:
    """asset_id of the assets that meet all conditions: set bits become numbers, numbers ids."""
    found = filtered(spark, folder, conditions)
    # Bytes that are not zero first, then their bits.
    digits = F.hex("bits")
    value = lambda i: F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bytes_ = found.select(
        "bucket", F.inline(F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BITS // 8 - 1)), lambda i: F.struct(i.alias("i"), value(i).alias("b"))))
    ).where("b <> 0")
    bits = bytes_.select("bucket", "i", "b", F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k")).where(F.getbit("b", F.col("k")) == 1)
    numbers = bits.select((F.col("bucket") * BITMAP_BITS + F.col("i") * 8 + F.col("k")).alias("number"))
    return spark.read.parquet(f"{folder}/rows").select("number", "asset_id").join(numbers, "number", "left_semi").select("asset_id")


def facet_counts(spark: SparkSession, folder: str, conditions: list[tuple[str, str]] = ()) -> DataFrame:
    """(facet, value, n) among the assets that meet all conditions; values without such an asset are left out."""
    bitmaps = _bitmaps(spark, folder).where(F.col("facet").isin(*FACETS))
    if conditions:
        chosen = filtered(spark, folder, conditions).withColumnRenamed("bits", "chosen")
        bitmaps = (
            bitmaps.join(chosen, "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "chosen")).alias("bits"))
            .groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
        )
    return bitmaps.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
