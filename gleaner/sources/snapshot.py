"""The asset table: schema, insert-only upsert and whole snapshots on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "asset_id string, src string, orig_path string, staged_original_path string, derivative_path string, "
    "zip_source string, zip_entry string, sidecar_taken_time string, favorited boolean, people_count int, "
    "ingest_batch string, event string, tags string, mime string, w int, h int, bytes bigint, "
    "best_datetime string, date_source string, date_confidence string, phash bigint, dup_group bigint, "
    "is_dup_keep boolean, blur_var double, is_screenshot boolean, is_document boolean, quality_pass boolean, "
    "score double, chapter string, review_status string, is_hero boolean, caption string, ingested_at timestamp"
)


def upsert_new(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """Old rows as they are, plus the new rows whose key is not there yet."""
    fresh = new.join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    known = old.select(key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, key, "left").agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if("_known").alias("already")
    )


def evolve(df: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """Add the schema's missing columns as NULL; nothing is dropped or retyped."""
    empty = df.sparkSession.createDataFrame([], schema)
    missing = [f for f in empty.schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def write_snapshot(df: DataFrame, root: str, partition_by: str | None = None) -> str:
    """Write a new version beside the old ones, then move the pointer: readers see all or nothing."""
    version = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root}/versions/{version}")
    # The pointer is a one-row log; the newest row names the current version.
    df.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("written_at")
    ).write.mode("append").json(f"{root}/pointer")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    log = spark.read.schema("version string, written_at timestamp").json(f"{root}/pointer")
    current = log.agg(F.max_by("version", "written_at")).first()[0]
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/versions/{current}")
