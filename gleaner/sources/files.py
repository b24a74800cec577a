"""File scans, content keys and sidecar pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import base_name, extension, relative_path, stem

# File kinds by extension, and the sidecar name tokens, most specific first.
HEIC_EXT = (".heic", ".heif", ".hif")
RAW_EXT = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2", ".pef", ".srw", ".raw")
PLAIN_EXT = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp")
VIDEO_EXT = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".3gp", ".webm")
SIDECAR_TOKENS = (
    ".supplemental-metadata", ".supplemental-metadat", ".supplemental-metada", ".supplemental-metad",
    ".supplemental-meta", ".supplemental-met", ".supplemental-me", ".supplemental-m",
    ".supplemental-", ".supplemental", ".suppl", "",
)


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext == ".json", "sidecar")
        .when(ext.isin(*VIDEO_EXT), "video")
        .when(ext.isin(*HEIC_EXT, *RAW_EXT, *PLAIN_EXT), "image")
        .otherwise("other")
    )


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, entry, bytes, modified, kind of every file below root; content only on request.

    Without the content column Spark lists files and reads none of them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return found.select(
        path.alias("path"),
        relative_path(path, F.lit(root)).alias("entry"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        file_kind(path).alias("kind"),
        *(["content"] if content else []),
    )


def scan_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"))


def content_keyed(files: DataFrame, *columns: str) -> DataFrame:
    """asset_id = sha1 of the bytes; equal bytes become one row, the first path winning.

    Only the digest and the narrow columns are shuffled, with a partial minimum before, so many
    copies of one file cost little.
    """
    keyed = files.select(F.sha1("content").alias("asset_id"), "path", *columns)
    return keyed.groupBy("asset_id").agg(
        F.min(F.struct("path", *columns)).alias("r"), F.count("*").alias("copies")
    ).select("asset_id", "r.*", "copies")


def sidecar_names(path: Column) -> Column:
    """Candidate sidecar names in order of preference, with a moved '(N)'."""
    name, bare, ext = base_name(path), stem(path), F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1)
    root = F.regexp_extract(bare, r"^(.*)(\([^(]*\))$", 1)
    paren = F.regexp_extract(bare, r"^(.*)(\([^(]*\))$", 2)
    moved = F.array(F.concat(root, ext, paren), F.concat(root, paren, ext), root)
    bases = F.concat(F.array(name, bare), F.when(paren != "", moved).otherwise(F.array().cast("array<string>")))
    tokens = F.array(*[F.lit(t + ".json") for t in SIDECAR_TOKENS])
    return F.array_distinct(
        F.flatten(F.transform(bases, lambda b: F.transform(tokens, lambda t: F.concat(b, t))))
    )


def pair_sidecars(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds sidecar_path: the first existing candidate in the image's own folder, or NULL."""
    folder = lambda p: F.regexp_extract(p, r"^(.*/)?[^/]*$", 1)
    wanted = images.select(
        "path", folder(F.col("path")).alias("_dir"),
        F.posexplode(sidecar_names(F.col("path"))).alias("_rank", "_name"),
    )
    have = sidecars.select(
        F.col("path").alias("_sidecar"), folder(F.col("path")).alias("_dir"), base_name(F.col("path")).alias("_name")
    )
    best = wanted.join(have, ["_dir", "_name"]).groupBy("path").agg(
        F.min_by("_sidecar", "_rank").alias("sidecar_path")
    )
    return images.join(best, "path", "left")


def parse_sidecar(text: Column) -> Column:
    """Struct (sidecar_taken_time, favorited, people_count); absent keys stay NULL."""
    v = F.try_parse_json(text)
    key = lambda path, kind="string": F.try_variant_get(v, path, kind)
    # An object counts as present only if it is non-empty, as in a truth test.
    node = lambda name: F.nullif(key(f"$.{name}"), F.lit("{}"))
    taken = F.when(node("photoTakenTime").isNotNull(), key("$.photoTakenTime.timestamp")).otherwise(
        key("$.creationTime.timestamp")
    )
    at = F.timestamp_seconds(taken.try_cast("bigint"))
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    true = lambda name: F.coalesce(key(f"$.{name}").isin("true", "1"), F.lit(False))
    # A key that is there with null reads as false, a missing one as NULL.
    has = lambda name: F.coalesce(
        F.array_contains(F.json_object_keys(text), name), F.lit(False)
    )
    favorited = F.when(has("favorited"), true("favorited")).when(has("favorite"), true("favorite"))
    people = F.size(F.try_variant_get(v, "$.people", "array<variant>"))
    return F.struct(
        iso.alias("sidecar_taken_time"),
        favorited.alias("favorited"),
        F.nullif(people, F.lit(-1)).alias("people_count"),
    )
