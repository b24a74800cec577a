"""Review sweeps: small JSON documents, one per file, turned into long feeds.

Every parser takes (file, value) with the whole document as text, and returns one row per entry
with the file name as the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name shapes per kind of sweep.
GLOBS = {
    "decisions": "*.json",
    "eras": "eras_*.json",
    "events": "event_*.json",
    "tags": "tag*.json",
    "cuts": "cut_*.json",
}


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, value) of one file, or of every file of the folder that has the kind's name shape."""
    single = path.endswith(".json")
    reader = spark.read if single else spark.read.option("pathGlobFilter", GLOBS[kind])
    found = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    if found.isEmpty():
        raise FileNotFoundError(f"no {GLOBS[kind]} at {path}")
    return found


def parse_decisions(documents: DataFrame) -> DataFrame:
    """file, seq, asset_id, verdict, caption. An id with a caption but no verdict keeps its row."""
    doc = F.from_json("value", "decisions map<string,string>, captions map<string,string>")
    both = documents.select("file", doc.alias("d"))
    empty = F.create_map().cast("map<string,string>")
    verdicts, captions = F.coalesce("d.decisions", empty), F.coalesce("d.captions", empty)
    ids = F.array_union(F.map_keys(verdicts), F.map_keys(captions))
    return both.select(
        "file", F.explode(ids).alias("asset_id"), verdicts.alias("_v"), captions.alias("_c")
    ).select(
        "file", F.lit(0).alias("seq"), "asset_id",
        F.element_at("_v", F.col("asset_id")).alias("verdict"),
        F.element_at("_c", F.col("asset_id")).alias("caption"),
    )


def _listed(documents: DataFrame, schema: str, ids: str, *columns: str) -> DataFrame:
    parsed = documents.select("file", F.from_json("value", schema).alias("d"))
    return parsed.select(
        "file", *[F.col(f"d.{c}").alias(c) for c in columns],
        F.posexplode(F.col(f"d.{ids}")).alias("seq", "asset_id"),
    )


def parse_eras(documents: DataFrame) -> DataFrame:
    return _listed(documents, "era string, asset_ids array<string>", "asset_ids", "era")


def parse_events(documents: DataFrame) -> DataFrame:
    return _listed(
        documents, "event string, date string, asset_ids array<string>", "asset_ids", "event", "date"
    )


def parse_cuts(documents: DataFrame) -> DataFrame:
    rows = _listed(documents, "era string, cut array<string>", "cut", "era")
    return rows.withColumn("era", F.coalesce("era", F.lit("?")))


def parse_tags(documents: DataFrame) -> DataFrame:
    """Both shapes: a map of theme to ids, or one tag with its ids."""
    schema = "themes map<string,array<string>>, tag string, asset_ids array<string>"
    d = documents.select("file", F.from_json("value", schema).alias("d"))
    one = F.create_map(F.coalesce("d.tag", F.lit("")), F.coalesce("d.asset_ids", F.array().cast("array<string>")))
    pairs = d.select("file", F.explode(F.coalesce("d.themes", one)).alias("tag", "ids"))
    return pairs.select("file", F.trim("tag").alias("tag"), F.posexplode("ids").alias("seq", "asset_id")).where("tag <> ''")


PARSERS = {
    "decisions": parse_decisions, "eras": parse_eras, "events": parse_events,
    "tags": parse_tags, "cuts": parse_cuts,
}


def read_sweeps(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return PARSERS[kind](read_documents(spark, path, kind))
