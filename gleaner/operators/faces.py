"""Face boxes (0..1 per asset) against crops, and against the gutter of printed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import geometry

# Printed page size, bleed and resolution, and the gutter limit in inches.
DOC_PX = 3675
BLEED_PX = 38
PRINT_DPI = 300
GUTTER_IN = 0.35

NO_FACES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def per_asset(faces: DataFrame) -> DataFrame:
    """asset_id, faces: the boxes of one asset as an array, in order."""
    entry = F.struct("face_no", F.struct("x0", "y0", "x1", "y1").alias("b"))
    return faces.groupBy("asset_id").agg(F.array_sort(F.collect_list(entry))["b"].alias("faces"))


def with_faces(assets: DataFrame, faces: DataFrame) -> DataFrame:
    empty = F.array().cast(NO_FACES)
    return assets.join(per_asset(faces), "asset_id", "left").withColumn("faces", F.coalesce("faces", empty))


def clipped(cells: DataFrame) -> DataFrame:
    """Cells whose crop cuts a face. cells: crop, faces and any keys."""
    return cells.where(geometry.clips_a_face(F.col("crop"), F.col("faces")))


class FacesClipped(ValueError):
    """A layout would cut through faces; nothing is saved."""


def face_gate(cells: DataFrame) -> DataFrame:
    n = clipped(cells).count()
    if n:
        raise FacesClipped(f"{n} cells would cut a face")
    return cells


def gutter_scan(boxes: DataFrame) -> DataFrame:
    """page_no, verso, faces, nearest: designed pages with a face too near the inner trim edge.

    boxes: page_no, x, w in page pixels. Even pages are versos, with the gutter on the right.
    """
    last = boxes.agg(F.max("page_no").alias("page_no"))
    verso = F.col("page_no") % 2 == 0
    distance = F.when(verso, F.lit(DOC_PX - BLEED_PX) - (F.col("x") + F.col("w"))).otherwise(F.col("x") - BLEED_PX)
    designed = boxes.where(F.col("page_no") >= 2).join(last, "page_no", "left_anti")
    return (
        designed.withColumn("distance", distance)
        .where(F.col("distance") < round(GUTTER_IN * PRINT_DPI))
        .groupBy("page_no")
        .agg(F.count("*").alias("faces"), F.round(F.min("distance") / PRINT_DPI, 2).alias("nearest"))
        .withColumns({"verso": F.col("page_no") % 2 == 0, "spread": geometry.spread_of_page(F.col("page_no"))})
    )
