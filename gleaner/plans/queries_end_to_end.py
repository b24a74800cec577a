"""The end-to-end jobs over the asset view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans import curation
from gleaner.plans.assets import CONFIG, asset_view
from gleaner.plans.queries_story import WINDOWS, accepted
from gleaner.plans.registry import query
from dataclasses import replace


@query("run_curation")
def run_curation(spark, sf_dir):
    rows = asset_view(spark, sf_dir, signals=True).withColumn("arrival", F.col("doc_id"))
    return curation.curate(rows, CONFIG).groupBy("chapter").agg(
        F.count("*").alias("rows"), F.count_if("is_dup_keep").alias("kept"), F.count_if("quality_pass").alias("passed"),
        F.count("score").alias("scored"), F.count_if(F.col("review_status") == "pending").alias("shortlisted"),
    )


@query("run_composition")
def run_composition(spark, sf_dir):
    draft = curation.compose(accepted(spark, sf_dir), replace(CONFIG, targets={}), WINDOWS, total=240)
    curation.check_draft(draft)
    return draft.placements.join(
        draft.templates.withColumnRenamed("pos", "cell"), ["template", "cell"]
    ).select("spread", "side", "page_number", "chapter", "cell", "asset_id", "x", "y", "w", "h")
