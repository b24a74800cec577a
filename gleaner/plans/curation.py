"""The curation pass and the book draft, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.functions import flags, geometry, hashing
from gleaner.functions.dates import date_trust
from gleaner.operators import chapters, layout, neardup, pagination, placement, quality, scoring, story
from gleaner.operators.chapters import chapter_dim
from gleaner.session import cut_lineage, dimension


def curate(assets: DataFrame, config: Config) -> DataFrame:
    """Duplicate groups, quality flags, chapters, scores and shortlist marks on the asset table.

    assets: asset_id, src, orig_path, w, h, bytes, best_datetime, date_confidence, phash, blur_var,
    level, blown, edge, saturation, quality_pass, favorited, people_count, review_status, arrival.
    No row is dropped; rejects and copies are flags. Stored between stages, as stages reread it.
    """
    spark = assets.sparkSession
    priority = dimension(spark, list(config.priority.items()), "src string, priority int")
    base = cut_lineage(assets)
    groups = neardup.duplicate_groups(
        base, config.dedup.max_distance, config.dedup.window_days,
        hashing.equal_blocks_for(config.dedup.max_distance, config.dedup.expected_fingerprints),
    )
    kept = neardup.keepers(
        base.select("asset_id", "src", "w", "h", "bytes").join(priority, "src", "left").join(groups, "asset_id")
    ).select("asset_id", "dup_group", "is_dup_keep")
    gated = quality.gate(base, config.quality, only_missing=True).select(
        "asset_id", "is_screenshot", "is_document", F.col("quality_pass").alias("_pass")
    )
    own = [c for c in base.columns if c not in ("dup_group", "is_dup_keep", "is_screenshot", "is_document", "chapter", "score")]
    joined = base.select(*own).join(kept, "asset_id").join(gated, "asset_id", "left").withColumn(
        "quality_pass", F.coalesce("quality_pass", "_pass")
    ).drop("_pass")
    table = cut_lineage(chapters.assign(joined, config.chapters).drop("clamped"))
    scored = cut_lineage(scoring.score(scoring.eligible(table), config.score, priority))
    ids = [c.id for c in config.chapters]
    default = max(1, round(max(1, round(config.score.total_target / max(1, len(ids)))) * config.score.shortlist_multiplier))
    caps = scoring.shortlist_caps(spark, ids, config.targets, config.score)
    picks = scoring.shortlist(scored, caps, default, config.score)
    return scoring.apply_shortlist(table.withColumn("score", F.lit(None).cast("double")), scored, picks)


@dataclass(frozen=True)
class Draft:
    """A composed book as flat tables."""

    placements: DataFrame
    templates: DataFrame
    spreads: DataFrame
    checks: DataFrame
    unplaced: DataFrame


def compose(
    accepted: DataFrame, config: Config, windows: dict[str, tuple[str, str]] | None = None, total: int = story.BOOK_TARGET
) -> Draft:
    """Story order, budgets, even sample, pages, facing layouts and checks.

    accepted: asset_id, chapter, event, tags, is_hero, favorited, score, w, h, best_datetime,
    date_source, date_confidence, src, caption, orig_path.
    """
    spark = accepted.sparkSession
    windows = windows or {}
    rows = cut_lineage(accepted.where("chapter IS NOT NULL"))
    ordered = cut_lineage(story.story_order(rows, story.story_tables(spark, config.story, windows)))
    listed = [(c, a) for c, s in config.story.items() for a in s.include_only]
    barred = [(c, a) for c, s in config.story.items() for a in s.exclude]
    pair = "chapter string, asset_id string"
    pool = story.check_draft_pool(
        story.draft_pool(ordered, dimension(spark, listed, pair), dimension(spark, barred, pair))
    )
    sizes = pool.groupBy("chapter").agg(F.count("*").alias("n"))
    if config.targets:
        targets = dimension(spark, list(config.targets.items()), "chapter string, target int")
    else:
        targets = story.budgets(sizes, total)
    selected = cut_lineage(story.even_sample(pool, targets))
    fitting, unplaced = pagination.set_small_aside(selected)
    placed = pagination.place_on_spreads(fitting)
    pages = pagination.assign_pages(placed, pagination.story_aware_left(placed))
    pages = pagination.apply_overrides(pages, pagination.override_table(spark, config.story))
    book = cut_lineage(pagination.number_spreads(pages, chapter_dim(spark, config.chapters)))

    weight = flags.feature_weight(F.col("is_hero"), F.col("favorited"), F.col("tags"))
    items = book.select(
        F.col("page_number").alias("page"), F.col("cell").alias("pos"), "asset_id", F.col("w").alias("px_w"),
        F.col("h").alias("px_h"), weight.alias("weight"), "title",
    )
    settings = book.select(F.col("page_number").alias("page"), "fixed", "own_style").distinct()
    rows = layout.page_rows(items).join(settings, "page")
    rows = rows.withColumn("style", F.coalesce("own_style", geometry.layout_style(F.col("k")))).drop("own_style")
    found = layout.strip_candidates(rows, layout.recipe_table(spark))
    sides = book.select(F.col("page_number").alias("page"), "spread", "side", "chapter", "opener").distinct()
    laid = cut_lineage(layout.align_pair(layout.facing_pair(found.join(sides.drop("chapter", "opener"), "page"))))

    page_no = F.col("spread") * 2 + F.when(F.col("side") == "left", 1).otherwise(2)
    template = F.format_string("page_%06d", page_no)
    cells = laid.select("spread", "side", F.posexplode("cells").alias("pos", "c"), "arranged")
    templates = cells.select(template.alias("template"), "pos", "c.x", "c.y", "c.w", "c.h")
    chapter_of = sides.select("spread", "chapter").distinct()
    placements = cells.join(chapter_of, "spread").select(
        "spread", "side", page_no.alias("page_number"), "chapter", template.alias("template"), F.col("pos").alias("cell"),
        F.get("arranged.asset_id", F.col("pos")).alias("asset_id"),
        F.lit(None).cast("double").alias("crop_w"), F.lit(None).cast("double").alias("crop_h"),
        F.lit(None).cast("string").alias("override_dpi"), F.lit("contain").alias("fit"),
        F.lit(False).alias("intentional_hero"),
    )
    trusted = date_trust(F.col("date_source"), F.col("date_confidence")) == "authoritative"
    facts = book.select(
        "asset_id", F.col("w").alias("px_w"), F.col("h").alias("px_h"), trusted.alias("date_trusted"),
        F.substring(F.coalesce("best_datetime", F.lit("")), 1, 10).alias("day"),
    )
    window_rows = dimension(
        spark, [(c, s, e) for c, (s, e) in windows.items()], "chapter string, window_start string, window_end string"
    )
    labels = pagination.spread_labels(book.select("spread", "side", "opener", "w", "h"))
    checks = placement.book_checks(placements, templates, facts, window_rows)
    return Draft(placements, templates, labels, checks, unplaced)


def check_draft(draft: Draft) -> Draft:
    """Raises if a check fails that an automatic draft may not fail."""
    bad = placement.check_counts(draft.checks).where("fatal").collect()  # one row per kind of check
    if bad:
        raise ValueError("the draft fails: " + ", ".join(f"{r['check']} ({r['n']})" for r in bad))
    return draft
