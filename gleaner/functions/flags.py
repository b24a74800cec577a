"""Quality flags, feature weights and score parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import QualityConfig, ScoreConfig
from gleaner.functions.text import split_tags


def on(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def device_aspect(w: Column, h: Column, ratios: Sequence[tuple[float, float]]) -> Column:
    """Is the long/short ratio within 6% of a configured screen ratio?"""
    known = F.array(*[F.lit(max(p) / min(p)) for p in ratios])
    usable = (F.coalesce(w, F.lit(0)) > 0) & (F.coalesce(h, F.lit(0)) > 0)
    ratio = F.greatest(w, h) / F.least(w, h)
    return F.when(usable, F.exists(known, lambda t: F.abs(ratio - t) / t < 0.06)).otherwise(False)


def is_screenshot(name: Column, w: Column, h: Column, config: QualityConfig) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    named = low.startswith("screenshot")
    return named | (device_aspect(w, h, config.screenshot_ratios) & low.endswith(".png"))


def is_document(edge: Column, saturation: Column, config: QualityConfig) -> Column:
    return (edge >= config.document_edge_min) & (saturation <= config.document_saturation_max)


# Tags that mark a family moment.
FAMILY_TAGS = ("family", "immediate family", "extended family", "cousins", "siblings", "milestones")


def feature_weight(is_hero: Column, favorited: Column, tags: Column) -> Column:
    low = F.transform(split_tags(tags), lambda t: F.lower(t))
    family = F.arrays_overlap(low, F.array(*[F.lit(t) for t in FAMILY_TAGS]))
    return F.when(on(is_hero), 3.0).when(on(favorited), 2.0).when(family, 1.0).otherwise(0.0)


def quality_key(is_hero: Column, favorited: Column, score: Column, w: Column, h: Column) -> Column:
    return F.struct(
        on(is_hero).cast("int").alias("hero"),
        on(favorited).cast("int").alias("favorite"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        (F.coalesce(w, F.lit(0)).cast("bigint") * F.coalesce(h, F.lit(0))).alias("pixels"),
    )


def keep_signals(is_hero, event, tags, favorited) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(
        F.array(
            F.when(on(is_hero), "hero"),
            F.when(filled(event), "event"),
            F.when(filled(tags), "tag"),
            F.when(on(favorited), "favorite"),
        )
    )


def weak_flags(is_shot, is_doc, quality_pass) -> Column:
    return F.array_compact(
        F.array(
            F.when(on(is_shot), "screenshot"),
            F.when(on(is_doc), "document"),
            F.when(quality_pass == F.lit(False), "low-q"),
        )
    )


def base_score(
    blur: Column, low: Column, high: Column, quality_pass: Column, priority: Column,
    milestone: Column, favorited: Column, people: Column, is_shot: Column, is_doc: Column,
    config: ScoreConfig,
) -> Column:
    """Score before the diversity part."""
    scaled = F.when(high > low, (blur - low) / (high - low)).otherwise(0.5)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(blur.isNotNull(), scaled).otherwise(0.5)))
    quality = F.when(on(quality_pass), 0.5 + 0.5 * quality).otherwise(quality)
    hero = F.when(F.coalesce(priority, F.lit(0)) >= 100, 1.0).otherwise(0.0) + F.when(
        on(milestone), 1.0
    ).otherwise(0.0)
    favorite = F.when(on(favorited), 1.0).otherwise(0.0)
    group = F.when(F.coalesce(people, F.lit(0)) >= 2, 1.0).otherwise(0.0)
    junk = on(is_shot).cast("double") + on(is_doc).cast("double")
    return (
        quality * config.quality + hero * config.hero + favorite * config.favorite
        + group * config.people - junk * config.penalty
    )
