"""Scores per asset and the diversified shortlist per chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import ScoreConfig
from gleaner.functions import flags, hashing
from gleaner.functions.dates import day_key
from gleaner.session import bind, cut_lineage, dimension


def eligible(assets: DataFrame) -> DataFrame:
    """Keepers nobody has decided on."""
    return assets.where("is_dup_keep AND (review_status IS NULL OR review_status = 'pending')")


def chapter_bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chapter").agg(
        F.min("blur_var").alias("blur_low"), F.max("blur_var").alias("blur_high")
    )


def peer_sample(rows: DataFrame, peers: int = 20) -> DataFrame:
    """First hashed rows per chapter by arrival. The rank limit is applied before the shuffle."""
    first = F.row_number().over(Window.partitionBy("chapter").orderBy("arrival", "asset_id"))
    return rows.where("phash IS NOT NULL").withColumn("place", first).where(F.col("place") <= peers)


def with_diversity(rows: DataFrame, peers: int = 20) -> DataFrame:
    """Adds diversity: mean distance share to the chapter's sample, equal fingerprints left out."""
    sample = peer_sample(rows, peers).groupBy(F.col("chapter").alias("_key")).agg(
        F.collect_list("phash").alias("peers")
    )

    def mean_distance(others):
        total = F.aggregate(
            others, F.lit(0).cast("bigint"), lambda acc, p: acc + hashing.hamming64(p, F.col("phash"))
        )
        return F.when(F.size(others) > 0, total / F.size(others) / 64.0).otherwise(0.0)

    other = bind(F.filter("peers", lambda p: p != F.col("phash")), mean_distance)
    known = F.col("phash").isNotNull() & (F.size("peers") > 1)
    # The sample is one row per chapter with at most ``peers`` values.
    return rows.join(sample, F.col("chapter").eqNullSafe(F.col("_key")), "left").withColumn(
        "diversity", F.when(known, other).otherwise(0.0)
    ).drop("_key", "peers")


def score(rows: DataFrame, config: ScoreConfig, priority: DataFrame) -> DataFrame:
    """Adds score to the eligible rows.

    Input: asset_id, src, chapter, best_datetime, arrival, phash, blur_var, is_screenshot,
    is_document, quality_pass, favorited, people_count.
    """
    bounds = chapter_bounds(rows).withColumnRenamed("chapter", "_key")
    joined = (
        with_diversity(rows, config.peers)
        .join(bounds, F.col("chapter").eqNullSafe(F.col("_key")), "left").drop("_key")
        .join(priority, "src", "left")
    )
    milestone = day_key(F.col("best_datetime")).isin(*config.milestone_dates)
    base = flags.base_score(
        F.col("blur_var"), F.col("blur_low"), F.col("blur_high"), F.col("quality_pass"),
        F.col("priority"), milestone, F.col("favorited"), F.col("people_count"),
        F.col("is_screenshot"), F.col("is_document"), config,
    )
    return joined.withColumn("score", base + F.col("diversity") * config.diverse).drop(
        "blur_low", "blur_high", "priority"
    )


def shortlist_caps(spark, chapters: list[str], targets: dict[str, int], config: ScoreConfig) -> DataFrame:
    """(chapter, cap) for configured chapters: bankers' rounding, at least one."""
    default = max(1, round(config.total_target / max(1, len(chapters))))
    rows = [
        (c, max(1, round(targets.get(c, default) * config.shortlist_multiplier))) for c in chapters
    ]
    return dimension(spark, rows, "chapter string, cap int")


def shortlist(
    scored: DataFrame, caps: DataFrame, default_cap: int, config: ScoreConfig, wave: int = 1000
) -> DataFrame:
    """Greedy pick per chapter, best score first: at most max_per_day per day, none within the near
    distance of an earlier pick, at most cap in all. Returns chapter, asset_id, pick_no.

    Only the best row of each (chapter, fingerprint, day) can ever be picked: whatever bars it, bars
    its copies below it. The rest is decided in waves: the next ``wave`` rows per chapter that
    survive the picks so far are folded in rank order. A wave takes at least one pick per unfinished
    chapter, and one wave is usually enough, so the result equals the row-by-row rule.
    """
    rank = F.struct((-F.col("score")).alias("worse"), F.col("asset_id"))
    keyed = scored.select(
        F.coalesce("chapter", F.lit("")).alias("chapter"), "asset_id", "score", "phash",
        day_key(F.col("best_datetime")).alias("day"),
    )
    best = keyed.where("phash IS NOT NULL").groupBy("chapter", "phash", "day").agg(F.min(rank).alias("r"))
    rows = best.select("chapter", "r.worse", "r.asset_id", "day", "phash").unionByName(
        keyed.where("phash IS NULL").select("chapter", (-F.col("score")).alias("worse"), "asset_id", "day", "phash")
    )
    rows = cut_lineage(rows)
    item = "struct<worse:double,asset_id:string,day:string,phash:bigint>"
    state = cut_lineage(
        rows.select("chapter").distinct().join(caps, "chapter", "left").select(
            "chapter",
            F.coalesce("cap", F.lit(default_cap)).alias("cap"),
            F.array().cast(f"array<{item}>").alias("picks"),
            F.lit(None).cast("struct<worse:double,asset_id:string>").alias("last"),
            F.lit(False).alias("done"),
        )
    )

    def near(pick, row):
        return F.coalesce(hashing.hamming64(pick["phash"], row["phash"]) <= config.near_distance, F.lit(False))

    def barred(picks, row):
        full_day = F.size(F.filter(picks, lambda p: p["day"] == row["day"])) >= config.max_per_day
        return full_day | F.exists(picks, lambda p: near(p, row))

    while True:
        here = F.struct("worse", "asset_id", "day", "phash")
        ahead = (
            rows.join(state.where("NOT done"), "chapter")
            .where(F.col("last").isNull() | (F.struct("worse", "asset_id") > F.col("last")))
            .where(~barred(F.col("picks"), here))
            .select("chapter", "worse", "asset_id", "day", "phash")
        )
        place = F.row_number().over(Window.partitionBy("chapter").orderBy("worse", "asset_id"))
        taken = ahead.withColumn("place", place).where(F.col("place") <= wave)
        batch = taken.groupBy("chapter").agg(
            F.array_sort(F.collect_list(here)).cast(f"array<{item}>").alias("batch")
        )
        empty = F.array().cast(f"array<{item}>")
        folded = F.aggregate(
            F.coalesce("batch", empty),
            F.col("picks"),
            lambda acc, row: F.when(
                (F.size(acc) >= F.col("cap")) | barred(acc, row), acc
            ).otherwise(F.concat(acc, F.array(row))),
        )
        tail = F.try_element_at("batch", F.lit(-1))
        state = cut_lineage(
            state.join(batch, "chapter", "left")
            .withColumn("picks", F.when(F.col("done"), F.col("picks")).otherwise(folded))
            .select(
                "chapter", "cap", "picks",
                F.when(F.col("batch").isNull(), F.col("last")).otherwise(
                    F.struct(tail["worse"].alias("worse"), tail["asset_id"].alias("asset_id"))
                ).alias("last"),
                (F.col("done") | (F.size("picks") >= F.col("cap"))
                 | (F.coalesce(F.size("batch"), F.lit(0)) < wave)).alias("done"),
            )
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("chapter", F.posexplode("picks").alias("at", "pick")).select(
        F.nullif("chapter", F.lit("")).alias("chapter"), "pick.asset_id",
        (F.col("at") + 1).cast("bigint").alias("pick_no"),
    )


def apply_shortlist(assets: DataFrame, scored: DataFrame, picks: DataFrame) -> DataFrame:
    """All rows with new score and review_status: old scores and pending marks are cleared first,
    decisions of a person stay."""
    cleared = assets.drop("score").withColumn(
        "review_status", F.nullif("review_status", F.lit("pending"))
    )
    marks = picks.select("asset_id", F.lit(True).alias("_picked"))
    return (
        cleared.join(scored.select("asset_id", "score"), "asset_id", "left")
        .join(marks, "asset_id", "left")
        .withColumn(
            "review_status",
            F.when(F.col("_picked"), "pending").otherwise(F.col("review_status")),
        )
        .drop("_picked")
    )
