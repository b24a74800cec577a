"""Review selections and the folding of review feeds into the asset table.

A feed is a long table (file, seq, asset_id, ...). The last entry in (file, seq) order wins, so
folding the same feed twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.dates import parse_event_date
from gleaner.functions.text import is_asset_id, split_tags

# The verdicts a review file may hold.
VERDICTS = ("accept", "reject", "hero")


def latest(feed: DataFrame, value: Column, keys: tuple[str, ...] = ("asset_id",), name: str = "value") -> DataFrame:
    """Last non-NULL value per key in (file, seq) order; combined on the map side."""
    return (
        feed.select(*keys, "file", "seq", value.alias("_v"))
        .where("_v IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max_by("_v", F.struct("file", "seq")).alias(name))
    )


def review_selection(
    assets: DataFrame,
    *,
    only_shortlist: bool = True,
    include_accepted: bool = True,
    batch: str | None = None,
    batch_all: bool = False,
) -> DataFrame:
    """Keepers to show: a whole batch, a batch's shortlist, the shortlist, or everything."""
    status, rows = F.col("review_status"), assets.where("is_dup_keep")
    if batch is not None:
        rows = rows.where(F.col("ingest_batch") == batch)
        if batch_all:
            return rows.where(F.col("quality_pass") & (status.isNull() | status.isin("pending", "accept")))
        return rows.where(status == "pending")
    if only_shortlist:
        return rows.where(status.isin("pending", "accept") if include_accepted else status == "pending")
    return rows


def accepted(assets: DataFrame, chapters: list[str] | None = None) -> DataFrame:
    rows = assets.where("review_status = 'accept'")
    return rows.where(F.col("chapter").isin(*chapters)) if chapters else rows


def valid_ids(rows: DataFrame, column: str = "asset_id") -> DataFrame:
    return rows.where(is_asset_id(F.col(column)))


def unknown_ids(feed: DataFrame, assets: DataFrame) -> DataFrame:
    """Ids in the feed that no asset has."""
    return feed.select("asset_id").distinct().join(assets.select("asset_id"), "asset_id", "left_anti")


def first_ids(ids: DataFrame, shown: int = 5) -> DataFrame:
    """(total, sample): how many ids, and the first few in order for a message."""
    head = ids.orderBy("asset_id").limit(shown).select(F.lit(0).cast("bigint").alias("n"), "asset_id")
    total = ids.agg(F.count("*").alias("n")).select("n", F.lit(None).cast("string").alias("asset_id"))
    return total.unionByName(head).agg(
        F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list("asset_id")), ",").alias("sample")
    )


def fold_decisions(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: file, seq, asset_id, verdict, caption. A reject leaves the hero mark as it was;
    captions count only for ids that were decided."""
    verdict = F.lower("verdict")
    decided = latest(feed, F.when(verdict.isin(*VERDICTS), verdict), name="_verdict")
    captions = latest(feed, F.col("caption"), name="_caption")
    v = F.col("_verdict")
    return (
        assets.join(decided, "asset_id", "left")
        .join(captions, "asset_id", "left")
        .withColumns(
            {
                "review_status": F.when(v == "reject", "reject").when(v.isNotNull(), "accept").otherwise(F.col("review_status")),
                "is_hero": F.when(v == "hero", True).when(v == "accept", False).otherwise(F.col("is_hero")),
                "caption": F.when(v.isNotNull(), F.coalesce("_caption", "caption")).otherwise(F.col("caption")),
            }
        )
        .drop("_verdict", "_caption")
    )


def accept_counts(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.count_if(F.col("review_status") == "accept").alias("accept_count"),
        F.count_if("is_hero").alias("hero_count"),
    )


class AcceptBoundError(ValueError):
    """The folded table holds too few or too many accepted rows; nothing was written."""


def check_accept_bound(assets: DataFrame, low: int = 150, high: int = 250) -> DataFrame:
    """Returns the table, or raises before any snapshot of it is written."""
    n = accept_counts(assets).first()["accept_count"]
    if not low <= n <= high:
        raise AcceptBoundError(f"{n} accepted rows, allowed are {low} to {high}")
    return assets


def fold_eras(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: file, seq, asset_id, era. The era is taken as it is, known chapter or not."""
    last = latest(feed, F.nullif("era", F.lit("")), name="_era")
    return (
        assets.join(last, "asset_id", "left")
        .withColumn("chapter", F.coalesce("_era", "chapter"))
        .drop("_era")
    )


def fold_events(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: file, seq, asset_id, event, date. The last sweep names the event, the last sweep with
    a date sets the date, so a later sweep without one keeps it."""
    rows = feed.where(F.coalesce("event", F.lit("")) != "").withColumn(
        "_iso", parse_event_date(F.coalesce("date", F.lit("")))
    )
    at = F.struct("file", "seq")
    last = rows.groupBy("asset_id").agg(
        F.max_by("event", at).alias("_event"),
        F.max_by("_iso", F.when(F.col("_iso").isNotNull(), at)).alias("_iso"),
    )
    dated = F.col("_iso").isNotNull()
    return (
        assets.join(last, "asset_id", "left")
        .withColumns(
            {
                "event": F.coalesce("_event", "event"),
                "best_datetime": F.coalesce("_iso", "best_datetime"),
                "date_source": F.when(dated, "event").otherwise(F.col("date_source")),
                "date_confidence": F.when(dated, "medium").otherwise(F.col("date_confidence")),
            }
        )
        .drop("_event", "_iso")
    )


def fold_cuts(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: asset_id. Accepted rows named in it become rejected; nothing else changes."""
    cut = feed.select("asset_id").distinct().withColumn("_cut", F.lit(True))
    hit = F.col("_cut") & (F.col("review_status") == "accept")
    return (
        assets.join(cut, "asset_id", "left")
        .withColumn("review_status", F.when(hit, "reject").otherwise(F.col("review_status")))
        .drop("_cut")
    )


def cut_counts(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Real changes per era: an id counts once, for the first file that cuts it."""
    first = feed.groupBy("asset_id").agg(F.min_by("era", F.struct("file", "seq")).alias("era"))
    hit = first.join(accepted(assets).select("asset_id"), "asset_id", "left_semi")
    return hit.groupBy("era").agg(F.count("*").alias("cut"))


def applied_counts(feed: DataFrame, assets: DataFrame, label: str) -> DataFrame:
    """Feed entries that hit a known asset, per label; each entry counts."""
    return (
        feed.where(F.coalesce(label, F.lit("")) != "")
        .join(assets.select("asset_id"), "asset_id", "left_semi")
        .groupBy(label)
        .agg(F.count("*").alias("applied"))
    )


def set_flags(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: file, seq, asset_id, kind ('favorite', 'hero' or 'reject'), on."""
    last = feed.groupBy("asset_id").agg(
        *[
            F.max_by("on", F.when(F.col("kind") == k, F.struct("file", "seq"))).alias(f"_{k}")
            for k in ("favorite", "hero", "reject")
        ]
    )
    return (
        assets.join(last, "asset_id", "left")
        .withColumns(
            {
                "favorited": F.coalesce("_favorite", "favorited"),
                "is_hero": F.coalesce("_hero", "is_hero"),
                "review_status": F.when(F.col("_reject").isNotNull(), "reject").otherwise(F.col("review_status")),
            }
        )
        .drop("_favorite", "_hero", "_reject")
    )


def fold_tags(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed: asset_id, tag. Adds n_added; the tag text is rewritten, sorted, only if a tag is new."""
    tag = F.trim("tag")
    new = (
        feed.select("asset_id", tag.alias("tag")).where("tag <> ''")
        .groupBy("asset_id").agg(F.collect_set("tag").alias("_new"))  # one set of labels per asset
    )
    have = split_tags(F.col("tags"))
    added = F.array_except(F.coalesce("_new", F.array().cast("array<string>")), have)
    return (
        assets.join(new, "asset_id", "left")
        .withColumn("n_added", F.size(added))
        .withColumn(
            "tags",
            F.when(F.size(added) > 0, F.array_join(F.array_sort(F.array_union(have, F.col("_new"))), ","))
            .otherwise(F.col("tags")),
        )
        .drop("_new")
    )


def tag_additions(assets: DataFrame, feed: DataFrame) -> DataFrame:
    """Assets that gain each tag."""
    pairs = feed.select("asset_id", F.trim("tag").alias("tag")).where("tag <> ''").distinct()
    return (
        pairs.join(assets.select("asset_id", split_tags(F.col("tags")).alias("have")), "asset_id")
        .where(~F.array_contains(F.col("have"), F.col("tag")))
        .groupBy("tag").agg(F.count("*").alias("added"))
    )


def review_progress(feed: DataFrame) -> DataFrame:
    """Per batch: accepted (heroes included), rejected, heroes, touched; and a row of totals."""
    last = latest(feed, F.lower("verdict"), ("batch", "asset_id"), "v")
    v = F.col("v")
    counts = [
        F.count_if(v.isin("accept", "hero")).alias("accepted"),
        F.count_if(v == "reject").alias("rejected"),
        F.count_if(v == "hero").alias("heroes"),
        F.count("*").alias("touched"),
    ]
    per_batch = last.groupBy("batch").agg(*counts)
    total = per_batch.agg(
        *[F.sum(c).alias(c) for c in ("accepted", "rejected", "heroes", "touched")]
    ).select(F.lit("all").alias("batch"), "*")
    return per_batch.select("batch", "accepted", "rejected", "heroes", "touched").unionByName(total)
