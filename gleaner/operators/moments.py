"""Same-moment edges: camera counters, time bursts, and near pairs on one page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import hashing
from gleaner.functions.dates import instant
from gleaner.functions.text import filename_counter
from gleaner.operators import neardup
from gleaner.operators.numbering import with_previous

# Sources of a date that is good enough for burst detection.
REAL_DATES = ("exif", "sidecar", "filename")


def counter_edges(assets: DataFrame) -> DataFrame:
    """Consecutive counters of one (src, prefix), 1 or 2 apart.

    Counters have at most four digits, so equal numbers are grouped first: a hot source leaves at
    most 10,000 distinct numbers per prefix to the window, however many rows it has.
    """
    counted = assets.select("asset_id", "src", filename_counter(F.col("orig_path")).alias("c")).where(
        "c IS NOT NULL"
    ).select("asset_id", "src", "c.prefix", "c.number")
    numbers = counted.groupBy("src", "prefix", "number").agg(
        F.min("asset_id").alias("first_id"), F.max("asset_id").alias("last_id")
    )
    w = Window.partitionBy("src", "prefix").orderBy("number")
    return (
        numbers.select(
            F.lag("last_id").over(w).alias("a"),
            F.col("first_id").alias("b"),
            (F.col("number") - F.lag("number").over(w)).alias("gap"),
        )
        .where("gap BETWEEN 1 AND 2")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("int").alias("distance"))
    )


def burst_edges(assets: DataFrame, gap_seconds: int = 120) -> DataFrame:
    """Consecutive rows of one src, by (instant, asset_id), at most ``gap_seconds`` apart.

    The order is global and range-partitioned down to the id, so neither a source with a third of all rows nor one instant
    with millions of them is one task (``with_previous``).
    """
    timed = (
        assets.where(F.col("date_source").isin(*REAL_DATES))
        .select("asset_id", "src", instant(F.col("best_datetime")).alias("at"))
        .where("at IS NOT NULL")
    )
    rows = with_previous(timed, ["src", "at", "asset_id"], ["src", "at", "asset_id"], "before")
    gap = F.unix_micros("at") - F.unix_micros("before.at")
    return (
        rows.where(F.col("before").isNotNull() & F.col("src").eqNullSafe(F.col("before.src")) & gap.between(0, gap_seconds * 1_000_000))
        .select(F.col("before.asset_id").alias("src"), F.col("asset_id").alias("dst"), F.lit(None).cast("int").alias("distance"))
    )


def bursts(rows: DataFrame, key: str, at: str, gap_seconds: int = 120, slice_hours: int = 1) -> DataFrame:
    """(key, first_ts, last_ts, n) of every run of rows at most ``gap_seconds`` apart.

    Equal instants are counted first. Runs are found inside slices of each timeline; only a slice's first
    and last run can go on in a neighbouring slice, and those, two per slice, are joined up.
    """
    gap = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier) > gap_seconds * 1_000_000
    instants = rows.where(F.col(at).isNotNull()).groupBy(key, F.col(at).cast("timestamp").alias("at")).agg(F.count("*").alias("n"))
    sliced = instants.withColumn("slice", F.floor(F.unix_timestamp("at") / (slice_hours * 3600)))
    inside = Window.partitionBy(key, "slice").orderBy("at")
    starts = sliced.withColumn("run", F.sum(F.coalesce(gap(F.col("at"), F.lag("at").over(inside)), F.lit(True)).cast("int")).over(inside))
    runs = starts.groupBy(key, "slice", "run").agg(F.min("at").alias("first_ts"), F.max("at").alias("last_ts"), F.sum("n").alias("n"))
    last_run = F.max("run").over(Window.partitionBy(key, "slice"))
    runs = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == last_run))
    # Two rows per key and slice at most: bounded by the calendar, not by the rows.
    line = Window.partitionBy(key).orderBy("first_ts")
    edges = runs.where("edge").withColumn(
        "burst", F.sum(F.coalesce(gap(F.col("first_ts"), F.lag("last_ts").over(line)), F.lit(True)).cast("int")).over(line)
    )
    joined = edges.groupBy(key, "burst").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))
    return runs.where("NOT edge").select(key, "first_ts", "last_ts", "n").unionByName(joined.drop("burst"))


def moment_clusters(assets: DataFrame, distance: int = 6) -> DataFrame:
    """(asset_id, cluster) of rows that share a moment with another row; single rows are left out."""
    edges = (
        neardup.all_edges(assets, distance)
        .unionByName(neardup.copy_edges(assets))
        .unionByName(counter_edges(assets))
        .unionByName(burst_edges(assets))
    )
    found = neardup.connected_components(edges)
    return found.select(F.col("id").alias("asset_id"), F.col("component").alias("cluster"))


def same_moment_pairs(placed: DataFrame, distance: int = 14) -> DataFrame:
    """Near pairs of one calendar day that sit on one page. A page is small by construction.

    Input: page, asset_id, phash, best_datetime.
    """
    side = placed.select("page", "asset_id", "phash", F.substring("best_datetime", 1, 10).alias("day")).where(
        "day <> ''"
    )
    a, b = side.alias("a"), side.alias("b")
    apart = hashing.hamming_or_far(F.col("a.phash"), F.col("b.phash"))
    return a.join(
        b,
        (F.col("a.page") == F.col("b.page")) & (F.col("a.day") == F.col("b.day"))
        & (F.col("a.asset_id") < F.col("b.asset_id")) & (apart <= distance),
    ).select(
        F.col("a.page").alias("page"), F.col("a.asset_id").alias("asset_a"),
        F.col("b.asset_id").alias("asset_b"), apart.alias("distance"),
    )


def _day_nodes(assets: DataFrame) -> DataFrame:
    """One row per (day, fingerprint) with its smallest id and the number of its rows."""
    return (
        assets.select("asset_id", "phash", F.substring("best_datetime", 1, 10).alias("day"))
        .where("phash IS NOT NULL AND day <> ''")
        .groupBy("day", "phash").agg(F.min("asset_id").alias("node"), F.count("*").alias("members"))
    )


def day_candidates(assets: DataFrame, distance: int = 14, pool: int = 1000) -> DataFrame:
    """Pairs of different fingerprints of one calendar day that the probes bring together, each as often as they do.

    A threshold this wide leaves equal-block keys of four bits. Words are cut into few long blocks instead; one side is indexed
    by every block, the other probes it with all values within the block's radius (multi-index hashing, Norouzi et
    al.). ``pool`` is the declared number of different fingerprints of a large day; it sets the number of
    blocks, never the result. A hot day is dealt over all its block values.
    """
    blocks = hashing.blocks_for_pool(distance, pool)
    nodes = _day_nodes(assets)

    def side(probing: bool) -> DataFrame:
        rows = nodes.select("*", F.inline(hashing.probe_masks(distance, blocks, probing)))
        key = F.col("phash").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip"))
        return rows.select("day", "block", key.alias("key"), "phash", "node", "members")

    # Spark does not see in a size that rows were multiplied, and would send one side whole through the driver.
    a, b = side(False).alias("a"), side(True).alias("b")
    return a.hint("merge").join(
        b,
        (F.col("a.day") == F.col("b.day")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.node") < F.col("b.node")),
    ).select(
        F.col("a.day").alias("day"), F.col("a.block").alias("block"), F.col("a.node").alias("asset_a"), F.col("b.node").alias("asset_b"),
        F.col("a.members").alias("members_a"), F.col("b.members").alias("members_b"), F.col("a.phash").alias("phash_a"),
        F.col("b.phash").alias("phash_b"), F.lit(blocks).alias("blocks"),
    )


def day_pairs(assets: DataFrame, distance: int = 14, pool: int = 1000) -> DataFrame:
    """(day, asset_a, asset_b, distance, members_a, members_b): near fingerprints of one calendar day, without a page limit.

    A fingerprint stands for all its rows of that day (``members``), named by the smallest id; rows of one fingerprint are at
    distance 0 and are not paired. Rows without a fingerprint or a date are in no pair.
    """
    found = day_candidates(assets, distance, pool)
    a, b = F.col("phash_a"), F.col("phash_b")
    apart = hashing.hamming64(a, b)
    first = hashing.first_probed_block(a, b, distance, hashing.blocks_for_pool(distance, pool))
    return found.where((apart <= distance) & (F.col("block") == first)).select(
        "day", "asset_a", "asset_b", apart.alias("distance"), "members_a", "members_b"
    )


def day_probe_report(assets: DataFrame, distance: int = 14, pool: int = 1000) -> DataFrame:
    """(day, fingerprints, pairs, candidates, found) of every day: what the probes save against all pairs of a day."""
    nodes = _day_nodes(assets).groupBy("day").agg(F.count("*").alias("fingerprints"))
    tried = day_candidates(assets, distance, pool)
    apart = hashing.hamming64(F.col("phash_a"), F.col("phash_b"))
    first = hashing.first_probed_block(F.col("phash_a"), F.col("phash_b"), distance, hashing.blocks_for_pool(distance, pool))
    sums = tried.groupBy("day").agg(
        F.count("*").alias("candidates"), F.count_if((apart <= distance) & (F.col("block") == first)).alias("found")
    )
    n = F.col("fingerprints")
    return nodes.join(sums, "day", "left").select(
        "day", "fingerprints", (n * (n - 1) / 2).cast("bigint").alias("pairs"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("found", F.lit(0)).alias("found"),
    )
