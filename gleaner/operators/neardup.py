"""Near-duplicate edges, connected components and keepers.

Rows are first grouped to nodes, one per (fingerprint, day). All rows of a node are one component
already, so a group of copies costs one aggregation with map-side combine instead of all its pairs.
Edges are searched between nodes only. A shuffle on pigeonhole block keys brings the nodes of a bucket to one task, which
compares them in arrays; one that holds more than ``HOT_BUCKET`` rows, such as a common pattern or the pool of rows
without a date, is split by a second pigeonhole over the whole fingerprint, so not all its pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.config import DedupConfig
from gleaner.functions import hashing, nearwords
from gleaner.functions.dates import NO_DATE, day_key, wall_time
from gleaner.operators.numbering import number_rows
from gleaner.session import cut_lineage, release, workers_import


# Block keys for the declared number of different fingerprints (``DedupConfig.expected_fingerprints``).
EQUAL_BLOCKS = hashing.equal_blocks_for(DedupConfig.max_distance, DedupConfig.expected_fingerprints)
# A bucket with more rows than this is split by a further part of the fingerprint.
HOT_BUCKET = 1024
# Words that a key may bring together by chance on average; a pool with more per key gets longer keys.
CHANCE = 16
# The same where a task compares a bucket's words in arrays (``near_pairs``): a comparison costs far less than a key there.
CHANCE_IN_ARRAYS = 128
# Keyed rows that a task holds at once, by its number of partitions.
ROWS_A_TASK = 2_000_000
UNDATED = -(10**9)  # day number of the pool of rows without a date


def fingerprint_nodes(assets: DataFrame) -> DataFrame:
    """One row per (phash, day): representative id and the time bounds the window join needs.

    Input: asset_id, phash (bigint), best_datetime, date_confidence. Rows without a fingerprint
    form no node.
    """
    when = wall_time(F.col("best_datetime"))
    low = (F.col("date_confidence") == "low") & when.isNotNull()
    return (
        assets.where("phash IS NOT NULL")
        .select("asset_id", "phash", when.alias("at"), low.alias("low"), day_key(F.col("best_datetime")).alias("day"))
        .groupBy("phash", "day")
        .agg(
            F.min("asset_id").alias("node"),
            F.count("*").alias("members"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.min(F.when(F.col("low"), F.col("at"))).alias("first_low"),
            F.max(F.when(F.col("low"), F.col("at"))).alias("last_low"),
        )
    )


def _numbered(nodes: DataFrame) -> DataFrame:
    """The nodes, stored, with a number each: candidates carry it in place of the id, which would be most of a row."""
    return cut_lineage(nodes.withColumn("no", F.monotonically_increasing_id()))


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda name: nodes.select(F.col("no").alias(f"{name}_no"), F.col("node").alias(name))
    return edges.join(side("src"), "src_no").join(side("dst"), "dst_no").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance"
    )


def _enough_blocks(pools: DataFrame, pool: list, distance: int, least: int, chance: int = CHANCE) -> int:
    """At least ``least`` blocks, more where the largest pool would bring more than ``chance`` words under one key."""
    largest = pools.groupBy(*pool).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(least, hashing.equal_blocks_for(distance, largest // chance))


def _keyed(nodes: DataFrame, distance: int, equal_blocks: int) -> DataFrame:
    masks = hashing.block_masks(distance, equal_blocks)
    return (
        nodes.select("*", F.inline(masks))
        .withColumn("key", F.col("phash").bitwiseAND(F.col("mask")))
        .drop("mask")
    )


def hot_buckets(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """The buckets with more than ``HOT_BUCKET`` rows; at most one for so many rows. Written once, so that Spark knows its size."""
    return cut_lineage(rows.groupBy(*bucket).agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_BUCKET).select(*bucket))


def _parted(rows: DataFrame, hot: DataFrame, bucket: list[str], distance: int) -> DataFrame:
    """Adds (part, part_key): every part for rows of hot buckets, part -1 for all others."""
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("mask")))
    flagged = rows.join(hot.withColumn("hot", F.lit(True)), bucket, "left")
    parts = F.when(F.col("hot"), hashing.part_masks(distance)).otherwise(whole)
    return flagged.select(*rows.columns, F.inline(parts)).withColumn("part_key", F.col("phash").bitwiseAND(F.col("mask"))).drop("mask")


def candidates(left: DataFrame, right: DataFrame, bucket: list[str], distance: int, keep: Column) -> DataFrame:
    """Pairs of keyed rows, as a and b, that share a bucket, in hot buckets also a part, and satisfy ``keep``: the join for
    a rule of the caller's own. Near pairs alone are found at less cost by ``near_pairs``."""
    hot = hot_buckets(right, bucket)
    keys = [*bucket, "part", "part_key"]
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    # Spark does not see in a size that rows were multiplied, or what their pairs cost: it would send one side whole through
    # the driver, or join in few tasks. A given number of partitions stays.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda rows: _parted(rows, hot, bucket, distance).repartition(tasks, *keys)
    return side(left).alias("a").hint("merge").join(side(right).alias("b"), reduce(Column.__and__, same) & keep)


def _near(distance: int) -> Column:
    """Join residual of ``candidates``: within the distance. A pair may share several keys."""
    return hashing.hamming64(F.col("a.phash"), F.col("b.phash")) <= distance


def near_pairs(words: DataFrame, distance: int, equal_blocks: int) -> DataFrame:
    """(src_no, dst_no, distance) of near words of one pool of which one seeks and the other may be found.

    Input: pool, no, phash, role (``nearwords``). A pair comes once for each pool and each pair of its rows there: only the
    lowest blocks on which its words agree count, so no distinct is needed over what several keys bring together.
    """
    spark = words.sparkSession
    workers_import(spark)
    blocks = [((1 << width) - 1) << shift for shift, width in hashing.block_bounds(distance + equal_blocks)]
    keys = math.comb(len(blocks), equal_blocks)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words.count() * keys / ROWS_A_TASK))
    keyed = _keyed(words.select("pool", "no", "phash", "role"), distance, equal_blocks)
    find = _finder(distance, equal_blocks, blocks, hashing.part_bits(distance), HOT_BUCKET)
    return keyed.repartition(tasks, "pool", "chosen", "key").mapInArrow(find, "src_no bigint, dst_no bigint, distance int")


def _finder(distance: int, equal_blocks: int, blocks: list[int], parts: list[int], hot: int):
    names = ["src_no", "dst_no", "distance"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        del batches
        pool, no, phash, role, chosen, key = (
            rows[c].to_numpy() for c in ("pool", "no", "phash", "role", "chosen", "key")
        )
        order, starts = nearwords.bucket_order(role, key, pool, chosen)
        no, word, role, chosen = no[order], phash[order].view(np.uint64), role[order], chosen[order]
        for i, j in nearwords.gathered(nearwords.near_in_runs(word, role, starts, distance, hot, parts)):
            diff = word[i] ^ word[j]
            once = (nearwords.lowest_shared(diff, blocks, equal_blocks) == chosen[i]) & (no[i] != no[j])
            if once.any():
                apart = np.bitwise_count(diff[once]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (no[i[once]], no[j[once]], apart)], names)

    return find


def _day_pairs(nodes: DataFrame, distance: int, equal_blocks: int) -> DataFrame:
    """Pairs of numbered nodes for ``day_edges``."""
    days = nodes.select("day").distinct()
    day = F.col("day").try_cast("date")
    own_day = F.coalesce(F.unix_date(day), F.lit(UNDATED))
    equal_blocks = _enough_blocks(nodes, [own_day.alias("pool")], distance, equal_blocks, CHANCE_IN_ARRAYS)
    # A node looks forward: into its own day, where it may be found, the next, and the day after where a middle day exists.
    middle = days.select(F.date_sub(F.col("day").try_cast("date"), 1).alias("before_middle"))
    words = (
        nodes.withColumn("date", day)
        .join(middle, F.col("date") == F.col("before_middle"), "left")
        .withColumn("steps", F.when(F.col("date").isNull(), F.array(F.lit(0)))
                    .when(F.col("before_middle").isNotNull(), F.array(F.lit(0), F.lit(1), F.lit(2)))
                    .otherwise(F.array(F.lit(0), F.lit(1))))
        .select("no", "phash", F.explode("steps").alias("step"), own_day.alias("own"))
        .select("no", "phash", (F.col("own") + F.col("step")).alias("pool"),
                F.when(F.col("step") == 0, nearwords.BOTH).otherwise(nearwords.SEEKS).cast("tinyint").alias("role"))
    )
    return near_pairs(words, distance, equal_blocks)


def day_edges(nodes: DataFrame, distance: int = 6, equal_blocks: int = EQUAL_BLOCKS) -> DataFrame:
    """Node pairs that share a pool of three consecutive days around a day that has rows.

    Days apart 0 or 1 always share one; days two apart share one only if the middle day has rows.
    """
    nodes = _numbered(nodes)
    return _named(_day_pairs(nodes, distance, equal_blocks), nodes)


def _window_pairs(nodes: DataFrame, distance: int, window_days: int, equal_blocks: int) -> DataFrame:
    """Pairs of numbered nodes for ``window_edges``."""
    dated = nodes.where(F.col("day") != NO_DATE).withColumn(
        "bucket",
        F.floor(F.unix_date(F.col("day").cast("date")) / F.lit(max(1, window_days))),
    )
    equal_blocks = _enough_blocks(dated, ["bucket"], distance, equal_blocks, CHANCE_IN_ARRAYS)
    low = F.col("first_low").isNotNull()
    steps = F.when(low, F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    words = dated.withColumn("step", F.explode(steps)).select(
        "no", "phash", (F.col("bucket") + F.col("step")).cast("int").alias("pool"),
        F.when(F.col("step") != 0, nearwords.SEEKS).when(low, nearwords.BOTH).otherwise(nearwords.FOUND).cast("tinyint").alias("role"),
    )
    found = near_pairs(words, distance, equal_blocks).select(
        F.least("src_no", "dst_no").alias("src_no"), F.greatest("src_no", "dst_no").alias("dst_no"), "distance"
    ).distinct()  # two low nodes can find each other from both sides
    bounds = ["first_at", "last_at", "first_low", "last_low"]
    side = lambda name: nodes.select(F.col("no").alias(f"{name}_no"), F.struct(*bounds).alias(name))
    span = F.make_dt_interval(F.lit(window_days))

    def within(a: str, b: str) -> Column:
        """Nearest low row of a to nearest row of b, whichever side b lies on."""
        first_at, last_at, first_low, last_low = F.col(f"{b}.first_at"), F.col(f"{b}.last_at"), F.col(f"{a}.first_low"), F.col(f"{a}.last_low")
        after = (first_at >= last_low) & (first_at <= last_low + span)
        before = (last_at <= first_low) & (last_at >= first_low - span)
        overlap = (first_at < last_low) & (last_at > first_low)
        return F.coalesce(after | before | overlap, F.lit(False))

    return (
        found.join(side("src"), "src_no").join(side("dst"), "dst_no")
        .where(within("src", "dst") | within("dst", "src")).select("src_no", "dst_no", "distance")
    )


def window_edges(
    nodes: DataFrame, distance: int = 6, window_days: int = 30, equal_blocks: int = EQUAL_BLOCKS
) -> DataFrame:
    """Pairs of a low-confidence node and any dated node within the window, bounds included.

    Time is cut into buckets as long as the window, so a partner lies in the same or a neighbouring
    bucket; the exact bound is tested on the near pairs.
    """
    nodes = _numbered(nodes)
    return _named(_window_pairs(nodes, distance, window_days, equal_blocks), nodes)


def all_edges(assets: DataFrame, distance: int = 6, equal_blocks: int = EQUAL_BLOCKS) -> DataFrame:
    """Near pairs over the whole table, between distinct fingerprints; the copies of one
    fingerprint are tied by ``copy_edges``."""
    nodes = _numbered(assets.where("phash IS NOT NULL").groupBy("phash").agg(F.min("asset_id").alias("node")))
    equal_blocks = _enough_blocks(nodes, [], distance, equal_blocks, CHANCE_IN_ARRAYS)
    words = nodes.select("no", "phash", F.lit(0).alias("pool"), F.lit(nearwords.BOTH).cast("tinyint").alias("role"))
    return _named(near_pairs(words, distance, equal_blocks), nodes)


def copy_edges(assets: DataFrame) -> DataFrame:
    """A star from the first id of each fingerprint to its other rows: n-1 edges per group."""
    heads = assets.where("phash IS NOT NULL").groupBy("phash").agg(F.min("asset_id").alias("src"))
    return (
        assets.where("phash IS NOT NULL")
        .select("asset_id", "phash")
        .join(heads, "phash")
        .where("asset_id <> src")
        .select("src", F.col("asset_id").alias("dst"), F.lit(0).alias("distance"))
    )


# --- connected components ---------------------------------------------------------------------


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"). The minimum per vertex is a plain aggregation with map-side combine,
    so a hub does not have to fit in one task. Rounds run on numbers in the order of the ids, which keeps
    them to hash aggregation; a round is deleted when the next one is written.
    """
    if dict(edges.dtypes)["src"] != "bigint":
        return _by_number(edges, max_rounds)
    current, before = _settle(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last = current
        current, after = _settle(_small_star(_large_star(last)))
        release(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _by_number(edges: DataFrame, max_rounds: int) -> DataFrame:
    edges = cut_lineage(edges.select("src", "dst"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbered = cut_lineage(number_rows(ids, ["id"], "no"))
    side = lambda name: numbered.select(F.col("id").alias(name), F.col("no").alias(f"{name}_no"))
    plain = edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_no").alias("src"), F.col("dst_no").alias("dst"))
    found = connected_components(plain, max_rounds).select(F.col("id").alias("no"), F.col("component").alias("root_no"))
    release(edges)
    roots = numbered.select(F.col("no").alias("root_no"), F.col("id").alias("component"))
    return found.join(numbered, "no").join(roots, "root_no").select("id", "component")


def _settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Write one round and, in the same pass, observe its size and an order-free checksum."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    written = cut_lineage(edges.observe(seen, F.count("*").alias("n"), checksum.alias("h")))
    return written, (seen.get["n"], seen.get["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of u at the smallest vertex around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point every smaller neighbour of u, and u itself, at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    )


# --- groups and keepers -----------------------------------------------------------------------


def duplicate_groups(
    assets: DataFrame, distance: int = 6, window_days: int = 30, equal_blocks: int = EQUAL_BLOCKS
) -> DataFrame:
    """(asset_id, dup_group): every row gets a group named by its smallest id, alone or not."""
    # Numbers in the order of the ids: the smallest number of a component is that of its smallest id.
    nodes = cut_lineage(number_rows(fingerprint_nodes(assets), ["node"], "no"))
    edges = _day_pairs(nodes, distance, equal_blocks).unionByName(_window_pairs(nodes, distance, window_days, equal_blocks))
    components = connected_components(edges.select(F.col("src_no").alias("src"), F.col("dst_no").alias("dst")))
    roots = nodes.select(F.col("no").alias("component"), F.col("node").alias("root"))
    named = (
        nodes.join(components.withColumnRenamed("id", "no").join(roots, "component"), "no", "left")
        .select("phash", "day", F.coalesce("root", "node").alias("root"))
    )
    keyed = assets.select("asset_id", "phash", day_key(F.col("best_datetime")).alias("day"))
    # Few keys, many rows: AQE splits a hot (phash, day) on the row side of this join.
    hashed = keyed.where("phash IS NOT NULL").join(named, ["phash", "day"]).select("asset_id", "root")
    lone = keyed.where("phash IS NULL").select("asset_id", F.col("asset_id").alias("root"))
    return hashed.unionByName(lone).withColumnRenamed("root", "dup_group")


def keepers(grouped: DataFrame) -> DataFrame:
    """Adds is_dup_keep: the best (priority, w*h, bytes) of each dup_group, smallest id on a tie.

    Input: asset_id, dup_group, priority, w, h, bytes.
    """
    rank = F.struct(
        (-F.coalesce("priority", F.lit(0))).alias("p"),
        (-F.coalesce("w", F.lit(0)).cast("bigint") * F.coalesce("h", F.lit(0))).alias("px"),
        (-F.coalesce("bytes", F.lit(0))).alias("b"),
        F.col("asset_id").alias("keeper"),
    )
    winner = grouped.groupBy("dup_group").agg(F.min(rank)["keeper"].alias("keeper"))
    return grouped.join(winner, "dup_group").withColumn(
        "is_dup_keep", F.col("asset_id") == F.col("keeper")
    )


def dense_group_ids(grouped: DataFrame) -> DataFrame:
    """(dup_group, group_no): consecutive numbers in order of the group's smallest id."""
    return number_rows(grouped.select("dup_group").distinct(), ["dup_group"], "group_no")


def stage_summary(kept: DataFrame) -> DataFrame:
    """total, kept, dup_flagged, multi_member_groups."""
    sizes = kept.groupBy("dup_group").agg(F.count("*").alias("n"), F.count_if("is_dup_keep").alias("k"))
    return sizes.agg(
        F.sum("n").alias("total"),
        F.sum("k").alias("kept"),
        F.sum(F.col("n") - F.col("k")).alias("dup_flagged"),
        F.count_if(F.col("n") > 1).alias("multi_member_groups"),
    )
