"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with the same text are linked. Every document starts in the shard its hash names; then rounds of
joins move linked documents to the shard where most of their group already is. Each move takes from a
quota: two shards may always swap equally many rows, and beyond that a shard takes in no more than it has
room for, so no round unbalances the shards. Rounds stop when no row moves. Unlinked documents then fill
the shards up, and sizes in rows come out at most one apart (law ``rows``).

Rows of a group that are in the same shard are one cell (group, shard, rows): moves, quotas and cut links
are about cells, so a group of a third of all rows costs at most one cell a shard.

Defined results: a null text has size 8, checksum 0 and is linked with empty texts; repeated rows are documents of their
own; a group larger than a shard is split over as few shards as the quotas allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.numbering import number_rows
from gleaner.session import cut_lineage

SHARDS = 24
ROUNDS = 20
SPREAD = 64


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _running(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a row's predecessors in its ``by`` group.

    Rows are dealt into SPREAD slices by ``order[0]``'s hash inside a group and gain class, so that no
    window holds a whole group; the slices' sums are few rows.
    """
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(order[-1]), F.lit(SPREAD)))
    cells = [*by, *order[:-1], "_slice"]
    sums = rows.groupBy(*cells).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy(*order[:-1], "_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*cells, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*cells).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, cells)
        .withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_slice", *order[:-1])
    )


def capacity_of(shard: Column, total: int, shards: int) -> Column:
    """Rows of a shard in the end: the first ones take the remainder."""
    return F.lit(total // shards) + (shard < total % shards).cast("int")


def propagate(cells: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Moves rows of (grp, shard, n) towards the shard that holds most of their group.

    No shard ends above its share of ``total`` rows if none starts there. First a group moves to the shard
    with most of its rows, then to the one with most among those with room, so a group larger than a shard
    fills one after the other. A round without a move is followed by one of the first kind; two end it.
    """
    still = 0
    for turn in range(rounds):
        sizes = cells.groupBy("shard").agg(F.sum("n").alias("size"))
        held = {r["shard"]: r["size"] for r in sizes.collect()}  # a row for each shard
        full = [s for s in range(shards) if held.get(s, 0) >= total // shards + (s < total % shards)] if turn and not still else []
        is_full = F.col("shard").isin(full) if full else F.lit(False)
        # most rows first; among equals the group's own hash decides, so that no shard is favoured
        best = cells.where(~is_full).groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("h"), "shard")).alias("b"))
        best = best.select("grp", F.col("b.shard").alias("target"), F.col("b.n").alias("most"))
        stays = F.col("target").isNull() | (is_full & (F.col("n") >= F.col("most")))
        wish = cut_lineage(cells.join(best, "grp", "left").withColumn("target", F.when(stays, F.col("shard")).otherwise(F.col("target"))).drop("most"))
        asked = wish.where("shard <> target").groupBy("shard", "target").agg(F.sum("n").alias("want"))
        back = asked.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("want").alias("back"))
        # at most SHARDS ** 2 rows from here to the quotas
        flow = asked.join(back, ["shard", "target"], "left").withColumn("swap", F.least("want", F.coalesce("back", F.lit(0))))
        room = flow.join(sizes.select(F.col("shard").alias("target"), "size"), "target", "left").withColumn(
            "room", F.greatest(F.lit(0), capacity_of(F.col("target"), total, shards) - F.coalesce("size", F.lit(0)))
        )
        ahead = Window.partitionBy("target").orderBy(F.col("want").desc(), "shard").rowsBetween(Window.unboundedPreceding, -1)
        rest = room.withColumn("rest", F.col("want") - F.col("swap")).withColumn("taken", F.coalesce(F.sum("rest").over(ahead), F.lit(0)))
        quota = rest.select(
            "shard", "target",
            (F.col("swap") + F.greatest(F.lit(0), F.least("rest", F.col("room") - F.col("taken")))).alias("quota"),
        )
        movers = wish.where("shard <> target").withColumn("_gain", -F.floor(F.log2("n")))
        placed = _running(movers, ["shard", "target"], ["_gain", "grp"], "n", "ahead").join(quota, ["shard", "target"])
        moved = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("ahead"))).cast("bigint")
        step = placed.withColumn("moved", moved)
        after = cut_lineage(
            wish.where("shard = target").select("grp", "shard", "n", F.lit(0).cast("bigint").alias("moved"))
            .unionByName(step.select("grp", F.col("target").alias("shard"), F.col("moved").alias("n"), "moved"))
            .unionByName(step.select("grp", "shard", (F.col("n") - F.col("moved")).alias("n"), F.lit(0).cast("bigint").alias("moved")))
            .where("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"))
        )
        count = after.agg(F.sum("moved")).first()[0] or 0
        cells = after.select("grp", "shard", "n")
        still = 0 if count else still + 1
        if still == 2:
            break
    return cells


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, shards at most one row apart."""
    light = cut_lineage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(_text()) + 8).cast("bigint").alias("size"),
        F.crc32(_text().cast("binary")).alias("text_crc32"),
        F.md5(_text().cast("binary")).alias("grp"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    ))
    total = light.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    groups = light.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    linked = groups.groupBy("grp").agg(F.sum("n").alias("rows")).where("rows > 1").select("grp")
    start = cut_lineage(_fit(groups.join(linked, "grp"), share))
    cells = propagate(start, total, shards)
    member = cut_lineage(light.join(start.select("grp").distinct(), "grp", "left_semi").drop("shard"))
    lone = light.join(start.select("grp").distinct(), "grp", "left_anti").drop("shard")
    # a group has at most one cell a shard, so the list is short; the rows of a hot group are numbered in ranges
    listed = _spans(cells)
    numbered = number_rows(member, ["doc_id"], "_at", by=("grp",)).join(listed, "grp")
    inside = F.filter("spans", lambda c: (c["start"] < F.col("_at")) & (F.col("_at") <= c["stop"]))[0]["shard"]
    kept = numbered.select("doc_id", "size", "text_crc32", inside.alias("shard"))
    taken = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free, upto = [], 0
    for s in range(shards):
        upto += share[s] - taken.get(s, 0)
        free.append(upto)
    fill = number_rows(lone, ["doc_id"], "_at")
    place = F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in free]), lambda x: x < F.col("_at"))).cast("int")
    filled = fill.select("doc_id", "size", "text_crc32", place.alias("shard"))
    out = number_rows(kept.unionByName(filled), ["doc_id"], "slot", by=("shard",))
    return out.withColumn("slot", F.col("slot") - 1)


def _fit(cells: DataFrame, share: list[int]) -> DataFrame:
    """Starting cells within each shard's share: linked rows above it go to the shards with room."""
    sized = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    if all(n <= share[s] for s, n in sized.items()):
        return cells
    over = _running(cells.withColumn("_gain", F.lit(0)), ["shard"], ["_gain", "grp"], "n", "ahead")
    stay = F.greatest(F.lit(0), F.least(F.col("n"), F.element_at(F.array(*[F.lit(x) for x in share]), F.col("shard") + 1) - F.col("ahead"))).cast("bigint")
    kept = over.select("grp", "shard", stay.alias("n"))
    spare = over.select("grp", (F.col("n") - stay).alias("n")).where("n > 0").groupBy("grp").agg(F.sum("n").alias("n"))
    ends, upto = [], 0
    for s in range(len(share)):
        upto += share[s] - min(share[s], sized.get(s, 0))
        ends.append(upto)
    line = _running(spare.withColumn("_all", F.lit(0)).withColumn("_gain", F.lit(0)), ["_all"], ["_gain", "grp"], "n", "ahead")
    holes = F.array(*[
        F.struct(F.lit(s).alias("shard"), F.lit(ends[s - 1] if s else 0).cast("bigint").alias("a"), F.lit(ends[s]).cast("bigint").alias("b"))
        for s in range(len(share))
    ])
    placed = line.select("grp", "ahead", (F.col("ahead") + F.col("n")).alias("end"), F.explode(holes).alias("hole")).select(
        "grp", F.col("hole.shard").alias("shard"),
        (F.least(F.col("end"), F.col("hole.b")) - F.greatest(F.col("ahead"), F.col("hole.a"))).alias("n"),
    )
    return kept.unionByName(placed).where("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def _spans(cells: DataFrame) -> DataFrame:
    """Per group, the row numbers (start, stop] that each of its shards takes."""
    sorted_ = F.array_sort(F.collect_list(F.struct("shard", "n")))
    lists = cells.groupBy("grp").agg(sorted_.alias("c"))
    start = lambda i: F.aggregate(F.slice("c", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    spans = F.transform("c", lambda x, i: F.struct(start(i).alias("start"), (start(i) + x["n"]).alias("stop"), x["shard"].alias("shard")))
    return lists.select("grp", spans.alias("spans"))
