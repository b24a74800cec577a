"""Near-duplicate groups against a brute-force twin, and the keeper and shortlist rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.config import ScoreConfig
from gleaner.functions import hashing
from gleaner.operators import moments, neardup, numbering, scoring

SCHEMA = "asset_id string, phash bigint, best_datetime string, date_confidence string"


def random_rows(seed, n=60):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(n):
        bits = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            bits ^= 1 << rng.randrange(64)
        signed = bits - (1 << 64) if bits >> 63 else bits
        at = datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 3, 7, 9, 30, 36, 60, 66]), seconds=rng.randrange(86400))
        rows.append((
            f"a{i:03d}", None if rng.random() < 0.1 else signed,
            None if rng.random() < 0.1 else at.isoformat(), rng.choice(["low", "high", "medium"]),
        ))
    return rows


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def twin(rows, k, window):
    """Groups by comparing every pair."""
    hashed = [r for r in rows if r[1] is not None]
    day = {r[0]: datetime.fromisoformat(r[2]).date() if r[2] else None for r in hashed}
    real = {d for d in day.values() if d}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in hashed:
        for b in hashed:
            if a[0] >= b[0] or distance(a[1], b[1]) > k:
                continue
            da, db = day[a[0]], day[b[0]]
            linked = da is None and db is None
            if da and db:
                gap = abs((da - db).days)
                linked = gap <= 1 or (gap == 2 and min(da, db) + timedelta(days=1) in real)
                apart = abs(datetime.fromisoformat(a[2]) - datetime.fromisoformat(b[2]))
                linked |= "low" in (a[3], b[3]) and apart <= timedelta(days=window)
            if linked:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {r[0]: find(r[0]) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_all_pairs(spark, seed):
    rows = random_rows(seed)
    got = {r["asset_id"]: r["dup_group"] for r in neardup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), 6, 30).collect()}
    assert got == twin(rows, 6, 30)


def test_groups_with_split_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_BUCKET", 2)
    for seed in (5, 6):
        rows = random_rows(seed)
        rows += [(f"u{i}", r[1], None, r[3]) for i, r in enumerate(rows[:25])]
        got = {r["asset_id"]: r["dup_group"] for r in neardup.duplicate_groups(spark.createDataFrame(rows, SCHEMA), 6, 30).collect()}
        assert got == twin(rows, 6, 30)


def test_rows_with_two_common_blocks_are_not_paired_in_full(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"h{i:04}", (rng.getrandbits(47) << 16) | 0x5A5A, None, "high") for i in range(1200)]
    rows += [(f"n{i}", rows[i][1] ^ (1 << 40) ^ 3, None, "high") for i in range(40)]
    nodes = spark.createDataFrame(rows, SCHEMA).select("asset_id", "phash").withColumnRenamed("asset_id", "node")
    keyed = neardup._keyed(nodes, 6, 2)
    once = F.col("a.node") < F.col("b.node")
    split = neardup.candidates(keyed, keyed, ["chosen", "key"], 6, once).count()
    monkeypatch.setattr(neardup, "HOT_BUCKET", 10**9)
    whole = neardup.candidates(keyed, keyed, ["chosen", "key"], 6, once).count()
    # 48 other bits in 7 parts: a chance pair shares one with 7 / 2**(48 / 7), 6 %
    assert split < whole / 5
    monkeypatch.setattr(neardup, "HOT_BUCKET", 256)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and distance(a[1], b[1]) <= 6}
    got = [(r["src"], r["dst"]) for r in neardup.all_edges(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 40


def test_two_days_apart_needs_the_middle_day(spark):
    h = 5
    far = [("a", h, "2024-01-01T00:00:00", "high"), ("c", h, "2024-01-03T00:00:00", "high")]
    near = far + [("b", ~h, "2024-01-02T00:00:00", "high")]
    edges = lambda rows: neardup.day_edges(neardup.fingerprint_nodes(spark.createDataFrame(rows, SCHEMA))).count()
    assert edges(far) == 0 and edges(near) == 1


def test_every_close_pair_is_found_once(spark, monkeypatch):
    rows = random_rows(11, 80)
    want = {
        (a, b) for a in {r[1] for r in rows if r[1] is not None} for b in {r[1] for r in rows if r[1] is not None}
        if a < b and distance(a, b) <= 6
    }
    df = spark.createDataFrame(rows, SCHEMA)
    assert neardup.all_edges(df).count() == len(want)
    assert neardup.all_edges(df, 6, equal_blocks=3).count() == len(want)
    monkeypatch.setattr(neardup, "HOT_BUCKET", 2)
    assert neardup.all_edges(df, 6, equal_blocks=1).count() == len(want)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    star = [("s000", f"s{i:03d}") for i in range(1, 40)]
    got = neardup.connected_components(spark.createDataFrame(chain + star, "src string, dst string"))
    rows = {r["id"]: r["component"] for r in got.collect()}
    assert len(rows) == 81 and set(rows.values()) == {"c000", "s000"}
    empty = neardup.connected_components(spark.createDataFrame([], "src string, dst string"))
    assert empty.count() == 0


def test_one_keeper_per_group(spark):
    rows = [("b", "g", 50, 10, 10, 5), ("a", "g", 50, 10, 10, 5), ("c", "g", 20, 99, 99, 9), ("d", "h", None, None, None, None)]
    df = spark.createDataFrame(rows, "asset_id string, dup_group string, priority int, w int, h int, bytes bigint")
    kept = {r["asset_id"] for r in neardup.keepers(df).where("is_dup_keep").collect()}
    assert kept == {"a", "d"}


def test_bursts_cross_slices_and_stop_at_the_gap(spark):
    base = datetime(2024, 1, 1, 23, 59, 0)
    at = [0, 120, 241, 300]
    rows = [(f"a{i}", "s", (base + timedelta(seconds=s)).isoformat(), "exif") for i, s in enumerate(at)]
    rows.append(("z", "s", base.isoformat(), "mtime"))
    df = spark.createDataFrame(rows, "asset_id string, src string, best_datetime string, date_source string")
    got = {(r["src"], r["dst"]) for r in moments.burst_edges(df).collect()}
    assert got == {("a0", "a1"), ("a2", "a3")}


def test_bursts_of_one_instant_are_spread(spark, monkeypatch):
    rng = random.Random(8)
    base = datetime(2024, 1, 1)
    rows = [(f"h{i:05}", "hot", base.isoformat(), "exif") for i in range(3000)]
    rows += [(f"n{i}", None, (base + timedelta(seconds=60 * i)).isoformat(), "exif") for i in range(3)]
    rows += [(f"o{i}", f"s{i % 5}", (base + timedelta(seconds=rng.randrange(20_000))).isoformat(), "exif") for i in range(400)]
    rows += [("u", "s1", None, "exif"), ("v", "s1", "no date", "exif")]
    df = spark.createDataFrame(rows, "asset_id string, src string, best_datetime string, date_source string")
    spreads, cut = [], numbering.cut_lineage
    monkeypatch.setattr(numbering, "cut_lineage", lambda rows: spreads.append(cut(rows)) or spreads[-1])
    got = sorted((r["src"], r["dst"]) for r in moments.burst_edges(df).collect())
    lines, want = {}, []
    for i, src, at, _ in rows:
        if at and at[0] == "2":
            lines.setdefault(src, []).append((datetime.fromisoformat(at), i))
    for line in lines.values():
        line.sort()
        want += [(a[1], b[1]) for a, b in zip(line, line[1:]) if b[0] - a[0] <= timedelta(seconds=120)]
    assert got == sorted(want)
    parts = [r["count"] for r in spreads[0].groupBy("_part").count().collect()]
    assert len(parts) == 4 and max(parts) < 0.5 * sum(parts)
    assert moments.burst_edges(df.limit(0)).count() == 0


def greedy(rows, caps, config):
    picked = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        mine = picked.setdefault(r[0], [])
        if len(mine) >= caps[r[0]] or sum(p[4] == r[4] for p in mine) >= config.max_per_day:
            continue
        if r[3] is not None and any(p[3] is not None and distance(p[3], r[3]) <= config.near_distance for p in mine):
            continue
        mine.append(r)
    return {c: [r[1] for r in v] for c, v in picked.items()}


@pytest.mark.parametrize("wave", [3, 1000])
def test_shortlist_equals_the_greedy_walk(spark, wave):
    rng, config = random.Random(3), ScoreConfig(max_per_day=2)
    centres = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(120):
        bits = rng.choice(centres) ^ (1 << rng.randrange(60)) if rng.random() < 0.8 else None
        rows.append((rng.choice("xy"), f"a{i:03d}", rng.randrange(20) / 4, bits, f"2024-01-{rng.randint(1, 6):02d}T00:00:00"))
    caps = {"x": 4, "y": 9}
    df = spark.createDataFrame(rows, "chapter string, asset_id string, score double, phash bigint, best_datetime string")
    cap_rows = spark.createDataFrame(list(caps.items()), "chapter string, cap int")
    picks = scoring.shortlist(df, cap_rows, 5, config, wave=wave).orderBy("chapter", "pick_no").collect()
    got = {c: [r["asset_id"] for r in picks if r["chapter"] == c] for c in "xy"}
    assert got == greedy(rows, caps, config)


def test_rescoring_leaves_decisions_alone(spark):
    assets = spark.createDataFrame(
        [("a", 1.0, "accept"), ("b", 2.0, "pending"), ("c", 3.0, "pending")], "asset_id string, score double, review_status string"
    )
    scored = spark.createDataFrame([("b", 5.0), ("c", 4.0)], "asset_id string, score double")
    picks = spark.createDataFrame([("b",)], "asset_id string")
    got = {r["asset_id"]: (r["score"], r["review_status"]) for r in scoring.apply_shortlist(assets, scored, picks).collect()}
    assert got == {"a": (None, "accept"), "b": (5.0, "pending"), "c": (4.0, None)}


def test_a_third_of_the_rows_may_be_copies(spark):
    rows = spark.range(3000).select(
        F.format_string("a%05d", "id").alias("asset_id"),
        F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.xxhash64("id")).cast("bigint").alias("phash"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 9 + 1).cast("string"), 2, "0"), F.lit("T00:00:00")).alias("best_datetime"),
        F.lit("high").alias("date_confidence"),
    )
    nodes = neardup.fingerprint_nodes(rows)
    # 1000 copies on three days are three nodes, three days apart: no pair of them is even compared.
    assert nodes.where("phash = 77").count() == 3
    sizes = neardup.duplicate_groups(rows).groupBy("dup_group").count()
    assert sizes.where("count > 1").agg(F.sum("count")).first()[0] == 1000
    stars = neardup.copy_edges(rows).count()
    assert stars == 999


def test_bursts_match_a_walk_over_each_timeline(spark):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(4), datetime(2020, 1, 1)
    rows = [("k%d" % rng.randrange(2), start + timedelta(seconds=rng.choice([0, 1, 60]) + 120 * rng.randrange(400))) for _ in range(500)]
    rows += [("k0", start + timedelta(seconds=3600 * 9 - 5))] * 40
    got = sorted(tuple(r) for r in moments.bursts(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts").collect())
    want = []
    for k in ("k0", "k1"):
        run = []
        for t in [*sorted(t for key, t in rows if key == k), None]:
            if run and (t is None or (t - run[-1]).total_seconds() > 120):
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    assert got == sorted(want)


def test_key_length_follows_the_declared_size():
    assert hashing.equal_blocks_for(6, 50_000) == 2
    assert hashing.equal_blocks_for(6, 1_000_000) == 3
    assert hashing.equal_blocks_for(6, 30_000_000) == 4


def test_components_of_text_and_number_ids_agree(spark):
    edges = [(i, i + 1) for i in range(100, 120)] + [(7, 3), (3, 9), (50, 7)]
    numbers = {r["id"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    texts = [(f"{a:05d}", f"{b:05d}") for a, b in edges]
    found = {r["id"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(texts, "src string, dst string")).collect()}
    assert found == {f"{k:05d}": f"{v:05d}" for k, v in numbers.items()}
    assert numbers[120] == 100 and numbers[50] == 3


@pytest.mark.parametrize("pool", [10, 1000, 100_000])
def test_day_pairs_against_all_pairs(spark, pool):
    rng = random.Random(pool)
    words = [rng.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(260):
        word = rng.choice(words)
        for bit in rng.sample(range(64), rng.choice([0, 3, 8, 13, 14, 15, 20])):
            word ^= 1 << bit
        signed = word - (1 << 64) if word >> 63 else word
        day = rng.choice(["2020-01-01", "2020-01-01", "2020-01-02", "", None])
        rows.append((f"a{i:03d}", None if i % 40 == 0 else signed, None if day is None else f"{day}T10:00:00" if day else ""))
    rows += [(f"z{i}", rows[1][1], "2020-01-01T00:00:00") for i in range(50)]
    assets = spark.createDataFrame(rows, "asset_id string, phash bigint, best_datetime string")
    nodes = {}
    for name, word, when in rows:
        if word is not None and when:
            nodes.setdefault((when[:10], word), []).append(name)
    flat = [(day, word, min(names), len(names)) for (day, word), names in nodes.items()]
    want = {
        (d, a, b, ((x ^ y) & ((1 << 64) - 1)).bit_count(), m, n)
        for d, x, a, m in flat for e, y, b, n in flat if d == e and a < b and ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 14
    }
    got = [tuple(r) for r in moments.day_pairs(assets, 14, pool).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    report = {r["day"]: r for r in moments.day_probe_report(assets, 14, pool).collect()}
    for day in ("2020-01-01", "2020-01-02"):
        n = sum(d == day for d, *_ in flat)
        assert (report[day]["fingerprints"], report[day]["pairs"]) == (n, n * (n - 1) // 2)
        assert report[day]["found"] == sum(w[0] == day for w in want)


def test_probes_are_fewer_than_pairs_in_large_pools():
    for pool in (1000, 10_000, 1_000_000):
        blocks = hashing.blocks_for_pool(14, pool)
        assert hashing.probe_cost(14, blocks, pool) < pool / 2
    assert hashing.blocks_for_pool(14, 1_000_000) < hashing.blocks_for_pool(14, 1000)
    assert hashing.probe_radii(14, 6) == [2, 2, 2, 1, 1, 1]


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multiplied_rows_are_not_broadcast(spark):
    from gleaner.operators import moments

    df = spark.createDataFrame(random_rows(11, 80), SCHEMA)
    assert "BroadcastHashJoin [day" not in joins(moments.day_candidates(df)) and "SortMergeJoin [day" in joins(moments.day_candidates(df))
    keyed = neardup._keyed(df.select("asset_id", "phash").where("phash IS NOT NULL"), 6, 2)
    found = joins(neardup.candidates(keyed, keyed, ["chosen", "key"], 6, neardup._near(6)))
    assert "SortMergeJoin [chosen" in found and "BroadcastHashJoin [chosen#" not in found.split("SortMergeJoin [chosen")[0]


def test_larger_pools_get_longer_keys(spark):
    pools = spark.range(100_000).select((F.col("id") % 2).alias("pool"))
    assert neardup._enough_blocks(pools, ["pool"], 6, 1) == 2
    assert neardup._enough_blocks(spark.range(3_000_000), [], 6, 2) == 3
    assert neardup._enough_blocks(spark.range(0), [], 6, 2) == 2


def test_profile_counts_every_word(spark):
    import base64
    import hashlib
    import re

    from gleaner.functions import hashing

    texts = ["", " a  b\ta ", "é x\x0by\n\nz", None, "w " * 3000]
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    marks = lambda t: [base64.b64encode(hashlib.md5(w.encode()).digest())[:1].decode() for w in re.split("[ \n\r\t]+", t)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", hashing.token_profile(F.col("t")).alias("p"))
    got = {r["i"]: r["p"] for r in rows.collect()}
    assert got == {i: None if t is None else [float(marks(t).count(d)) for d in digits] for i, t in enumerate(texts)}


@pytest.mark.parametrize("hot", [2, 30, 10**9])
def test_near_words_in_runs_against_all_pairs(hot):
    import numpy as np

    from gleaner.functions import nearwords

    rng = random.Random(hot)
    sizes = [1, 2, 40, 300, 700]
    key = np.repeat(np.arange(len(sizes)), sizes)
    word = np.array([rng.choice([0, (1 << 64) - 1, 0xF0F0 << 30]) ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in key], dtype=np.uint64)
    role = np.array([rng.choice([1, 2, 3]) for _ in key], dtype=np.int8)
    order, starts = nearwords.bucket_order(role, key)
    w, r, k = word[order], role[order], key[order]
    got = [
        (min(i, j), max(i, j)) for a, b in nearwords.gathered(nearwords.near_in_runs(w, r, starts, 6, hot, hashing.part_bits(6)))
        for i, j in zip(a.tolist(), b.tolist())
    ]
    want = {
        (i, j) for i in range(len(w)) for j in range(i + 1, len(w))
        if k[i] == k[j] and (r[i] & 1 and r[j] & 2 or r[i] & 2 and r[j] & 1) and int(w[i] ^ w[j]).bit_count() <= 6
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_pool_is_shuffled_once_and_gives_each_pair_once(spark):
    rows = random_rows(12, 80)
    words = spark.createDataFrame(rows, SCHEMA).where("phash IS NOT NULL").dropDuplicates(["phash"]).select(
        F.monotonically_increasing_id().alias("no"), "phash", F.lit(0).alias("pool"), F.lit(3).cast("tinyint").alias("role")
    ).cache()
    found = neardup.near_pairs(words, 6, 2)
    assert "MapInArrow" in joins(found) and "SortMergeJoin" not in joins(found) and joins(found).count("Exchange hashpartitioning(pool") == 1
    flat = [(r["no"], r["phash"]) for r in words.collect()]
    want = {(a, b, distance(x, y)) for a, x in flat for b, y in flat if a < b and distance(x, y) <= 6}
    got = [(min(a, b), max(a, b), d) for a, b, d in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    words.unpersist()
