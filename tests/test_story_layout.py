"""Budgets, samples, pagination and layouts against small brute-force twins."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gleaner.config import ChapterStory
from gleaner.functions import geometry
from gleaner.operators import layout, numbering, pagination, story


@pytest.mark.parametrize("seed", range(3))
def test_budgets_sum_exactly(spark, seed):
    rng = random.Random(seed)
    sizes = {f"c{i}": rng.choice([3, 10, 24, 25, 40, 90, 400]) for i in range(9)}
    total = rng.choice([60, 150, 300, 5000])
    got = {r["chapter"]: r["target"] for r in story.budgets(
        spark.createDataFrame(list(sizes.items()), "chapter string, n bigint"), total).collect()}
    # Twin: hand out single steps until nothing moves.
    goal = min(total, sum(sizes.values()))
    want = {c: n for c, n in sizes.items() if n <= 24}
    big = sorted((c for c in sizes if sizes[c] > 24), key=lambda c: (-sizes[c], c))
    rest = max(0, goal - sum(want.values()))
    roots = sum(math.sqrt(sizes[c]) for c in big)
    for c in big:
        want[c] = min(sizes[c], max(4, round(rest * math.sqrt(sizes[c]) / roots)))
    step = 1 if goal > sum(want.values()) else -1
    while sum(want.values()) != goal:
        before = dict(want)
        for c in big:
            if sum(want.values()) != goal and 4 <= want[c] + step <= sizes[c]:
                want[c] += step
        if before == want:
            break
    assert got == want


def test_even_sample_covers_the_timeline(spark):
    rows = [("c", f"a{i:03d}", i, i == 50, False, False, float(i % 5), 10, 10) for i in range(100)]
    df = spark.createDataFrame(rows, "chapter string, asset_id string, story_order bigint, is_hero boolean, favorited boolean, story_pinned boolean, score double, w int, h int")
    targets = spark.createDataFrame([("c", 10)], "chapter string, target bigint")
    got = sorted(r["story_order"] for r in story.even_sample(df, targets).collect())
    rest = [r for r in rows if r[2] != 50]
    want = [50]
    for s in range(9):
        bucket = rest[round(s * 99 / 9): round((s + 1) * 99 / 9)]
        want.append(max(bucket, key=lambda r: (r[6], -r[2]))[2])
    assert got == sorted(want)


def test_numbers_are_consecutive_in_each_group(spark):
    rows = [("g" if i % 3 else "h", (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = numbering.number_rows(df, ["v"], "no", ("g",)).collect()
    for g in "gh":
        mine = sorted((r["no"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_page_counts(spark):
    rows = spark.range(1, 60).select(F.col("id"), pagination.page_counts(F.col("id"), F.col("id") == 3).alias("p")).collect()
    for r in rows:
        if r["id"] < 4:
            assert r["p"] == ([1, 2] if r["id"] == 3 else None)
            continue
        assert sum(r["p"]) == r["id"] and len(r["p"]) % 2 == 0 and all(2 <= x <= 5 for x in r["p"])


def test_spread_sizes(spark):
    sizes = spark.range(4, 80).select(F.col("id").alias("chapter"), F.col("id").alias("n"))
    rows = pagination.spread_sizes(sizes).collect()
    for n in range(4, 80):
        mine = sorted((r for r in rows if r["chapter"] == n), key=lambda r: r["spread_no"])
        assert sum(r["n_items"] for r in mine) == n
        assert all(r["left_items"] + r["right_items"] == r["n_items"] and 2 <= r["right_items"] <= 4 and 2 <= r["left_items"] <= 4 for r in mine)
        for r in mine:
            if r["n_items"] % 2:
                assert (r["left_items"] > r["right_items"]) == (r["spread_no"] % 2 == 0)


def test_split_keeps_story_groups_whole(spark):
    groups = ["x", "x", "y", "y", "y", "y"]
    rows = [("c", f"a{i}", i, g) for i, g in enumerate(groups)]
    placed = pagination.place_on_spreads(spark.createDataFrame(rows, "chapter string, asset_id string, story_order bigint, story_group string"))
    assert pagination.story_aware_left(placed).first()["left_items"] == 2


def page_of(spark, sizes, title=False):
    rows = [(1, i, f"a{i}", w, h, float(f), title) for i, (w, h, f) in enumerate(sizes)]
    return layout.page_rows(spark.createDataFrame(rows, "page int, pos int, asset_id string, px_w int, px_h int, weight double, title boolean"))


def test_partition_layout_has_no_overlaps(spark):
    best = layout.best_partition(page_of(spark, [(1500, 1000, 0), (660, 1000, 0), (1000, 1000, 0)]), layout.partition_table(spark)).first()
    assert len(best["cells"]) == 3
    for i, a in enumerate(best["cells"]):
        assert 0 <= a["x"] and 0 <= a["y"] and a["x"] + a["w"] <= 12 + 1e-6 and a["y"] + a["h"] <= 12 + 1e-6
        for b in best["cells"][i + 1:]:
            assert a["x"] + a["w"] <= b["x"] or b["x"] + b["w"] <= a["x"] or a["y"] + a["h"] <= b["y"] or b["y"] + b["h"] <= a["y"]


def test_six_items_have_no_partition_layout(spark):
    with pytest.raises(Exception, match="no partition"):
        layout.best_partition(page_of(spark, [(1000, 1000, 0)] * 6), layout.partition_table(spark)).collect()
    with pytest.raises(Exception, match="no recipe or order"):
        layout.recipe_candidates(page_of(spark, [(1000, 1000, 0)] * 5), layout.default_recipes(spark), layout.order_table(spark, 4)).collect()
    with pytest.raises(Exception, match="more than 7 items"):
        page_of(spark, [(1000, 1000, 0)] * 9).collect()
    with pytest.raises(Exception, match="more than 7 items"):
        page_of(spark, [(1000, 1000, 0)] * 9).count()


def test_small_chapters_are_refused_or_set_aside(spark):
    rows = [("a", f"a{i}", i, "") for i in range(9)] + [("b", f"b{i}", i, "") for i in range(3)]
    selected = spark.createDataFrame(rows, "chapter string, asset_id string, story_order bigint, story_group string")
    with pytest.raises(Exception, match="fewer than four"):
        pagination.place_on_spreads(selected).collect()
    with pytest.raises(Exception, match="fewer than four"):
        pagination.spread_sizes(selected.groupBy("chapter").agg(F.count("*").alias("n"))).collect()
    kept, aside = pagination.set_small_aside(selected)
    assert pagination.place_on_spreads(kept).count() == 9 and aside.count() == 3
    placed = pagination.place_on_spreads(kept)
    pages = pagination.assign_pages(placed, pagination.story_aware_left(placed))
    with pytest.raises(Exception, match="not in the chapter list"):
        pagination.number_spreads(pages, spark.createDataFrame([("z", 1)], "chapter string, chapter_no int")).collect()


def test_page_overrides_order_pages_and_move_titles(spark):
    rows = [(c, f"{c}{i}", i, "") for c in "ab" for i in range(8)]
    selected = spark.createDataFrame(rows, "chapter string, asset_id string, story_order bigint, story_group string")
    placed = pagination.place_on_spreads(selected)
    pages = pagination.assign_pages(placed, pagination.story_aware_left(placed))
    plain = sorted(pages.select("chapter", "chapter_page", "cell", "asset_id").collect())
    first = [r["asset_id"] for r in plain if r["chapter"] == "a" and r["chapter_page"] == 1]
    def book(**by_chapter):
        stories = {c: ChapterStory(page_overrides=o) for c, o in by_chapter.items()}
        return pagination.apply_overrides(pages, pagination.override_table(spark, stories)).orderBy("chapter", "chapter_page", "cell").collect()
    turned = [*first[1:], first[0]]
    got = book(a={"1": {"assets": turned, "layout_style": "masonry_quad"}, "9": {"assets": ["x"]}, "2": {"show_title": False}}, b={"1": {"show_title": False}})
    assert len(got) == len(rows)
    assert [r["asset_id"] for r in got if (r["chapter"], r["chapter_page"]) == ("a", 1)] == turned
    assert {(r["chapter"], r["chapter_page"]) for r in got if r["fixed"]} == {("a", 1)} == {(r["chapter"], r["chapter_page"]) for r in got if r["own_style"]}
    assert {(r["chapter"], r["opener"], r["title"]) for r in got} == {("a", True, True), ("a", False, False), ("b", True, False), ("b", False, False)}
    assert {r["title"] for r in book(b={"1": {"show_title": False}, "2": {"show_title": True}}) if r["chapter"] == "b" and r["opener"]} == {True}
    assert sorted((r["chapter"], r["chapter_page"], r["cell"], r["asset_id"]) for r in book()) == [tuple(r) for r in plain]
    for wrong in (first[:-1], [*first, first[0]], [*first[:-1], "b0"], [first[0]] * len(first)):
        with pytest.raises(Exception, match="must list exactly"):
            book(a={"1": {"assets": wrong}})


def test_pages_without_a_split_are_refused_or_set_aside(spark):
    sizes = spark.createDataFrame([("a", 9), ("b", 1), ("c", 3), ("d", 0)], "chapter string, n bigint")
    with pytest.raises(Exception, match="can't be dealt"):
        pagination.split_pages(sizes, allow_single=True).collect()
    got = pagination.split_pages(sizes, allow_single=True, set_aside=True).groupBy("chapter").agg(F.sum("items").alias("n"), F.count("page_no").alias("p"))
    assert {tuple(r) for r in got.collect()} == {("a", 9, 4), ("b", 1, 0), ("c", 3, 2)}


def twin_rows(ratios, sizes, dense):
    """Rows of a calm or dense page: (w, h) per item."""
    lines, at = [], 0
    for n in sizes:
        part = ratios[at: at + n]
        at += n
        lines.append((part, (11.76 - 0.05 * (n - 1)) / sum(part)))
    scale = min(1, 11.76 / (sum(h for _, h in lines) + 0.05 * (len(lines) - 1)))
    return [(r * h * scale, h * scale) for part, h in lines for r in part]


def test_candidates_take_the_best_order(spark):
    sizes = [(3000, 2000, 0), (800, 1200, 2), (400, 400, 0)]
    got = {r["recipe"]: r for r in layout.recipe_candidates(
        page_of(spark, sizes), layout.default_recipes(spark), layout.order_table(spark, 4)).collect()}
    assert set(got) == {f"{o}:{i}" for o in ("rows", "columns") for i in range(3)}

    def score(order, strips):
        cells = twin_rows([sizes[i][0] / sizes[i][1] for i in order], strips, False)
        area = sum(w * h for w, h in cells)
        lack = sum(max(0, 240 - min(sizes[i][0] / w, sizes[i][1] / h)) for i, (w, h) in zip(order, cells))
        feature = sum(sizes[i][2] * w * h for i, (w, h) in zip(order, cells))
        return area + 0.6 * feature - 50 * lack - 1e-6 * sum(abs(a - b) for a, b in enumerate(order)), area

    for no, strips in enumerate(layout.RECIPES["three_up"]):
        best = max((score(o, strips) for o in permutations(range(3))), key=lambda s: s[0])
        assert got[f"rows:{no}"]["area"] == pytest.approx(best[1], abs=0.02)


@pytest.mark.parametrize("k", range(1, 8))
@pytest.mark.parametrize("title", [False, True])
def test_strip_candidates_against_all_orders(spark, k, title):
    rng = random.Random(10 * k + title)
    sizes = [(rng.choice([400, 900, 1500, 3000]), rng.choice([500, 1000, 2200, 3100]), rng.choice([0, 0, 1, 3])) for _ in range(k)]
    got = {r["recipe_no"]: r for r in layout.strip_candidates(page_of(spark, sizes, title), layout.default_recipes(spark)).collect()}
    families = layout.RECIPES[geometry.STYLE_NAMES[k - 1]]
    assert set(got) == set(range(2 * len(families)))
    tall = 11.76 - (0.65 if title else 0)

    def score(order, strips, in_rows):
        along, across = (11.76, tall) if in_rows else (tall, 11.76)
        lengths = [sizes[i][0] / sizes[i][1] if in_rows else sizes[i][1] / sizes[i][0] for i in order]
        thick, at = [], 0
        for n in strips:
            thick.append((along - 0.05 * (n - 1)) / sum(lengths[at : at + n]))
            at += n
        scale = min(1, across / (sum(thick) + 0.05 * (len(strips) - 1)))
        area = lack = feature = at = 0
        for n, t in zip(strips, thick):
            for j in range(at, at + n):
                w, h = (lengths[j] * t * scale, t * scale) if in_rows else (t * scale, lengths[j] * t * scale)
                area, feature = area + w * h, feature + sizes[order[j]][2] * w * h
                lack += max(0, 240 - min(sizes[order[j]][0] / w, sizes[order[j]][1] / h))
            at += n
        return area + 0.6 * feature - 50 * lack - 1e-6 * sum(abs(a - b) for a, b in enumerate(order)), area

    for no, strips in enumerate(families):
        for in_rows in (True, False):
            found = got[2 * no + (not in_rows)]
            order = tuple(int(a["asset_id"][1:]) for a in found["arranged"])
            assert sorted(order) == list(range(k)) and (not title or order[0] == 0) and len(found["cells"]) == k
            best = max(score(o, strips, in_rows)[0] for o in permutations(range(k)) if not title or o[0] == 0)
            own, area = score(order, strips, in_rows)
            assert own == pytest.approx(best, abs=0.6) and found["area"] == pytest.approx(area, abs=0.02)


def test_strip_candidates_keep_a_fixed_order(spark):
    sizes = [(400, 2200, 0), (3000, 1000, 3), (900, 900, 0), (1500, 500, 1), (400, 400, 0)]
    pages = page_of(spark, sizes).withColumn("fixed", F.lit(True))
    for row in layout.strip_candidates(pages, layout.default_recipes(spark)).collect():
        assert [a["asset_id"] for a in row["arranged"]] == [f"a{i}" for i in range(5)]


def test_strip_orders_are_few():
    assert [len(layout.strip_orders(s)) for s in ([3, 4], [1, 2, 2, 2], [2, 2, 2], [1])] == [35, 630, 90, 1]
    assert all(o == sorted(o) for o in layout.strip_orders([5])) and len({tuple(o) for o in layout.strip_orders([2, 3, 2])}) == 210


def test_alike_deals_are_scored_once_and_their_score_is_that_of_the_placed_cells(spark):
    assert [len(layout._deals(s)) for s in ((3, 4), (1, 2, 2, 2), (2, 2, 2), (1, 3, 3))] == [35, 105, 15, 70]
    rng = random.Random(5)
    for title in (False, True):
        sizes = [(rng.choice([400, 900, 1500, 3000]), rng.choice([500, 1000, 2200, 3100]), rng.choice([0, 1, 3])) for _ in range(7)]
        for row in layout.strip_candidates(page_of(spark, sizes, title), layout.default_recipes(spark)).collect():
            pairs = list(zip(row["arranged"], row["cells"]))
            fit = lambda a, c: min(c["w"], c["h"] * a["ratio"]) * min(c["h"], c["w"] / a["ratio"])
            feature = sum(a["weight"] * fit(a, c) for a, c in pairs)
            assert row["score"] == pytest.approx(row["area"] + 0.6 * feature - 50 * row["deficit"], abs=0.05)


def test_title_keeps_the_first_item_first(spark):
    found = layout.recipe_candidates(page_of(spark, [(400, 400, 0), (3000, 2000, 3)], True), layout.default_recipes(spark), layout.order_table(spark, 4))
    assert {r["arranged"][0]["asset_id"] for r in found.collect()} == {"a0"}


def test_facing_pages_share_a_height(spark):
    pages = page_of(spark, [(3000, 2000, 0), (2000, 3000, 0)]).unionByName(
        page_of(spark, [(3000, 3000, 0), (2500, 2000, 0), (900, 1600, 0)]).withColumn("page", F.lit(2)))
    found = layout.recipe_candidates(pages, layout.default_recipes(spark), layout.order_table(spark, 4)).withColumn(
        "spread", F.lit(0)).withColumn("side", F.when(F.col("page") == 1, "left").otherwise("right"))
    sides = {r["side"]: r["cells"] for r in layout.align_pair(layout.facing_pair(found)).collect()}
    tops = {s: min(c["y"] for c in cells) for s, cells in sides.items()}
    ends = {s: max(c["y"] + c["h"] for c in cells) for s, cells in sides.items()}
    assert tops["left"] == pytest.approx(tops["right"], abs=0.02) and ends["left"] == pytest.approx(ends["right"], abs=0.02)


def test_fill_ladder_fills_without_overflow(spark):
    rows = [(1, i, f"a{i}", 3000, 2000, False, None, f"n{i}", False, False) for i in range(4)]
    df = spark.createDataFrame(rows, "page int, pos int, asset_id string, px_w int, px_h int, is_hero boolean, people_count int, name string, curated boolean, title boolean")
    df = df.withColumn("faces", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    got = layout.fill_ladder(df, layout.rowing_table(spark)).collect()
    assert len(got) == 4 and 0.5 < got[0]["coverage"] <= 1.0
    for r in got:
        assert r["box"]["y"] + r["box"]["h"] <= 12 + 1e-3 and r["box"]["x"] + r["box"]["w"] <= 12 + 1e-3


def test_archetypes(spark):
    label = lambda l, r, pano, opener: spark.range(1).select(
        geometry.spread_archetype(F.lit(l), F.lit(r), F.lit(pano), F.lit(opener))).first()[0]
    assert label(3, 1, False, True) == "chapter_triptych_plus_feature"
    assert label(3, 3, True, False) == "panorama_plus_support"
    assert label(2, 4, False, False) == "feature_plus_cluster"
