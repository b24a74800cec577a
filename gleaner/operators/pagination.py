"""From a story order to spreads, sides and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import ChapterStory
from gleaner.functions import geometry
from gleaner.operators.numbering import number_rows
from gleaner.session import dimension, refuse

PER_SPREAD = 7
TOO_FEW = "a chapter has fewer than four rows"


def spread_count(n: Column) -> Column:
    """Spreads for n rows: about seven a spread, never fewer than four or more than eight."""
    wanted = F.when(n <= PER_SPREAD, 1).otherwise(F.ceil(n / PER_SPREAD))
    return F.greatest(F.ceil(n / 8), F.least(wanted, F.floor(n / 4)))


def default_left(total: Column, index: Column) -> Column:
    """Left share of a spread: odd totals alternate the fuller side."""
    half = F.floor(total / 2)
    return F.when((total % 2 == 1) & (index % 2 == 0), half + 1).otherwise(half)


def spread_sizes(sizes: DataFrame) -> DataFrame:
    """(chapter, spread_no, n_items, left_items, right_items) for (chapter, n) rows; fewer than four are refused."""
    s = spread_count(F.col("n"))
    spreads = refuse(sizes, F.col("n") < 4, TOO_FEW).select(
        "chapter", "n", s.alias("_s"), F.explode(F.sequence(F.lit(0).cast("bigint"), s - 1)).alias("spread_no")
    )
    total = F.floor(F.col("n") / F.col("_s")) + F.when(F.col("spread_no") < F.col("n") % F.col("_s"), 1).otherwise(0)
    left = default_left(F.col("n_items"), F.col("spread_no"))
    return spreads.withColumn("n_items", total).select(
        "chapter", "spread_no", "n_items", left.alias("left_items"), (F.col("n_items") - left).alias("right_items")
    )


def place_on_spreads(selected: DataFrame) -> DataFrame:
    """Adds spread_no, at (place in the spread), n_items and default_left to every row.

    selected: chapter, asset_id, story_order. A chapter with fewer than four rows is refused; see
    ``set_small_aside``.
    """
    placed = number_rows(selected, ["story_order", "asset_id"], "_no", ("chapter",))
    counted = placed.groupBy("chapter").agg(F.count("*").alias("_n"))
    sizes = refuse(counted, F.col("_n") < 4, TOO_FEW).withColumn("_s", spread_count(F.col("_n")))
    p, base, extra = F.col("_no") - 1, F.floor(F.col("_n") / F.col("_s")), F.col("_n") % F.col("_s")
    longer = extra * (base + 1)
    in_long = p < longer
    rows = placed.join(sizes, "chapter").withColumns(
        {
            "spread_no": F.when(in_long, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - longer) / base)),
            "at": F.when(in_long, p % (base + 1)).otherwise((p - longer) % base),
        }
    ).withColumn("n_items", base + F.when(F.col("spread_no") < extra, 1).otherwise(0))
    return rows.withColumn("default_left", default_left(F.col("n_items"), F.col("spread_no"))).drop(
        "_no", "_n", "_s"
    )


def set_small_aside(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of chapters that fill a spread, rows of those that don't)."""
    small = selected.groupBy("chapter").agg(F.count("*").alias("_n")).where("_n < 4").select("chapter")
    return selected.join(small, "chapter", "left_anti"), selected.join(small, "chapter", "left_semi")


def story_aware_left(placed: DataFrame) -> DataFrame:
    """(chapter, spread_no, left_items): the split that keeps story groups whole.

    A page boundary lies inside its spread, so each spread decides alone from its own few rows.
    Chapters with a single story group keep the default split.
    """
    many = placed.groupBy("chapter").agg(
        F.coalesce(F.min("story_group") != F.max("story_group"), F.lit(False)).alias("_many")
    )
    at = lambda i: F.max(F.when(F.col("at") == i, F.col("story_group"))).alias(f"g{i}")
    spreads = placed.groupBy("chapter", "spread_no").agg(
        F.first("n_items").alias("total"), F.first("default_left").alias("default"), *[at(i) for i in range(1, 5)]
    ).join(many, "chapter")

    def penalty(left: int) -> Column:
        right = F.col("total") - left
        low, high = F.least(F.lit(left), right), F.greatest(F.lit(left), right)
        splits = F.coalesce(F.col(f"g{left - 1}") == F.col(f"g{left}"), F.lit(False)) & (F.col(f"g{left}") != "")
        return F.when(
            right.between(2, 4),
            F.struct(
                F.when((low <= 3) & (high >= 5), 1).otherwise(0).alias("clash"),
                (F.when(F.lit(left) >= 7, 1).otherwise(0) + F.when(right >= 7, 1).otherwise(0)).alias("oversize"),
                splits.cast("int").alias("splits"),
                F.abs(F.lit(left) - right).alias("uneven"),
                F.abs(F.lit(left) - F.col("default")).alias("moved"),
                F.lit(left).cast("bigint").alias("left"),
            ),
        )

    best = F.array_min(F.array_compact(F.array(*[penalty(left) for left in (2, 3, 4)])))
    return spreads.select(
        "chapter", "spread_no",
        F.when(F.col("_many"), F.coalesce(best["left"], F.col("default"))).otherwise(F.col("default")).alias("left_items"),
    )


def assign_pages(placed: DataFrame, left: DataFrame) -> DataFrame:
    """Adds side, cell (0-based), chapter_page (1-based in the chapter), opener."""
    rows = placed.join(left, ["chapter", "spread_no"])
    on_left = F.col("at") < F.col("left_items")
    return rows.withColumns(
        {
            "side": F.when(on_left, "left").otherwise("right"),
            "cell": F.when(on_left, F.col("at")).otherwise(F.col("at") - F.col("left_items")),
            "chapter_page": F.col("spread_no") * 2 + F.when(on_left, 1).otherwise(2),
            "opener": F.col("spread_no") == 0,
        }
    )


def number_spreads(pages: DataFrame, chapter_dim: DataFrame) -> DataFrame:
    """Adds the book-wide spread (0-based), page_number and chapter ordinal, chapters in order."""
    from pyspark.sql import Window

    per_chapter = pages.groupBy("chapter").agg((F.max("spread_no") + 1).alias("_spreads")).join(
        chapter_dim.select("chapter", "chapter_no"), "chapter", "left"
    )
    per_chapter = refuse(per_chapter, F.col("chapter_no").isNull(), "a row's chapter is not in the chapter list")
    w = Window.orderBy("chapter_no")  # one row per chapter
    starts = per_chapter.select(
        "chapter",
        F.coalesce(F.sum("_spreads").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.row_number().over(w).alias("chapter_ordinal"),
    )
    return pages.join(starts, "chapter").withColumn("spread", F.col("_start") + F.col("spread_no")).withColumn(
        "page_number", F.col("spread") * 2 + F.when(F.col("side") == "left", 1).otherwise(2)
    ).drop("_start")


def override_table(spark: SparkSession, stories: dict[str, ChapterStory]) -> DataFrame:
    """(chapter, chapter_page, wanted, show_title, own_style): the configured page overrides, a row per page."""
    rows = [
        (chapter, int(number), list(page.get("assets") or []), page.get("show_title"), page.get("layout_style"))
        for chapter, story in sorted(stories.items()) for number, page in story.page_overrides.items() if page
    ]
    return dimension(
        spark, rows, "chapter string, chapter_page int, wanted array<string>, show_title boolean, own_style string"
    )


def apply_overrides(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds fixed, own_style and title, and puts the items of an overridden page in the wanted order.

    A list that is not exactly the page's items is refused; an override of a page that the book does not have is not
    used. The title band is on both pages of a chapter's opener, unless the left page hides its title and the right one
    does not show it.
    """
    key = ["chapter", "chapter_page"]
    ordered = overrides.where(F.size("wanted") > 0).select(*key, "wanted")
    given = pages.join(ordered.select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("asset_id")).alias("_given"))
    checked = refuse(
        ordered.join(given, key), F.array_sort("wanted") != F.col("_given"), "a page override must list exactly the page's items"
    ).select(*key, "wanted")
    shows = overrides.where(F.col("chapter_page") <= 2).groupBy("chapter").agg(
        F.max(F.when(F.col("chapter_page") == 1, F.col("show_title"))).alias("_left"),
        F.max(F.when(F.col("chapter_page") == 2, F.col("show_title"))).alias("_right"),
    )
    hidden = F.coalesce(~F.col("_left"), F.lit(False)) & ~F.coalesce("_right", F.lit(False))
    return (
        pages.join(checked, key, "left")
        .join(overrides.select(*key, "own_style"), key, "left")
        .join(shows, "chapter", "left")
        .withColumns({
            "cell": F.coalesce(F.array_position("wanted", F.col("asset_id")) - 1, F.col("cell")),
            "fixed": F.col("wanted").isNotNull(),
            "title": F.col("opener") & ~hidden,
        })
        .drop("wanted", "_left", "_right")
    )


def page_counts(n: Column, allow_single: Column | bool = False) -> Column:
    """Rows per page as an array: an even number of pages with two to five rows each.

    NULL where no such split exists; three rows need a single-picture hero page.
    """
    single = allow_single if isinstance(allow_single, Column) else F.lit(allow_single)
    pages = F.greatest(F.lit(2), F.ceil(n / 4))
    even = pages + pages % 2
    base, extra = F.floor(n / even), n % even
    def size(i: Column) -> Column:
        turn = F.when(i % 2 == 1, F.floor(i / 2)).otherwise(F.floor(even / 2) + F.floor(i / 2))
        only = (even == 2) & (extra == 1)
        favoured = F.when(base % 2 == 0, 0).otherwise(1)
        return base + F.when(only, (i == favoured).cast("int")).otherwise((turn < extra).cast("int"))

    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), even - 1), size)
    fits = base.between(2, 5) & (base + F.when(extra > 0, 1).otherwise(0) <= 5)
    three = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    return F.when(n < 1, F.array().cast("array<bigint>")).when((n == 3) & single, three).when((n >= 4) & fits, spread)


def split_pages(sizes: DataFrame, allow_single: bool = False, set_aside: bool = False) -> DataFrame:
    """(chapter, page_no, items) for (chapter, n) rows. A chapter whose rows fill no pages is refused; with ``set_aside``
    it comes as one row without a page number that holds all its rows."""
    counts = page_counts(F.col("n"), allow_single)
    rows = sizes if set_aside else refuse(sizes, counts.isNull(), "a chapter's rows can't be dealt to pages of two to five")
    split = rows.select("chapter", "n", F.posexplode_outer(counts).alias("at", "items"))
    return split.where("n > 0").select("chapter", (F.col("at") + 1).cast("bigint").alias("page_no"), F.coalesce("items", "n").alias("items"))


def spread_labels(pages: DataFrame) -> DataFrame:
    """Per spread: counts, roles, weights, styles and archetype.

    pages: spread, side, opener, w, h.
    """
    left = F.count_if(F.col("side") == "left").alias("left_items")
    right = F.count_if(F.col("side") == "right").alias("right_items")
    wide = F.max(geometry.is_panorama(F.col("w"), F.col("h"))).alias("has_panorama")
    spreads = pages.groupBy("spread").agg(left, right, wide, F.max("opener").alias("opener"))
    l, r = F.col("left_items"), F.col("right_items")
    return spreads.withColumns(
        {
            "archetype": geometry.spread_archetype(l, r, F.col("has_panorama"), F.col("opener")),
            "left_role": geometry.layout_role(l), "right_role": geometry.layout_role(r),
            "left_weight": geometry.page_weight(l), "right_weight": geometry.page_weight(r),
            "left_style": geometry.layout_style(l), "right_style": geometry.layout_style(r),
        }
    )


def override_mismatches(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Page overrides that do not list exactly the page's items.

    pages and overrides: page, asset_id (one row per item; a page holds a handful).
    """
    listed = lambda df, name: df.groupBy("page").agg(F.array_sort(F.collect_list("asset_id")).alias(name))
    return (
        listed(overrides, "wanted").join(listed(pages.join(overrides.select("page").distinct(), "page", "left_semi"), "given"), "page", "left")
        .where(~F.coalesce(F.col("wanted") == F.col("given"), F.lit(False)))
        .select("page", F.size("wanted").alias("n_wanted"), F.coalesce(F.size("given"), F.lit(0)).alias("n_given"))
    )
