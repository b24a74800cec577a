"""Checks and measures over placements: one row per placed cell.

placements: spread, side, page_number, chapter, template, cell, asset_id, crop_w, crop_h,
override_dpi, fit, intentional_hero. templates: template, pos, x, y, w, h (inches).
assets: asset_id, px_w, px_h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import geometry

PAGE_AREA = geometry.PAGE_IN * geometry.PAGE_IN
PAGE_LIMIT = 122


def with_geometry(placements: DataFrame, templates: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds the cell's geometry, the asset's size and dpi. Cells beyond the template's are left out,
    as are empty cells and assets that are not in the table."""
    return (
        placements.where("asset_id IS NOT NULL")
        .join(templates, (placements.template == templates.template) & (placements.cell == templates.pos))
        .drop(templates.template)
        .join(assets.select("asset_id", "px_w", "px_h"), "asset_id")
        .withColumn(
            "dpi",
            geometry.effective_dpi(
                F.col("px_w"), F.col("px_h"), F.col("w"), F.col("h"), F.col("crop_w"), F.col("crop_h")
            ),
        )
    )


def low_dpi(measured: DataFrame) -> DataFrame:
    """Cells below the print floor that no approval covers."""
    open_cell = geometry.below_floor(F.col("dpi")) & ~geometry.override_ok(F.col("override_dpi"), F.col("dpi"))
    return measured.where(open_cell)


def print_ready(measured: DataFrame) -> DataFrame:
    """One row: print_ready, low_cells. The cells themselves come from ``low_dpi``."""
    open_cell = geometry.below_floor(F.col("dpi")) & ~geometry.override_ok(F.col("override_dpi"), F.col("dpi"))
    return measured.agg(F.count_if(open_cell).alias("low_cells")).select(
        (F.col("low_cells") == 0).alias("print_ready"), "low_cells"
    )


class NotPrintReady(ValueError):
    """The book may not be exported."""


def export_gate(measured: DataFrame, page_in: float = geometry.PAGE_IN, flagged: bool | None = None) -> None:
    """Refuse another page size, a mock-up, or any open low-resolution cell."""
    if abs(page_in - geometry.PAGE_IN) > 1e-6:
        raise NotPrintReady(f"only {geometry.PAGE_IN:g} inch pages can be exported, not {page_in:g}")
    if flagged is False:
        raise NotPrintReady("the book is marked as a mock-up")
    state = print_ready(measured).first()
    if not state["print_ready"]:
        raise NotPrintReady(f"{state['low_cells']} cells print below {geometry.DPI_FLOOR} dpi")


def page_coverage(placements: DataFrame, templates: DataFrame) -> DataFrame:
    """(spread, side, coverage): placed cell area over page area."""
    return (
        placements.join(templates, (placements.template == templates.template) & (placements.cell == templates.pos), "left")
        .drop(templates.template)
        .groupBy("spread", "side")
        .agg(
            (F.sum(F.when(F.col("asset_id").isNotNull(), F.col("w") * F.col("h")).otherwise(0.0)) / PAGE_AREA).alias("coverage")
        )
    )


def distribution(values: DataFrame, value: str) -> DataFrame:
    """One row over the positive values: n, lowest, p10 (element n div 10 in order), median, highest.

    Equal values are counted first; the ranks come from range partitions, not from one sorted task.
    """
    from gleaner.session import cut_lineage

    counted = values.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(counted.repartitionByRange(parts, "v").withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.sum("c").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    inside = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("c").over(inside)
    ranked = spread.join(before, "_part").withColumn("_upto", upto)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("v")))
    n = F.col("n")
    return ranked.agg(
        F.max("n").alias("n"), F.min("v").alias("lowest"), at(F.floor(n / 10)).alias("p10"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), F.max("v").alias("highest"),
    )


def dpi_counts(measured: DataFrame) -> DataFrame:
    return measured.agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("dpi") < geometry.SOFT_DPI).alias("below_soft"),
        F.count_if(F.col("dpi") < geometry.DPI_FLOOR).alias("below_floor"),
    )


def needed_pixels(measured: DataFrame, target: float = 300.0, act_below: float = 258.0) -> DataFrame:
    """(asset_id, needed): the longest side each source needs, over its placements that print too low."""
    share = lambda c: F.coalesce(c, F.lit(1.0))
    side = F.greatest(F.col("w") / share(F.col("crop_w")), F.col("h") / share(F.col("crop_h"))) * target
    cropped = F.least(
        share(F.col("crop_w")) * F.col("px_w") / F.col("w"), share(F.col("crop_h")) * F.col("px_h") / F.col("h")
    )
    return measured.where(cropped < act_below).groupBy("asset_id").agg(F.max(side).alias("needed"))


def template_usage(placements: DataFrame) -> DataFrame:
    """(template, pages, shared): a template used by more than one page must be cloned before a rewrite."""
    pages = placements.where("asset_id IS NOT NULL").select("template", "spread", "side").distinct()
    return pages.groupBy("template").agg(F.count("*").alias("pages")).withColumn("shared", F.col("pages") > 1)


def movers(before: DataFrame, after: DataFrame, shown: int = 6) -> DataFrame:
    """Spreads with the largest coverage gain: a report of the top few."""
    a = after.withColumnRenamed("coverage", "after")
    gain = before.join(a, ["spread", "side"]).groupBy("spread").agg(F.sum(F.col("after") - F.col("coverage")).alias("gain"))
    return gain.orderBy(F.desc("gain"), "spread").limit(shown)


def book_checks(
    placements: DataFrame, templates: DataFrame, assets: DataFrame, windows: DataFrame
) -> DataFrame:
    """All failures as (check, spread, page_number, cell, asset_id, detail).

    assets also holds date_trusted and day; windows: chapter, window_start, window_end. Pages without
    any cell appear in placements as one row with a NULL cell.
    """
    geometry_rows = templates.groupBy("template").agg(F.count("*").alias("n_cells"))
    pages = placements.groupBy("spread", "side", "page_number", "template").agg(
        F.count("cell").alias("n_assets"), F.max("intentional_hero").alias("hero")
    ).join(geometry_rows, "template", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
    null = lambda kind: F.lit(None).cast(kind)

    def row(check: str, cell=null("bigint"), asset=null("string"), detail=null("string")):
        return F.struct(
            F.lit(check).alias("check"), F.col("spread").cast("bigint").alias("spread"),
            F.col("page_number").cast("bigint").alias("page_number"),
            cell.cast("bigint").alias("cell"), asset.alias("asset_id"), detail.alias("detail"),
        )

    filled = F.col("n_assets") > 0
    per_page = pages.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(~filled, row("blank")),
                    F.when((F.col("n_assets") == 1) & ~F.coalesce("hero", F.lit(False)), row("sparse")),
                    F.when(
                        filled & (F.col("n_cells") != F.col("n_assets")),
                        row("cell_count", detail=F.concat_ws("/", F.col("n_cells").cast("string"), F.col("n_assets").cast("string"))),
                    ),
                )
            )
        )
    )
    measured = with_geometry(placements, templates, assets).join(
        assets.select("asset_id", "date_trusted", "day"), "asset_id"
    ).join(windows, "chapter", "left")
    # The automatic draft is measured uncropped.
    dpi = geometry.effective_dpi(F.col("px_w"), F.col("px_h"), F.col("w"), F.col("h"))
    outside = F.col("date_trusted") & (F.col("day") != "") & (
        (F.col("day") < F.col("window_start")) | (F.col("day") > F.col("window_end"))
    )
    at, who = F.col("cell"), F.col("asset_id")
    per_cell = measured.withColumn("_dpi", dpi).select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(F.col("fit") != "contain", F.lit(True)), row("implicit_crop", at, who, F.col("fit"))),
                    F.when(geometry.below_floor(F.col("_dpi")), row("low_dpi", at, who, F.format_string("%.1f", F.round(F.col("_dpi") + 1e-9, 1)))),
                    F.when(outside, row("era_outlier", at, who, F.col("day"))),
                )
            )
        )
    )
    twice = with_geometry(placements, templates, assets).groupBy("asset_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate").alias("check"), null("bigint").alias("spread"), null("bigint").alias("page_number"),
        null("bigint").alias("cell"), "asset_id", null("string").alias("detail"),
    )
    weight = geometry.page_weight(F.col("n_cells"))
    pairs = pages.groupBy("spread").agg(F.count_if(weight == 3).alias("heavy")).where("heavy = 2").select(
        F.lit("invalid_pair").alias("check"), F.col("spread").cast("bigint").alias("spread"), null("bigint").alias("page_number"),
        null("bigint").alias("cell"), null("string").alias("asset_id"), null("string").alias("detail"),
    )
    return per_page.unionByName(per_cell).unionByName(twice).unionByName(pairs)


# The checks that stop an automatic draft.
FATAL = ("blank", "sparse", "implicit_crop", "cell_count", "duplicate", "invalid_pair")


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(F.count("*").alias("n")).withColumn("fatal", F.col("check").isin(*FATAL))


def facing_pairs(placements: DataFrame, templates: DataFrame) -> DataFrame:
    """(spread, left_template, right_template, left_weight, right_weight, valid)."""
    sizes = templates.groupBy("template").agg(F.count("*").alias("n_cells"))
    pages = placements.select("spread", "side", "template").distinct().join(sizes, "template").withColumn(
        "weight", geometry.page_weight(F.col("n_cells"))
    )
    side = lambda s: pages.where(F.col("side") == s).select(
        "spread", F.col("template").alias(f"{s}_template"), F.col("weight").alias(f"{s}_weight")
    )
    return side("left").join(side("right"), "spread").withColumn(
        "valid", ~((F.col("left_weight") == 3) & (F.col("right_weight") == 3))
    )


def imposed_pages(pages: DataFrame) -> DataFrame:
    """Pages in print order with one blank leaf at each end: page_no, side, spread, recto.

    pages: spread, side (every designed page once).
    """
    designed = pages.select(
        (F.col("spread") * 2 + F.when(F.col("side") == "left", 2).otherwise(3)).alias("page_no"), "spread", "side"
    )
    last = pages.agg(F.max("spread").alias("s"))
    leaf = lambda no, name: last.select(no.cast("bigint").alias("page_no"), F.lit(-1).cast("bigint").alias("spread"), F.lit(name).alias("side"))
    return designed.unionByName(leaf(F.lit(1), "front")).unionByName(leaf(F.col("s") * 2 + 4, "back")).withColumn(
        "recto", geometry.is_recto(F.col("page_no"))
    )


def carry_captions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New placements with the captions of the old ones, by asset; the last captioned cell wins.

    old: spread, side, cell, asset_id, caption. new: asset_id and any other columns but caption.
    """
    kept = F.when(F.trim("caption") != "", F.col("caption"))
    order = F.struct("spread", F.when(F.col("side") == "left", 0).otherwise(1), "cell")
    last = old.where(F.col("asset_id").isNotNull()).withColumn("caption", kept).where("caption IS NOT NULL").groupBy(
        "asset_id"
    ).agg(F.max_by("caption", order).alias("caption"))
    return new.join(last, "asset_id", "left")


def book_summary(pages: DataFrame, accepted_count: DataFrame) -> DataFrame:
    """One row: spreads, pages, chapters, placed, unplaced, average per page, within the page limit.

    pages: spread, chapter, asset_id. accepted_count: one row with n.
    """
    totals = pages.agg(
        F.count_distinct("spread").alias("spreads"), F.count_distinct("chapter").alias("chapters"),
        F.count("asset_id").alias("placed"),
    )
    sheets = F.col("spreads") * 2
    parts = totals.unionByName(accepted_count.select("n"), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in ("spreads", "chapters", "placed", "n")]).select(
        "spreads", sheets.alias("pages"), "chapters", "placed", (F.col("n") - F.col("placed")).alias("unplaced"),
        F.bround(F.col("placed") / F.greatest(F.lit(1), sheets), 1).alias("per_page"),
        (sheets <= PAGE_LIMIT).alias("within_limit"),
    )
