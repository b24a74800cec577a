"""Page geometry in inches: fit, resolution, crops and page labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.session import bind

# Page geometry and resolution limits.
PAGE_IN = 12.0
MARGIN = 0.12
GUTTER = 0.05
TITLE_BAND = 0.65
DPI_IDEAL = 300
DPI_FLOOR = 240
SOFT_DPI = 110.0
CROP_CAP = 0.45
CROP_CAP_CAUTIOUS = 0.12
CROP_CAP_BLIND = 0.15
FILL_CAP = 0.55
EPS = 1e-6


def aspect(w: Column, h: Column) -> Column:
    width = F.when(F.coalesce(w, F.lit(0)) == 0, 1).otherwise(w)
    return width / F.greatest(F.lit(1), F.coalesce(h, F.lit(1)))


def contained_size(w: Column, h: Column, cell_w: Column, cell_h: Column) -> Column:
    """Struct (w, h): printed inches of the whole picture inside the cell."""
    ratio = aspect(w, h)
    wide = ratio >= cell_w / F.greatest(F.lit(0.0001), cell_h)
    return F.struct(
        F.when(wide, cell_w).otherwise(cell_h * ratio).alias("w"),
        F.when(wide, cell_w / ratio).otherwise(cell_h).alias("h"),
    )


def effective_dpi(
    w: Column, h: Column, cell_w: Column, cell_h: Column, crop_w: Column | None = None, crop_h: Column | None = None
) -> Column:
    """Print resolution: the whole picture contained, or its crop window covering the cell."""
    width, height = w.cast("double"), h.cast("double")
    unusable = (
        (F.coalesce(width, F.lit(0.0)) <= 0) | (F.coalesce(height, F.lit(0.0)) <= 0)
        | (F.coalesce(cell_w, F.lit(0.0)) <= 0) | (F.coalesce(cell_h, F.lit(0.0)) <= 0)
    )
    ratio = aspect(w, h)
    wide = ratio >= cell_w / F.greatest(F.lit(0.0001), cell_h)
    print_w = F.when(wide, cell_w).otherwise(cell_h * ratio)
    print_h = F.when(wide, cell_w / ratio).otherwise(cell_h)
    contained = F.least(
        width / F.greatest(F.lit(EPS), print_w), height / F.greatest(F.lit(EPS), print_h)
    )
    if crop_w is None or crop_h is None:
        return F.when(unusable, 0.0).otherwise(contained)
    full = lambda share: F.when(share == 0, 1.0).otherwise(share)
    covered = F.least(width * full(crop_w) / cell_w, height * full(crop_h) / cell_h)
    has_crop = crop_w.isNotNull() & crop_h.isNotNull()
    return F.when(unusable, 0.0).when(has_crop, covered).otherwise(contained)


def override_ok(override_dpi: Column, dpi: Column) -> Column:
    """A recorded approval covers a cell if it approved this resolution or a worse one.

    An approval whose number cannot be read still counts; an empty or zero one does not.
    """
    number = override_dpi.try_cast("double")
    present = override_dpi.isNotNull() & (override_dpi != "") & (F.coalesce(number, F.lit(1.0)) != 0)
    return F.coalesce(present & (number.isNull() | (number <= dpi + 0.5)), F.lit(False))


def below_floor(dpi: Column, floor: float = DPI_FLOOR) -> Column:
    return dpi + 0.1 < floor


def cell_dpi(w: Column, h: Column, cell_w: Column, cell_h: Column) -> Column:
    usable = (F.coalesce(w, F.lit(0)) > 0) & (F.coalesce(h, F.lit(0)) > 0) & (cell_w > 0) & (cell_h > 0)
    return F.when(usable, F.least(w / cell_w, h / cell_h)).otherwise(0.0)


def shrink_to_dpi(x, y, cell_w, cell_h, w, h, floor: float = DPI_FLOOR) -> Column:
    """Struct (x, y, w, h): the cell shrunk round its centre until it prints at the floor."""
    dpi = cell_dpi(w, h, cell_w, cell_h)
    f = F.when((dpi <= 0) | (dpi >= floor), 1.0).otherwise(F.greatest(F.lit(0.1), dpi / floor))
    return F.when(f == 1.0, box(x, y, cell_w, cell_h)).otherwise(
        rounded_box(
            x + (cell_w - cell_w * f) / 2, y + (cell_h - cell_h * f) / 2, cell_w * f, cell_h * f
        )
    )


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def rounded_box(x, y, w, h) -> Column:
    return box(F.round(x, 4), F.round(y, 4), F.round(w, 4), F.round(h, 4))


def cover_crop(w: Column, h: Column, target: Column, faces: Column, use_faces: Column) -> Column:
    """Crop window of the target aspect, centred on the faces, then nudged over each face in turn."""
    ratio = w / F.greatest(F.lit(EPS), h)
    crop_w = F.least(F.lit(1.0), F.when(ratio >= target, target / ratio).otherwise(1.0))
    crop_h = F.least(F.lit(1.0), F.when(ratio >= target, 1.0).otherwise(ratio / target))
    count = F.size(faces)
    centred = use_faces & (count > 0)

    def centre(lo: str, hi: str) -> Column:
        total = F.aggregate(faces, F.lit(0.0), lambda acc, f: acc + (f[lo] + f[hi]) / 2)
        return F.when(centred, total / count).otherwise(0.5)

    def clamp(value: Column, size: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), 1.0 - size)

    def nudge(at: Column, size: Column, lo: Column, hi: Column) -> Column:
        left = F.when(lo < at, F.greatest(F.lit(0.0), F.least(lo, 1.0 - size))).otherwise(at)
        return F.when(
            hi > left + size, F.least(1.0 - size, F.greatest(left, hi - size))
        ).otherwise(left)

    def walk(s: Column) -> Column:
        start = F.struct(
            clamp(s["fx"] - s["cw"] / 2, s["cw"]).alias("x"),
            clamp(s["fy"] - s["ch"] / 2, s["ch"]).alias("y"),
        )
        moved = F.aggregate(
            s["faces"],
            start,
            lambda acc, f: F.struct(
                nudge(acc["x"], s["cw"], f["x0"], f["x1"]).alias("x"),
                nudge(acc["y"], s["ch"], f["y0"], f["y1"]).alias("y"),
            ),
        )
        return bind(moved, lambda m: rounded_box(m["x"], m["y"], s["cw"], s["ch"]))

    state = F.struct(
        crop_w.alias("cw"), crop_h.alias("ch"), centre("x0", "x1").alias("fx"),
        centre("y0", "y1").alias("fy"), faces.alias("faces"),
    )
    return bind(state, walk)


def clips_a_face(crop: Column, faces: Column) -> Column:
    """Is any face box not fully inside the crop window? No crop clips nothing."""
    outside = F.exists(
        faces,
        lambda f: (f["x0"] < crop["x"] - EPS) | (f["y0"] < crop["y"] - EPS)
        | (f["x1"] > crop["x"] + crop["w"] + EPS) | (f["y1"] > crop["y"] + crop["h"] + EPS),
    )
    return F.coalesce(outside, F.lit(False))


def contain_cell(w, h, is_hero: Column, x, y, cell_w, cell_h, floor: float = SOFT_DPI) -> Column:
    """Largest rectangle of the picture's aspect in the box, shrunk to the soft floor; heroes never shrink."""
    ratio = aspect(w, h)
    wide_box = cell_w / F.greatest(F.lit(EPS), cell_h) >= ratio
    bw = F.when(wide_box, cell_h * ratio).otherwise(cell_w)
    bh = F.when(wide_box, cell_h).otherwise(cell_w / ratio)

    def finish(b: Column) -> Column:
        dpi = F.least(
            F.coalesce(w, F.lit(0)) / F.greatest(F.lit(EPS), b["w"]),
            F.coalesce(h, F.lit(0)) / F.greatest(F.lit(EPS), b["h"]),
        )
        soft = ~F.coalesce(is_hero, F.lit(False)) & (dpi > 0) & (dpi < floor)
        scale = F.when(soft, dpi / floor).otherwise(1.0)
        fw, fh = b["w"] * scale, b["h"] * scale
        return rounded_box(x + (cell_w - fw) / 2, y + (cell_h - fh) / 2, fw, fh)

    return bind(F.struct(bw.alias("w"), bh.alias("h")), finish)


def resolve_cell(
    w, h, is_hero, people_count, name, curated, faces, x, y, cell_w, cell_h
) -> Column:
    """Struct (fit, crop, box): cover where that is sharp, within the crop cap and clips no face."""
    found = F.size(faces)
    cautious = F.coalesce(people_count > found, F.lit(False))
    whole = (
        F.coalesce(curated, F.lit(False))
        | F.upper(F.coalesce(name, F.lit(""))).contains("COLLAGE")
        | F.lower(F.coalesce(name, F.lit(""))).contains("_all_")
    )
    cap = F.when(cautious, CROP_CAP_CAUTIOUS).when(found == 0, CROP_CAP_BLIND).otherwise(CROP_CAP)
    size = lambda v: F.when(F.coalesce(v, F.lit(0)) == 0, 1).otherwise(v)
    crop = cover_crop(
        size(w), size(h), cell_w / F.greatest(F.lit(EPS), cell_h), faces, ~cautious
    )

    def decide(c: Column) -> Column:
        dpi = effective_dpi(w, h, cell_w, cell_h, c["w"], c["h"])
        cover = (
            ~whole
            & (1.0 - c["w"] * c["h"] <= cap + EPS)
            & ~clips_a_face(c, faces)
            & ((dpi >= SOFT_DPI) | F.coalesce(is_hero, F.lit(False)))
        )
        return F.struct(
            F.when(cover, "cover").otherwise("contain").alias("fit"),
            F.when(cover, c).alias("crop"),
            F.when(cover, rounded_box(x, y, cell_w, cell_h))
            .otherwise(contain_cell(w, h, is_hero, x, y, cell_w, cell_h))
            .alias("box"),
        )

    return bind(crop, decide)


# --- page labels ------------------------------------------------------------------------------


def page_weight(count: Column) -> Column:
    return F.when(count <= 3, 1).when(count <= 5, 2).otherwise(3)


def layout_role(count: Column) -> Column:
    return F.when(count <= 2, "feature").when(count >= 4, "cluster").otherwise("sequence")


# Recipe family per number of pictures.
STYLE_NAMES = ("single_feature", "two_up", "three_up", "four_up", "five_up", "six_up", "seven_gallery")


def layout_style(count: Column) -> Column:
    """Recipe family; NULL beyond seven pictures, which no family covers."""
    return F.try_element_at(F.array(*[F.lit(s) for s in STYLE_NAMES]), F.nullif(count, F.lit(0)).cast("int"))


def spread_archetype(left: Column, right: Column, has_panorama: Column, opener: Column) -> Column:
    return (
        F.when(has_panorama & ~opener, "panorama_plus_support")
        .when(opener & (left == 3) & (right == 1), "chapter_triptych_plus_feature")
        .when(opener & (left == 2) & (right == 2), "chapter_balanced_pair")
        .when(opener & (left >= 3) & (right >= 3), "chapter_dense_pair")
        .when(opener & (left < right), "chapter_feature_plus_cluster")
        .when(left < right, "feature_plus_cluster")
        .when(left > right, "cluster_plus_feature")
        .otherwise("balanced_sequence")
    )


def is_panorama(w: Column, h: Column) -> Column:
    return aspect(w, h) >= 2.2


def is_recto(page_no: Column) -> Column:
    return F.pmod(page_no, F.lit(2)) == 1


def spread_of_page(page_no: Column) -> Column:
    """Zero-based spread of an imposed page; page 1 is the blank front leaf."""
    return F.floor((page_no - 2) / 2)
