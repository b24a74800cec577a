"""File names, labels, tags and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 become one hyphen."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def split_tags(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root`` with forward slashes; the base name when it lies elsewhere."""
    clean, base = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(root, F.lit("/"))
    inside = F.startswith(clean, F.concat(base, F.lit("/")))
    return F.when(inside, F.substr(clean, F.length(base) + 2)).otherwise(base_name(path))


def is_asset_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{40}$")


def filename_counter(path: Column) -> Column:
    """Struct (prefix, number) of camera counter names such as IMG_0042; NULL for other names."""
    shape = r"(?i)^(IMG|DSC|DSCN|PICT|CIMG)_?([0-9]{3,4})\b"
    name = base_name(path)
    return F.when(
        name.rlike(shape),
        F.struct(
            F.upper(F.regexp_extract(name, shape, 1)).alias("prefix"),
            F.regexp_extract(name, shape, 2).try_cast("int").alias("number"),
        ),
    )


# Camera and app prefixes that say nothing about the content.
NOISE_NAME = "^(img|pxl|dsc|signal|whatsapp|image|photo|screenshot|[0-9])"


def filename_family(path: Column) -> Column:
    """First three words of a descriptive name; NULL for camera and app names."""
    label = slug(stem(path))
    words = F.filter(F.split(label, "-"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    family = F.array_join(F.slice(words, 1, 3), "-")
    return F.when((label != "") & ~label.rlike(NOISE_NAME), F.nullif(family, F.lit("")))


def label_filename(
    chapter: Column, event: Column, tags: Column, index: Column, asset_id: Column, ext: Column
) -> Column:
    """era__event__tag_tag__NNNN_id8.ext; empty parts are left out."""
    tag_part = F.array_join(
        F.filter(F.transform(split_tags(tags), slug), lambda t: t != ""), "_"
    )
    head = F.concat_ws(
        "__", slug(chapter), F.nullif(slug(event), F.lit("")), F.nullif(tag_part, F.lit(""))
    )
    return F.concat(head, F.lit("__"), _numbered(index), F.lit("_"), F.substring(asset_id, 1, 8), ext)


def plain_filename(index: Column, date: Column, asset_id: Column, ext: Column) -> Column:
    return F.concat(
        _numbered(index), F.lit("_"), date, F.lit("_"), F.substring(asset_id, 1, 8), ext
    )


def _numbered(index: Column) -> Column:
    digits = index.cast("string")
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
