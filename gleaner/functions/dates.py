"""Dates kept as ISO text, with the wall time and the instant as two separate readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATE = "nodate"
EPOCH_TEXT = "1970-01-01T00:00:00+00:00"


@dataclass(frozen=True)
class DatePattern:
    """A filename pattern; ``groups`` names its capture groups in order."""

    name: str
    pattern: str
    groups: tuple[str, ...] = ("year", "month", "day")


# File-naming patterns of the supported apps, tried in this order.
DEFAULT_PATTERNS = (
    DatePattern("whatsapp", r"IMG-(\d{4})(\d{2})(\d{2})-WA"),
    DatePattern("signal", r"signal-(\d{4})-(\d{2})-(\d{2})"),
    DatePattern("pixel", r"PXL_(\d{4})(\d{2})(\d{2})"),
    DatePattern("screenshot", r"Screenshot_(\d{4})(\d{2})(\d{2})"),
    DatePattern("generic", r"(20\d{2})(\d{2})(\d{2})"),
)


def wall_time(text: Column) -> Column:
    """Local reading: the offset, if any, is dropped."""
    return _as_text(text).try_cast("timestamp_ntz")


def instant(text: Column) -> Column:
    """Point in time: the offset counts; text without one is read in the session zone."""
    return _as_text(text).try_cast("timestamp")


# Accepted forms: a full date, with or without dashes, alone or followed by a time. A year or a month is no date.
DAY = r"^(\d{4})-?(\d{2})-?(\d{2})(?=$|[T ])"


def _as_text(text: Column) -> Column:
    dashed = F.regexp_replace(text, DAY, "$1-$2-$3")
    return F.when(text.rlike(DAY), F.regexp_replace(dashed, "Z$", "+00:00"))


def wall_date(text: Column) -> Column:
    return wall_time(text).cast("date")


def day_key(text: Column, fallback: str = NO_DATE) -> Column:
    return F.coalesce(F.date_format(wall_time(text), "yyyy-MM-dd"), F.lit(fallback))


def date_prefix(text: Column) -> Column:
    return day_key(text, "0000-00-00")


def month_key(text: Column) -> Column:
    return F.nullif(F.substring(text, 1, 7), F.lit(""))


def date_from_filename(name: Column, patterns: Sequence[DatePattern] = DEFAULT_PATTERNS) -> Column:
    """First pattern whose match is a real date in 1990..2035, as noon of that day."""
    options = []
    for p in patterns:
        part = {g: F.regexp_extract(name, p.pattern, i + 1) for i, g in enumerate(p.groups)}
        if not {"year", "month", "day"} <= part.keys():
            continue
        text = F.concat(
            F.lpad(part["year"], 4, "0"), F.lit("-"), F.lpad(part["month"], 2, "0"),
            F.lit("-"), F.lpad(part["day"], 2, "0"),
        )
        found = name.rlike(p.pattern) & text.try_cast("date").isNotNull()
        in_range = part["year"].try_cast("int").between(1990, 2035)
        options.append(F.when(found & in_range, F.concat(text, F.lit("T12:00:00"))))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def resolve_datetime(
    exif_original: Column,
    exif_create: Column,
    sidecar: Column,
    name: Column,
    mtime: Column,
    patterns: Sequence[DatePattern] = DEFAULT_PATTERNS,
) -> Column:
    """Struct (best_datetime, date_source, date_confidence) from the best source that has a date."""
    original = F.nullif(exif_original, F.lit(""))
    exif = F.coalesce(original, F.nullif(exif_create, F.lit("")))
    exif = F.when(~exif.startswith("0000"), exif)

    def option(value: Column, source: str, confidence: str) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                value.alias("best_datetime"),
                F.lit(source).alias("date_source"),
                F.lit(confidence).alias("date_confidence"),
            ),
        )

    return F.coalesce(
        option(exif, "exif", "high"),
        option(F.nullif(sidecar, F.lit("")), "sidecar", "high"),
        option(date_from_filename(name, patterns), "filename", "medium"),
        option(mtime, "mtime", "low"),
        option(F.lit(EPOCH_TEXT), "mtime", "low"),
    )


def parse_event_date(raw: Column) -> Column:
    """'YYYY-MM-DD', 'YYYY-MM' or 'YYYY' to a noon date inside that day, month or year."""
    text = F.trim(raw)

    def noon(shape: str, day: Column) -> Column:
        real = day.try_cast("date")
        return F.when(
            text.rlike(shape) & real.isNotNull(), F.concat(real.cast("string"), F.lit("T12:00:00"))
        )

    return F.coalesce(
        noon(r"^\d{4}-\d{1,2}-\d{1,2}$", text),
        noon(r"^\d{4}-\d{1,2}$", F.concat(text, F.lit("-15"))),
        noon(r"^\d{4}$", F.concat(text, F.lit("-07-01"))),
    )


# Trust tiers of the date sources.
AUTHORITATIVE = ("exif", "sidecar", "url_path", "filename", "event", "known")
SYNTHETIC = ("filename_seq",)
FALLBACK = ("mtime", "path_year", "epoch", "friend-estimate")


def date_trust(source: Column, confidence: Column) -> Column:
    known = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return (
        F.when(known.isin(*SYNTHETIC), "synthetic")
        .when(known.isin(*FALLBACK), "fallback")
        .when(known.isin(*AUTHORITATIVE), "authoritative")
        .when(F.lower(confidence).isin("high", "medium"), "authoritative")
        .otherwise("fallback")
    )


def clamped_sort_date(best: Column, trust: Column, start: Column, end: Column) -> Column:
    """Untrusted dates may not leave their era's window; trusted ones pass."""
    raw = F.coalesce(best, F.lit(""))
    day = F.substring(raw, 1, 10)
    passes = (trust == "authoritative") | start.isNull()
    return (
        F.when(passes, F.when(raw == "", "9999").otherwise(raw))
        .when((day == "") | (day < start), start)
        .when(day > end, end)
        .otherwise(raw)
    )


def date_sort_key(text: Column) -> Column:
    """Struct (0, ISO text) for a date, (1, text) for anything else."""
    iso = F.regexp_replace(_as_text(text), "^(.{10}) ", "$1T")
    iso = F.when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00"))).otherwise(iso)
    real = wall_time(text).isNotNull() & (F.length(text) >= 10)
    return F.struct(
        F.when(real, 0).otherwise(1).alias("flag"),
        F.when(real, iso).when(F.coalesce(text, F.lit("")) == "", "9999").otherwise(text).alias("text"),
    )


def synthetic_order_time(era_no: Column, index: Column) -> Column:
    """One year per era and one hour per position, so a date sort keeps the order."""
    start = F.make_timestamp_ntz(
        F.greatest(era_no, F.lit(1)) + 2000, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    )
    moved = F.timestamp_add("HOUR", index, start)
    return F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss")
