"""Column functions on small rows: geometry, dates, names, hashes."""

from pyspark.sql import functions as F

from gleaner.functions import dates, geometry, hashing, text
from gleaner.sources import files

BOX = [0.12, 0.12, 11.76, 11.76]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def dpi(spark, w, h, cell=BOX, crop=None):
    extra = [F.lit(c) for c in crop] if crop else []
    return value(spark, geometry.effective_dpi(F.lit(w), F.lit(h), F.lit(float(cell[2])), F.lit(float(cell[3])), *extra))


def test_constants():
    assert geometry.PAGE_IN == 12.0 and geometry.DPI_FLOOR == 240


def test_dpi_full_page_square(spark):
    assert 290 < dpi(spark, 3600, 3600) < 320


def test_crop_lowers_dpi(spark):
    assert dpi(spark, 3600, 3600, crop=(0.5, 0.5)) < dpi(spark, 3600, 3600)


def test_dpi_zero_without_size(spark):
    assert dpi(spark, 0, 0, [0, 0, 6, 6]) == 0.0


def test_override(spark):
    ok = lambda o, d: value(spark, geometry.override_ok(F.lit(o).cast("string"), F.lit(float(d))))
    assert ok("100", 99.6) and not ok("100", 99.4)
    assert ok("soon", 1) and not ok(None, 500) and not ok("0", 500)


def test_contained_wide_picture(spark):
    s = value(spark, geometry.contained_size(F.lit(4000), F.lit(2000), F.lit(6.0), F.lit(6.0)))
    assert (s["w"], s["h"]) == (6.0, 3.0)


def test_cover_crop_follows_faces(spark):
    face = F.array(F.struct(F.lit(0.8).alias("x0"), F.lit(0.1).alias("y0"), F.lit(0.95).alias("x1"), F.lit(0.3).alias("y1")))
    crop = value(spark, geometry.cover_crop(F.lit(2000), F.lit(1000), F.lit(1.0), face, F.lit(True)))
    assert crop["w"] == 0.5 and crop["x"] == 0.5
    assert not value(spark, geometry.clips_a_face(F.struct(*[F.lit(crop[k]).alias(k) for k in "xywh"]), face))


def test_recto_and_spread(spark):
    assert value(spark, geometry.is_recto(F.lit(1))) and not value(spark, geometry.is_recto(F.lit(2)))
    assert [value(spark, geometry.spread_of_page(F.lit(p))) for p in (2, 3, 4)] == [0, 0, 1]


def test_hex_round_trip(spark):
    for h in ("ffffffffffffffff", "8000000000000001", "00000000000000ff"):
        assert value(spark, hashing.hex_from_bits(hashing.bits_from_hex(F.lit(h)))) == h
    assert value(spark, hashing.bits_from_hex(F.lit("xyz"))) is None
    far = hashing.hamming_or_far(F.lit(None).cast("bigint"), F.lit(3).cast("bigint"))
    assert value(spark, far) == 99


def test_fingerprint_bits(spark):
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    assert value(spark, hashing.hex_from_bits(hashing.fingerprint64(v))) == "00000000ffffffff"
    assert value(spark, hashing.fingerprint64(F.array(F.lit(1.0)))) is None


def test_filename_dates(spark):
    cases = {
        "IMG-20180813-WA0001.jpg": "2018-08-13T12:00:00",
        "signal-2020-01-15-x.jpg": "2020-01-15T12:00:00",
        "PXL_20220231_1.jpg": None,  # no such day, and the generic pattern finds the same digits
        "PXL_20220101_000001.jpg": "2022-01-01T12:00:00",
        "x20361301.jpg": None,
        "DSC_0001.jpg": None,
    }
    for name, want in cases.items():
        assert value(spark, dates.date_from_filename(F.lit(name))) == want, name


def test_resolution_order(spark):
    null = F.lit(None).cast("string")
    pick = lambda *a: tuple(value(spark, dates.resolve_datetime(*a)))
    assert pick(F.lit("0000:00:00"), null, F.lit("2020-01-01T00:00:00+00:00"), F.lit("a"), null)[1] == "sidecar"
    assert pick(null, F.lit("2019-01-01T00:00:00"), F.lit("x"), F.lit("a"), null)[1:] == ("exif", "high")
    assert pick(null, null, null, F.lit("a"), F.lit("2001-01-01T00:00:00"))[1:] == ("mtime", "low")
    assert pick(null, null, null, F.lit("a"), null) == ("1970-01-01T00:00:00+00:00", "mtime", "low")


def test_event_dates(spark):
    parse = lambda s: value(spark, dates.parse_event_date(F.lit(s)))
    assert parse(" 2024-02-29 ") == "2024-02-29T12:00:00"
    assert parse("2024-02") == "2024-02-15T12:00:00" and parse("2024") == "2024-07-01T12:00:00"
    assert parse("2023-02-29") is None and parse("soon") is None and parse("") is None


def test_offset_is_dropped_for_the_day(spark):
    assert value(spark, dates.day_key(F.lit("2024-01-01T23:30:00-05:00"))) == "2024-01-01"
    assert value(spark, dates.day_key(F.lit("2024-01-01T23:30:00Z"))) == "2024-01-01"
    assert value(spark, dates.day_key(F.lit(None).cast("string"))) == "nodate"


def test_clamped_dates(spark):
    clamp = lambda d, t: value(spark, dates.clamped_sort_date(F.lit(d).cast("string"), F.lit(t), F.lit("2001-01-01"), F.lit("2003-12-31")))
    assert clamp("1999-05-05T00:00:00", "fallback") == "2001-01-01"
    assert clamp("2009-05-05T00:00:00", "synthetic") == "2003-12-31"
    assert clamp("2009-05-05T00:00:00", "authoritative") == "2009-05-05T00:00:00"
    assert clamp(None, "fallback") == "2001-01-01" and clamp(None, "authoritative") == "9999"


def test_names(spark):
    assert value(spark, text.slug(F.lit("--Beach Day!--"))) == "beach-day"
    counter = lambda n: value(spark, text.filename_counter(F.lit(n)))
    assert tuple(counter("/a/img_0042.JPG")) == ("IMG", 42)
    assert counter("PXL_20240622.jpg") is None and counter("IMG_20240622.jpg") is None
    assert value(spark, text.filename_family(F.lit("/x/beach-day-2024-with-all-of-us.jpg"))) == "beach-day-with"
    assert value(spark, text.filename_family(F.lit("/x/IMG_1.jpg"))) is None
    assert value(spark, text.relative_path(F.lit("/a/b/c.jpg"), F.lit("/a"))) == "b/c.jpg"
    assert value(spark, text.relative_path(F.lit("/z/c.jpg"), F.lit("/a"))) == "c.jpg"
    name = text.label_filename(F.lit("03_summer"), F.lit("Beach Day"), F.lit("family, kids"), F.lit(3), F.lit("8fafe66200"), F.lit(".jpg"))
    assert value(spark, name) == "03-summer__beach-day__family_kids__0003_8fafe662.jpg"
    assert value(spark, text.is_asset_id(F.lit("a" * 40))) and not value(spark, text.is_asset_id(F.lit("A" * 40)))


def test_sidecar_names_and_content(spark):
    names = value(spark, files.sidecar_names(F.lit("/d/image(1).jpg")))
    assert names[0] == "image(1).jpg.supplemental-metadata.json"
    assert "image.jpg(1).supplemental-metadata.json" in names and "image.json" in names
    assert len(names) == len(set(names)) == 60 - 12  # image(1).jpg comes up twice
    parse = lambda s: tuple(value(spark, files.parse_sidecar(F.lit(s))))
    assert parse('{"photoTakenTime":{"timestamp":"0"},"favorited":"true","people":[1,2]}') == ("1970-01-01T00:00:00+00:00", True, 2)
    assert parse('{"creationTime":{"timestamp":60},"favorite":0}') == ("1970-01-01T00:01:00+00:00", False, None)
    assert parse("{}") == (None, None, None) and parse("not json") == (None, None, None)


def test_only_full_dates_are_dates(spark):

    forms = ["2024", "2024-05", "2024-05-06", "20240506", "2024-05-06T07:08:09", "20240506T070809", "2024-05-06 07:08:09Z", "2024-05-06x", "", None]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(dates.day_key(F.col("t"))).collect()]
    assert got[:2] == ["nodate"] * 2 and got[2:5] == ["2024-05-06"] * 3 and got[6] == "2024-05-06" and got[7:] == ["nodate"] * 3


def test_variance_has_the_digits_of_the_sql(spark):
    """The same numbers in another order may differ in the last digit; a tie at the threshold must fall as in the SQL."""
    import random

    import duckdb

    rng = random.Random(7)
    rows = [[float(rng.randint(0, 90)) for _ in range(64)] for _ in range(300)]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<double>").select(
        "i", hashing.second_difference_variance(F.col("v")).alias("curve"), hashing.level_stddev(F.col("v")).alias("spread")
    )
    want = duckdb.execute("SELECT list_var_pop(list_transform(range(2, 64), lambda i: v[i-1] - 2 * v[i] + v[i+1])), list_stddev_pop(v) "
                          "FROM (SELECT unnest(?::DOUBLE[][]) AS v)", [rows]).fetchall()
    assert [(r["curve"], r["spread"]) for r in found.orderBy("i").collect()] == want
