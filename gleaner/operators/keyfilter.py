"""Key filters of written files: which files may hold a key, told without opening them.

A file has one Bloom filter, cut into bitmaps of 32,768 bits. A key belongs to one bitmap of each file and sets
``PROBES`` bits there, so a lookup is an equi-join on (part, number of bitmaps, bitmap) and not a scan of whole filters.
At 24 bits a key about one absent key in 100,000 is reported; a present key always is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 32_768  # the size that bitmap_construct_agg builds
BITS_PER_KEY = 24
PROBES = 16
SCHEMA = "part string, file string, n_bitmaps long, bitmap long, bits binary, batch string"


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key))


def _bitmap(h: Column, n_bitmaps: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 30), n_bitmaps)


def _positions(h: Column) -> Column:
    """Distinct places inside a bitmap: steps of an odd width from a start, both from the low 30 bits."""
    start = h.bitwiseAND(F.lit(BITMAP_BITS - 1))
    width = F.shiftright(h, 15).bitwiseAND(F.lit(BITMAP_BITS - 1)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(start + i * width, F.lit(BITMAP_BITS)))


def build(rows: DataFrame, key: str) -> DataFrame:
    """(part, file, n_bitmaps, bitmap, bits) of rows that name their part and file. A null key counts as a key."""
    keys = rows.select("part", "file", _hash(key).alias("h"))
    needed = F.greatest(F.lit(1.0), F.count("*") * (BITS_PER_KEY / BITMAP_BITS))
    # A power of two, so that all files have only a few different numbers of bitmaps.
    sizes = keys.groupBy("part", "file").agg(F.pow(F.lit(2.0), F.ceil(F.log2(needed))).cast("long").alias("n_bitmaps"))
    bits = keys.join(sizes, ["part", "file"]).select(
        "part", "file", "n_bitmaps", _bitmap(F.col("h"), F.col("n_bitmaps")).alias("bitmap"),
        F.explode(_positions(F.col("h"))).alias("bit"),
    )
    return bits.groupBy("part", "file", "n_bitmaps", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))


def files_that_may_hold(keys: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """The distinct (batch, part, file) that may hold one of the keys; ``keys`` name their part."""
    sizes = sorted(r[0] for r in filters.select("n_bitmaps").distinct().collect())  # powers of two, 34 at most
    if not sizes:
        return filters.select("batch", "part", "file")
    asked = (
        keys.select("part", _hash(key).alias("h")).distinct()
        .select("part", "h", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("n_bitmaps"))
        .withColumn("bitmap", _bitmap(F.col("h"), F.col("n_bitmaps")))
    )
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda p: F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1
    return (
        asked.join(filters, ["part", "n_bitmaps", "bitmap"])
        .where(F.forall(_positions(F.col("h")), is_set))
        .select("batch", "part", "file").distinct()
    )
