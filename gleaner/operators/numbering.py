"""Row numbers over large ordered sets, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def number_rows(df: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds 1..n within each ``by`` group (or over everything) in the given order.

    Rows are range-partitioned on (by, order), so a group larger than a task is spread over several.
    Each row's number is its place inside its partition plus the size of the group's earlier ones.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(
        df.repartitionByRange(partitions, *by, *order).withColumn("_part", F.spark_partition_id())
    )
    keys = [F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(f"_by{i}") for i, b in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    spread = spread.select("*", *keys)
    sizes = spread.groupBy("_part", *names).agg(F.count("*").alias("_n"))
    # At most one row per partition and group.
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", *names, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", *names).orderBy(*order))
    return (
        spread.withColumn("_local", local)
        .join(before, ["_part", *names])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_part", "_local", "_before", *names)
    )


def with_previous(df: DataFrame, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds ``name``: a struct of ``columns`` of the row before in ascending ``order``, null for the first row of all.

    Rows are range-partitioned on the whole order, so equal leading keys are spread as well as long groups are. Neighbours
    inside a partition come from a window over it; the last row of each partition is carried to the next.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    own = F.struct(*columns)
    ends = spread.groupBy("_part").agg(F.max_by(own, F.struct(*order)).alias("_end"))
    # One row per partition that has rows.
    carried = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_carried"))
    before = F.lag(own).over(Window.partitionBy("_part").orderBy(*order))
    return (
        spread.withColumn("_before", before).join(carried, "_part")
        .withColumn(name, F.coalesce("_before", "_carried")).drop("_part", "_before", "_carried")
    )


def paginate(df: DataFrame, order: list[Column | str], page_size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds page_no (1-based) and place on the page."""
    numbered = number_rows(df, order, "_no", by)
    at = F.col("_no") - 1
    return numbered.select(
        *[c for c in numbered.columns if c != "_no"],
        (F.floor(at / page_size) + 1).alias("page_no"),
        (at % page_size + 1).alias("place"),
    )
