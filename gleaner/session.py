"""Session defaults, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A driver-built dimension above this many rows is joined without a broadcast hint.
BROADCAST_ROW_LIMIT = 10_000


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; cluster sizing stays with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one of our own only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    A lost executor then costs no finished round, and the written sizes let Spark choose the joins
    of the next one.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._folder = path
    return rows


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system its path names; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder inside its file system; False if there is none. A rename that fails raises."""
    jvm = spark._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(here):
        return False
    system.mkdirs(there.getParent())
    if not system.rename(here, there):
        raise OSError(f"could not move {source} to {target}")
    return True


def release(rows: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote, once nothing reads it any more."""
    folder = getattr(rows, "_folder", None)
    if folder:
        remove_folder(rows.sparkSession, folder)


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before heavy per-row work.

    A large table has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A configuration table. It is broadcast only while its known row count is small."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    if len(rows) <= 256:
        literals = [
            F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)])
            for row in rows
        ]
        table = spark.range(1).select(F.inline(F.array(*literals)))
    else:
        table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROW_LIMIT else table


def refuse(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows as they are; the job fails with the message if ``bad`` holds for one of them."""
    return rows.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers; on a cluster it is installed or sent along."""
    root = str(Path(__file__).resolve().parent.parent)
    own = spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([*paths, root])


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, like a let-expression."""
    return F.transform(F.array(value), body)[0]
