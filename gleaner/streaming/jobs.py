"""Ingest, decisions, bursts and counters over file streams.

Every sink is idempotent per batch: a replayed batch writes the same rows to the same place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import keyfilter
from gleaner.operators.review import VERDICTS
from gleaner.session import cut_lineage, release, remove_folder


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _stream_name(checkpoint: str) -> str:
    """Names a stream's output by its checkpoint: two streams into one target do not overwrite each other's batches."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:8]


def _write_filters(spark: SparkSession, target: str, batch: str, schema, key: str) -> None:
    """The key filters of one batch's files, built from the keys as they were written."""
    rows = spark.read.schema(schema).parquet(f"{target}/batch={batch}")
    named = rows.select(key, F.col("prefix").alias("part"), F.col("_metadata.file_name").alias("file"))
    keyfilter.build(named, key).write.mode("overwrite").parquet(f"{target}/_keys/filters/batch={batch}")


def stream_ingest(
    arrivals: DataFrame, target: str, checkpoint: str, key: str = "asset_id", at: str = "arrived_at", digits: int = 1,
    opened: Callable[[int, list[str]], None] | None = None,
) -> StreamingQuery:
    """Append each new key once: the first arrival of a batch, unless the key is already written.

    The target is partitioned by batch and by the first hex digits of the key's hash. Beside its files (in ``_keys``,
    which readers of the target do not see) lie their key filters, about 4 bytes a key. A batch looks its keys up in the
    filters of its own partitions and opens only files that may hold one of them; ``opened`` is told their paths.
    A key written by a batch whose filters are missing (a job that died between both, and whose checkpoint is gone) would
    come twice, so missing filters are built when the stream starts. A null key is a key. No watermark: it would drop late
    rows whose key is new, and an ingest must not lose any.
    """
    spark = arrivals.sparkSession
    schema = spark.createDataFrame([], arrivals.schema).withColumn("prefix", F.lit("")).schema
    prefix = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, digits)
    spark.createDataFrame([], arrivals.schema).write.mode("overwrite").parquet(f"{target}/batch=none/prefix=none")
    filters = lambda session: session.read.schema(keyfilter.SCHEMA).parquet(f"{target}/_keys/filters")
    none = spark.createDataFrame([], keyfilter.SCHEMA).drop("batch")
    none.write.mode("overwrite").parquet(f"{target}/_keys/filters/batch=none")
    written = spark.read.schema(schema.add("batch", "string")).parquet(target).select("batch").distinct()
    for row in written.join(filters(spark), "batch", "left_anti").collect():  # names of batches, none as a rule
        _write_filters(spark, target, row["batch"], schema, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        name, session = f"{_stream_name(checkpoint)}-{batch_id}", batch.sparkSession
        first = cut_lineage(
            batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), at).alias("r")).select("r.*").withColumn("prefix", prefix)
        )
        arrived = [r[0] for r in first.select("prefix").distinct().collect()]  # 16 ** digits at most
        # This batch's own rows are left out, so that a replay writes them again.
        earlier = filters(session).where(F.col("part").isin(arrived) & (F.col("batch") != name))
        candidates = keyfilter.files_that_may_hold(first.withColumn("part", F.col("prefix")), key, earlier)
        # Names of files only, as a reader's own listing of the target holds them.
        paths = [f"{target}/batch={r['batch']}/prefix={r['part']}/{r['file']}" for r in candidates.collect()]
        fresh = first
        if paths:
            known = session.read.schema(first.select(key).schema).parquet(*sorted(paths)).select(F.col(key).alias("_known"))
            fresh = first.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        (fresh.hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{target}/batch={name}"))
        _write_filters(session, target, name, first.schema, key)
        release(first)
        if opened:
            opened(batch_id, paths)

    return (
        arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _fold(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("asset_id").agg(F.max(F.struct("file", "seq", "verdict")).alias("r"))
    return last.select("asset_id", "r.file", "r.seq", "r.verdict")


def _merge_runs(spark: SparkSession, root: str, done: int, every: int) -> None:
    """Merge ``every`` runs of a level into one of the next whenever that many are complete.

    What is merged follows from the number of batches alone, so a replayed batch merges the same runs again. Inputs stay
    until the level's next merge: a reader that listed them before has ``every`` batches to finish.
    """
    level = 0
    while done % every == 0:
        done //= every
        runs = lambda merge: [f"{root}/level={level}/run={r}" for r in range(merge * every, (merge + 1) * every)]
        merged = _fold(spark.read.parquet(*runs(done - 1)))
        merged.write.mode("overwrite").parquet(f"{root}/level={level + 1}/run={done - 1}")
        for old in runs(done - 2) if done > 1 else []:
            remove_folder(spark, old)
        level += 1


def stream_decisions(feed: DataFrame, target: str, checkpoint: str, merge_every: int = 8) -> StreamingQuery:
    """Keep the last verdict per asset. A batch writes only the assets it names, as a run of level 0.

    Every ``merge_every`` runs of a level become one of the next inside the stream, so after n batches there are at most
    2 * merge_every runs on each of log(n) levels, and a verdict is rewritten once a level. The fold takes the last of
    equal keys, so runs that still lie beside their merge change nothing.
    """
    if merge_every < 2:
        raise ValueError("merge_every must be at least 2")
    root = f"{target}/stream={_stream_name(checkpoint)}"

    def fold(batch: DataFrame, batch_id: int) -> None:
        verdict = F.lower("verdict")
        rows = batch.where(verdict.isin(*VERDICTS)).select("asset_id", "file", "seq", verdict.alias("verdict"))
        _fold(rows).write.mode("overwrite").parquet(f"{root}/level=0/run={batch_id}")
        _merge_runs(batch.sparkSession, root, batch_id + 1, merge_every)

    return (
        feed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_decisions(spark: SparkSession, target: str) -> DataFrame:
    return _fold(spark.read.parquet(target))


def bursts(events: DataFrame, key: str, at: str, gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions per key; a burst is a session of two rows or more. Rows past the watermark are late."""
    return (
        events.withWatermark(at, delay)
        .groupBy(key, F.session_window(at, gap))
        .agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("session_window")
    )


def funnel(events: DataFrame, key: str, at: str, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Row counts per key and tumbling window."""
    return (
        events.withWatermark(at, delay)
        .groupBy(key, F.window(at, every))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("window.start").alias("window_start"), "n")
    )


def closing_row(events: DataFrame, at: str, after: str = "interval 2 days") -> DataFrame:
    """One row of nulls with a time past every other: it moves the watermark on and is never written itself."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != at]
    return events.agg((F.max(at) + F.expr(after)).alias(at)).select(*empty, at).select(*events.columns)


def run_to_files(result: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append mode: a window is written once, when the watermark has passed it, and leaves the state then.

    A feed that ends is closed by a row far enough ahead (``closing_row``), or its last windows stay open.
    """
    return (
        result.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
