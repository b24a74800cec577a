"""Streams over the given tables: each table is laid out as files and drained in several batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.plans.assets import sql, table
from gleaner.plans.queries_review import FEED_CTE, feed
from gleaner.plans.registry import query
from gleaner.session import checkpoint_dir
from gleaner.streaming import jobs


def _folders(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/state"


def _as_stream(spark, rows, folder):
    """The rows as files, as many as they have partitions (four at least), drained half of them at a time."""
    n = rows.rdd.getNumPartitions()
    (rows if n >= 4 else rows.repartition(4)).write.parquet(folder)
    return jobs.read_files(spark, folder, rows.schema, files_per_batch=max(2, n // 2))


SLICES = 4


def _drain_events(spark, sf_dir, build):
    """The events arrive in slices of time, each written by all its tasks and drained by its own run of the job.

    All files of a slice are one batch, so their order does not matter; the watermark moves on between slices. A closing
    row comes last.
    """
    source, out, state = _folders(spark)
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    cuts = events.agg(F.percentile_approx(F.unix_micros("ts"), [k / SLICES for k in range(1, SLICES)]).alias("c")).first()["c"]
    edges = [None, *sorted(set(cuts or [])), None]
    at = lambda micros: F.timestamp_micros(F.lit(micros))
    slices = [
        events.where((F.col("ts") > at(low) if low is not None else F.lit(True)) & (F.col("ts") <= at(high) if high is not None else F.lit(True)))
        for low, high in zip(edges, edges[1:])
    ]
    for rows in [*slices, jobs.closing_row(events, "ts")]:
        rows.write.mode("append").parquet(source)
        jobs.run_to_files(build(jobs.read_files(spark, source, events.schema)), out, state).awaitTermination()
    return spark.read.parquet(out)


@query("st1_stream_ingest", "SELECT DISTINCT sha1(text) AS asset_id FROM documents")
def st1_stream_ingest(spark, sf_dir):
    source, out, state = _folders(spark)
    rows = table(spark, sf_dir, "documents").select(
        F.sha1(F.col("text").cast("binary")).alias("asset_id"), "doc_id",
        F.timestamp_seconds(F.col("doc_id") * 60).alias("arrived_at"),
    )
    jobs.stream_ingest(_as_stream(spark, rows, source), out, state).awaitTermination()
    return spark.read.parquet(out).select("asset_id")


@query("st2_stream_decisions", sql(FEED_CTE + """
SELECT asset_id, arg_max(lower(verdict), file * 1000 + seq) AS verdict FROM feed
WHERE lower(verdict) IN ('accept', 'reject', 'hero') GROUP BY asset_id"""))
def st2_stream_decisions(spark, sf_dir):
    source, out, state = _folders(spark)
    rows = feed(spark, sf_dir).select("asset_id", "file", "seq", "verdict")
    jobs.stream_decisions(_as_stream(spark, rows, source), out, state).awaitTermination()
    return jobs.latest_decisions(spark, out).select("asset_id", "verdict")


@query("st3_stream_burst", """
WITH t AS (SELECT event_type, ts, event_id,
  CASE WHEN ts - lag(ts) OVER w <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM t)
SELECT event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n
FROM s GROUP BY event_type, session HAVING count(*) > 1""")
def st3_stream_burst(spark, sf_dir):
    rows = _drain_events(spark, sf_dir, lambda events: jobs.bursts(events, "event_type", "ts"))
    wall = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select("event_type", wall("first_at"), wall("last_at"), "n")


@query("st4_stream_funnel", """
SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def st4_stream_funnel(spark, sf_dir):
    rows = _drain_events(spark, sf_dir, lambda events: jobs.funnel(events, "event_type", "ts"))
    return rows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
