"""Key filters, ingest that opens few files, decisions that merge their runs."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import keyfilter
from gleaner.session import remove_folder
from gleaner.streaming import jobs

ARRIVALS = "asset_id string, arrived_at timestamp"


def arrivals(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n long").select(
        F.concat(F.lit("k"), "n").alias("asset_id"), F.timestamp_seconds("n").alias("arrived_at"))


def test_filters_report_every_present_key_and_few_others(spark):
    rows = spark.range(20_000).select(
        F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 2).cast("string").alias("part"),
        F.concat(F.lit("f"), F.col("id") % 6).alias("file"))
    filters = keyfilter.build(rows, "key").withColumn("batch", F.lit("b")).cache()
    assert {r["n_bitmaps"] for r in filters.collect()} == {4}  # 3,334 keys a file at 24 bits
    for n in (0, 1, 777, 19_999):
        asked = spark.createDataFrame([(f"k{n}", str(n % 2))], "key string, part string")
        assert ("b", str(n % 2), f"f{n % 6}") in [tuple(r) for r in keyfilter.files_that_may_hold(asked, "key", filters).collect()]
    absent = spark.range(2_000).select(F.concat(F.lit("x"), "id").alias("key"), (F.col("id") % 2).cast("string").alias("part"))
    assert keyfilter.files_that_may_hold(absent, "key", filters).count() <= 2
    assert keyfilter.files_that_may_hold(absent, "key", filters.where("false")).count() == 0


def test_a_batch_of_many_keys_opens_only_files_that_hold_them(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = {}
    run = lambda: jobs.stream_ingest(
        jobs.read_files(spark, source, ARRIVALS), out, state, opened=lambda b, paths: seen.update({b: paths})).awaitTermination()
    for start in (0, 3_000, 6_000):
        arrivals(spark, range(start, start + 3_000)).write.mode("append").parquet(source)
        run()
    assert seen[0] == [] and len(seen[1]) <= 2 and len(seen[2]) <= 2  # all prefixes arrive, all keys are new
    arrivals(spark, [*range(3_000, 4_000), *range(9_000, 11_000)]).write.mode("append").parquet(source)
    run()
    name = jobs._stream_name(state)
    assert len([p for p in seen[3] if f"batch={name}-1/" in p]) == 16
    assert len([p for p in seen[3] if f"batch={name}-1/" not in p]) <= 2
    got = spark.read.parquet(out).select("asset_id")
    assert got.count() == got.distinct().count() == 11_000


def test_ingest_of_nulls_another_stream_and_lost_filters(spark, tmp_path):
    out = str(tmp_path / "out")
    def run(name, rows):
        source, state = str(tmp_path / name / "in"), str(tmp_path / name / "state")
        rows.write.mode("append").parquet(source)
        jobs.stream_ingest(jobs.read_files(spark, source, ARRIVALS), out, state).awaitTermination()
        return state
    null = arrivals(spark, [1, 2]).withColumn("asset_id", F.when(F.col("asset_id") == "k2", F.col("asset_id")))
    first = run("one", null)
    run("one", null)
    remove_folder(spark, f"{out}/_keys/filters/batch={jobs._stream_name(first)}-0")
    run("two", arrivals(spark, [2, 3]))
    assert sorted(str(r["asset_id"]) for r in spark.read.parquet(out).collect()) == ["None", "k2", "k3"]
    empty = str(tmp_path / "three")
    arrivals(spark, []).write.parquet(f"{empty}/in")
    jobs.stream_ingest(jobs.read_files(spark, f"{empty}/in", ARRIVALS), f"{empty}/out", f"{empty}/state").awaitTermination()
    assert spark.read.parquet(f"{empty}/out").count() == 0


def test_decisions_merge_their_runs(spark, tmp_path):
    schema = "asset_id string, file string, seq int, verdict string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    last = {}
    for n in range(19):
        rows = [(f"a{n % 5}", f"{n:03d}", 0, "Accept"), (f"b{n}", f"{n:03d}", 1, "reject"), ("c", f"{n:03d}", 2, "bogus")]
        last.update({a: v.lower() for a, _, _, v in rows if v != "bogus"})
        if n == 7:
            rows.append(("a0", f"{n:03d}", 3, "hero"))
            last["a0"] = "hero"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_decisions(jobs.read_files(spark, source, schema), out, state, merge_every=3).awaitTermination()
    last["a0"] = "accept"  # decided again in files 010 and 015
    root = f"{out}/stream={jobs._stream_name(state)}"
    runs = {level: sorted(os.listdir(f"{root}/{level}")) for level in os.listdir(root)}
    assert runs == {
        "level=0": ["run=15", "run=16", "run=17", "run=18"],
        "level=1": ["run=3", "run=4", "run=5"], "level=2": ["run=0", "run=1"],
    }
    got = {r["asset_id"]: r["verdict"] for r in jobs.latest_decisions(spark, out).collect()}
    assert got == last
    # A batch that is run again merges the same runs again.
    jobs._merge_runs(spark, root, 18, 3)
    assert {r["asset_id"]: r["verdict"] for r in jobs.latest_decisions(spark, out).collect()} == last
    with pytest.raises(ValueError, match="merge_every"):
        jobs.stream_decisions(jobs.read_files(spark, source, schema), out, state, merge_every=1)
