"""Files, sweeps, books, snapshots, folds and gates on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.config import Chapter, load_config
from gleaner.operators import audit, chapters, export, faces, placement, quality, review
from gleaner.sources import book, files, sinks, snapshot, sweeps
from gleaner.streaming import jobs


def write(folder, name, data):
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")


def test_scan_pair_and_key(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.jpg", "a.JPG", "sub/c.png", "v.mp4", "notes.txt"):
        (tmp_path / name).write_bytes(b"same" if name != "sub/c.png" else b"other")
    write(tmp_path, "b.jpg.json", {"photoTakenTime": {"timestamp": "0"}})
    write(tmp_path, "b.jpg.suppl.json", {})
    scan = files.scan_files(spark, str(tmp_path), content=True)
    counts = {r["kind"]: r["n"] for r in files.scan_counts(scan).collect()}
    assert counts == {"image": 3, "video": 1, "other": 1, "sidecar": 2}
    images = scan.where("kind = 'image'")
    keyed = files.content_keyed(images, "entry").collect()
    assert sorted((r["entry"], r["copies"]) for r in keyed) == [("a.JPG", 2), ("sub/c.png", 1)]
    paired = files.pair_sidecars(images.select("path"), scan.where("kind = 'sidecar'").select("path"))
    got = {r["path"].rsplit("/", 1)[1]: r["sidecar_path"] for r in paired.collect()}
    assert got["b.jpg"].endswith("b.jpg.suppl.json") and got["a.JPG"] is None


def test_sweeps_of_every_kind(spark, tmp_path):
    write(tmp_path, "decisions_1.json", {"decisions": {"a": "Accept", "b": "maybe"}, "captions": {"a": "hi", "z": "no"}})
    write(tmp_path, "eras_1.json", {"era": "e1", "asset_ids": ["a", "b"]})
    write(tmp_path, "event_1.json", {"event": "Party", "date": "2020", "asset_ids": ["a"]})
    write(tmp_path, "tag_x.json", {"tag": " fun ", "asset_ids": ["a"]})
    write(tmp_path, "tags_all_1.json", {"themes": {"sea": ["a", "b"], " ": ["c"]}})
    write(tmp_path, "cut_e1.json", {"cut": ["b"]})
    read = lambda kind: sweeps.read_sweeps(spark, str(tmp_path), kind).collect()
    assert {(r["asset_id"], r["verdict"]) for r in read("decisions") if r["verdict"]} == {("a", "Accept"), ("b", "maybe")}
    assert [(r["era"], r["asset_id"]) for r in read("eras")] == [("e1", "a"), ("e1", "b")]
    assert [(r["event"], r["date"]) for r in read("events")] == [("Party", "2020")]
    assert {(r["tag"], r["asset_id"]) for r in read("tags")} == {("fun", "a"), ("sea", "a"), ("sea", "b")}
    assert [(r["era"], r["asset_id"]) for r in read("cuts")] == [("?", "b")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        sweeps.read_sweeps(spark, str(tmp_path / "none"), "eras")


ASSETS = "asset_id string, review_status string, is_hero boolean, caption string, chapter string, event string, best_datetime string, date_source string, date_confidence string, tags string, favorited boolean"


def assets(spark):
    return spark.createDataFrame(
        [("a", None, True, None, "c1", None, "2001-01-01T00:00:00", "exif", "high", "b, a", False),
         ("b", "accept", True, "old", "c1", "E", None, "mtime", "low", None, True)], ASSETS)


def test_decisions_fold_and_are_idempotent(spark):
    feed = spark.createDataFrame(
        [("1", 0, "a", "hero", "x"), ("2", 0, "a", "reject", None), ("2", 1, "b", "bogus", "new"), ("3", 0, "q", "accept", None)],
        "file string, seq int, asset_id string, verdict string, caption string")
    once = review.fold_decisions(assets(spark), feed)
    rows = {r["asset_id"]: (r["review_status"], r["is_hero"], r["caption"]) for r in once.collect()}
    assert rows == {"a": ("reject", True, "x"), "b": ("accept", True, "old")}
    assert sorted(review.fold_decisions(once, feed).collect()) == sorted(once.collect())
    with pytest.raises(review.AcceptBoundError):
        review.check_accept_bound(once)
    assert review.check_accept_bound(once, 1, 1) is once


def test_undated_event_sweep_keeps_the_date(spark):
    feed = spark.createDataFrame([("1", 0, "a", "Trip", "2020-05"), ("2", 0, "a", "Tour", "")],
                                 "file string, seq int, asset_id string, event string, date string")
    a = {r["asset_id"]: r for r in review.fold_events(assets(spark), feed).collect()}["a"]
    assert (a["event"], a["best_datetime"], a["date_source"], a["date_confidence"]) == ("Tour", "2020-05-15T12:00:00", "event", "medium")


def test_tags_only_change_when_new(spark):
    feed = spark.createDataFrame([("a", "a"), ("b", "z"), ("b", "y")], "asset_id string, tag string")
    got = {r["asset_id"]: (r["tags"], r["n_added"]) for r in review.fold_tags(assets(spark), feed).collect()}
    assert got == {"a": ("b, a", 0), "b": ("y,z", 2)}


def test_chapters(spark):
    good = (Chapter("x", "2001-01-01", "2001-12-31"), Chapter("y", "2002-01-01", "2002-12-31"))
    rows = spark.createDataFrame([("1999-01-01T00:00:00",), ("2001-12-31T23:59:59-08:00",), ("2009-01-01",), (None,)], "best_datetime string")
    got = [(r["chapter"], r["clamped"]) for r in chapters.assign(rows, good).collect()]
    assert got == [("x", "low"), ("x", None), ("y", "high"), ("y", None)]
    bad = (good[0], Chapter("z", "2002-01-05", "2002-12-31"))
    with pytest.raises(ValueError, match="gap"):
        chapters.assign(rows, bad)
    with pytest.raises(ValueError, match="no chapters"):
        chapters.assign(rows, ())


def test_percentile_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.normal(size=5000)] + [("b", 1.0)] * 30 + [("c", 5.0)] * 7 + [("d", float(i)) for i in range(27)]
    got = {r["g"]: r["threshold"] for r in quality.group_percentile(
        spark.createDataFrame(data, "g string, v double"), "g", "v", 15, 8, accuracy=100).collect()}
    for g in "abd":
        assert got[g] == pytest.approx(np.percentile([v for k, v in data if k == g], 15))
    assert got["c"] == 0.0


def test_percentile_widens_brackets_that_miss(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", 1.0)] * 900 + [("b", float(v)) for v in range(100)]
    data += [("n", float("nan"))] * 20 + [("n", 1.0)] * 5 + [("e", None), (None, 3.0)] + [("new", float(v)) for v in range(50)]
    rows = spark.createDataFrame(data, "g string, v double")
    # Kept from rows that lie elsewhere, of a group without values, and none for the group "new".
    stale = spark.createDataFrame([("a", 50.0 + i) for i in range(500)] + [("b", -5.0), ("n", float("nan"))], "g string, v double")
    quality.keep_sketches(stale, str(tmp_path), "1", "g", "v")
    quality.keep_sketches(stale, str(tmp_path), "1", "g", "v")
    quality.keep_sketches(rows.where("v > 0"), str(tmp_path), "2", "g", "v")
    kept = quality.kept_sketches(spark, str(tmp_path), "g")
    assert {r["g"]: r["n"] for r in kept.select("g", F.kll_sketch_get_n_double("sketch").alias("n")).collect()}["b"] == 1000
    for percent in (0, 15, 50, 100):
        got = {r["g"]: (r["samples"], r["threshold"]) for r in quality.group_percentile(rows, "g", "v", percent, 8, sketches=kept).collect()}
        assert sorted(got) == ["a", "b", "n", "new"]
        for g in got:
            values = sorted(v for k, v in data if k == g)
            want = np.percentile(values, percent) if g != "n" else (1.0 if percent <= 15 else float("nan"))
            assert got[g] == (len(values), pytest.approx(want, nan_ok=True))
    assert quality.group_percentile(rows.where("false"), "g", "v", 15, 8).count() == 0


def test_print_gate(spark):
    grid = spark.createDataFrame([("full", 0, 0.12, 0.12, 11.76, 11.76)], "template string, pos int, x double, y double, w double, h double")
    sizes = spark.createDataFrame([("a1", 200, 200), ("a2", 3600, 3600)], "asset_id string, px_w int, px_h int")
    cell = lambda a, side: (0, side, 1, "full", 0, a, None, None, None)
    schema = "spread int, side string, page_number int, template string, cell int, asset_id string, crop_w double, crop_h double, override_dpi string"
    low = placement.with_geometry(spark.createDataFrame([cell("a1", "left"), cell("a2", "right")], schema), grid, sizes)
    assert [r["asset_id"] for r in placement.low_dpi(low).collect()] == ["a1"]
    with pytest.raises(placement.NotPrintReady):
        placement.export_gate(low)
    fine = placement.with_geometry(spark.createDataFrame([cell("a2", "left")], schema), grid, sizes)
    placement.export_gate(fine)
    with pytest.raises(placement.NotPrintReady):
        placement.export_gate(fine, page_in=8.0)
    with pytest.raises(placement.NotPrintReady):
        placement.export_gate(fine, flagged=False)


def test_cells_in_every_form(spark):
    page = '{"template":"t","cells":["bare",null,{"asset_id":"x","crop":{"x":0,"y":0,"w":1,"h":1},"caption":"  "},{"asset_id":"y","crop":{"x":0},"dpi_override":{"dpi":100},"id":"k","caption":"c"}]}'
    docs = spark.createDataFrame([(0, f'{{"chapter":"c","left":{page},"right":null}}')], "spread int, value string")
    rows = book.flatten_book(book.parse_spreads(docs)).orderBy("cell").collect()
    assert [r["asset_id"] for r in rows] == ["bare", None, "x", "y"]
    assert rows[2]["crop"]["w"] == 1.0 and rows[2]["caption"] is None
    assert rows[3]["crop"] is None and rows[3]["dpi_override"]["dpi"] == "100" and rows[3]["cell_id"] == "k" and rows[3]["caption"] == "c"
    once = book.migrate_book(docs)
    assert book.migrate_book(once).collect() == once.collect()


def test_migration_reads_its_documents_once(spark):
    """The ids are compared in the row that has them; a join of the rows with themselves shuffled and built all of it twice."""
    from gleaner.plans.queries_placement import s10_migrate_book

    plan = s10_migrate_book(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation [" in line]) == 2  # lineitem and orders


def test_leak_rules(spark):
    text = "see /home/anna/x and c:\\users\\me\\y\nmail bob@real.org or a@example.com\n" + "0" * 39 + "1 " + "a" * 40 + "\n06_anna savannah 2020-02-02"
    rows = spark.createDataFrame([("doc.txt", text), ("pic.PNG", "x"), ("bin.txt", "a\0b"), ("LICENSE", "Copyright Anna\nAnna")], "path string, text string")
    hits = {(r["path"], r["line"], r["rule"], r["match"]) for r in audit.leak_scan(rows, audit.Blocklist(names=("anna",))).collect()}
    assert hits == {
        ("doc.txt", 1, "HOME", "/home/anna"), ("doc.txt", 1, "NAME", "anna"), ("doc.txt", 2, "EMAIL", "bob@real.org"),
        ("doc.txt", 3, "ID", "a" * 40), ("doc.txt", 4, "NAME", "anna"), ("doc.txt", 4, "DATE", "2020-02-02"),
        ("pic.PNG", 0, "EXTENSION", ".png"), ("bin.txt", 0, "BINARY", "NUL"), ("LICENSE", 2, "NAME", "Anna"),
    }


def test_leak_scan_with_a_long_blocklist(spark):
    import random
    import re

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randint(1, 5)))
    names, strings = ["ab", "abab", "", "b.a"] + [word() + "x" for _ in range(300)], ["AB x", "ba", "ba", "É"] + [word() + "y" for _ in range(3_000)]
    dates = ["2020-01", "2020-01-02", "01-02"]
    lines = ["".join(rng.choice(["ab", "B", "x", "y", " ", "é", "1", ".", "2020-01-02"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(f"p{i}", line) for i, line in enumerate(lines)] + [("none", None)], "path string, text string")
    want = []
    for i, line in enumerate(lines):
        want += [(f"p{i}", "STRING", t) for t in strings if t.lower() in line.lower()]
        pattern = "(?i)(?<![a-z])(?:" + "|".join(re.escape(n) for n in names if n) + ")(?![a-z])"
        want += [(f"p{i}", "NAME", m) for m in re.findall(pattern, line, re.ASCII)]
        want += [(f"p{i}", "PERSONAL_DATE", m) for m in re.findall("|".join(dates), line)]
    found = audit.leak_scan(rows, audit.Blocklist(tuple(names), tuple(strings), tuple(dates))).where("rule <> 'DATE'")
    assert len(want) > 1_000
    assert sorted((r["path"], r["rule"], r["match"]) for r in found.collect()) == sorted(want)
    with pytest.raises(ValueError, match="blocklist"):
        audit.leak_scan(rows, audit.Blocklist(names=("x" * (audit.BLOCKLIST_CHARS + 1),)))


def test_names_that_share_a_bound(spark):
    import re

    lines = ["lorem lorem lorem", "lorem", " lorem  Lorem,worthless", "lorem lorem. lorem", "xlorem lorem lorem", "loremlorem lorem", "worthless lorem"]
    rows = spark.createDataFrame([(str(i), line) for i, line in enumerate(lines)], "path string, text string")
    names = ("worthless", "lorem")
    count = lambda pattern: sorted((str(i), m) for i, line in enumerate(lines) for m in re.findall(pattern, line))
    hits = lambda **how: sorted((r["path"], r["match"]) for r in audit.leak_scan(rows, audit.Blocklist(names, **how)).collect())
    assert hits() == count("(?i)(?<![a-z])(worthless|lorem)(?![a-z])")
    spent = count("(?i)(?:^|[^a-z])(worthless|lorem)(?:[^a-z]|$)")
    assert hits(shared_bounds=False) == spent != hits()


def test_archive_names_that_several_assets_share(spark):
    assets = spark.createDataFrame([(i, "z", "IMG_1.jpg", None, None) for i in "abc"], "asset_id string, zip_source string, zip_entry string, staged_original_path string, derivative_path string")
    archive = spark.createDataFrame([("z", "IMG_1.jpg", i) for i in ("a", "c", "c", "damaged")], "zip_source string, zip_entry string, sha1 string")
    found = export.best_source(assets, spark.createDataFrame([], "path string"), archive)
    assert sorted((r["asset_id"], r["source_kind"]) for r in found.collect()) == [("a", "original"), ("b", None), ("c", "original")]


def test_numbers_over_four_digits(spark):
    from gleaner.plans.queries_catalog import four_digits, listed

    assert [r[0] for r in spark.range(9, 12346, 12336).select(four_digits(F.col("id"))).collect()] == ["0009", "1234"]
    row = spark.sql("SELECT 'original' source_kind, '.jpg' ext, '2024-01-05T00:00:00' best_datetime, 12345 index, 'abcdef0123' asset_id, 'c' chapter, "
                    "'C' chapter_title, 1 chapter_no, 1 AS `order`, 's' src, true is_hero, '' event, '' tags, '' caption")
    assert listed(row).first()["file"] == "01_c/1234_2024-01-05_abcdef01.jpg"
    assert export.manifest(row).first()["file"] == "01_c/12345_2024-01-05_abcdef01.jpg"


def test_copies_of_ids_with_one_prefix(spark):
    first, second = "abcdef01" + "0" * 32, "abcdef01" + "1" * 32
    accepted = spark.createDataFrame([(first, 10, None, "2024-01-01"), (second, 10, None, "2024-01-02")], "asset_id string, derivative_edge int, staged_sha1 string, date string")
    exported = spark.createDataFrame([("c/0_2024-01-01_abcdef01.jpg", 20, "damaged"), ("c/1_2024-01-02_abcdef01.jpg", 20, second)], "file string, long_edge int, sha1 string")
    assert {r["file"][2]: r["asset_id"] for r in audit.match_copies(exported, accepted).collect()} == {"0": first, "1": second}
    found = {r["check"]: r["detail"] for r in audit.verify_export(accepted, exported, exported.select("file"), True).collect()}
    assert found["content"] == "1 bad"


def test_unsorted_prefixes(spark):
    rows = spark.createDataFrame([("01_a/9999_x.jpg",), ("01_a/10000_x.jpg",), ("01_a/1000_x.jpg",), ("02_b/0001_x.jpg",)], "file string")
    assert [r["folder"] for r in audit.unsorted_folders(rows).collect()] == ["01_a"]


def test_face_gate(spark):
    cells = spark.sql("select named_struct('x',0.0,'y',0.0,'w',0.5,'h',1.0) crop, array(named_struct('x0',0.4,'y0',0.1,'x1',0.6,'y1',0.2)) faces")
    with pytest.raises(faces.FacesClipped):
        faces.face_gate(cells)
    faces.face_gate(cells.withColumn("faces", F.slice("faces", 2, 1)))


def test_snapshot_upsert_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "asset_id string, score int")
    new = spark.createDataFrame([("a", 9), ("b", 2)], "asset_id string, score int")
    merged = snapshot.upsert_new(old, new)
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 2)]
    assert tuple(snapshot.upsert_counts(old, new).first()) == (1, 1)
    root = str(tmp_path / "m")
    snapshot.write_snapshot(old, root)
    snapshot.write_snapshot(merged, root)
    assert snapshot.read_snapshot(spark, root).count() == 2
    full = snapshot.evolve(spark.createDataFrame([("a",)], "asset_id string"))
    assert len(full.columns) == 33
    lines = spark.createDataFrame([(2, "b.jpg", ""), (1, "a.jpg", "hello")], "order int, file string, caption string")
    sinks.write_captions(lines, str(tmp_path))
    assert [r[0] for r in sinks.read_captions(spark, str(tmp_path)).collect()] == ["a.jpg\thello"]


def test_sinks_hold_whole_results_or_the_former_ones(spark, tmp_path):
    folder, schema = str(tmp_path), sinks.MANIFEST
    row = lambda n, caption: (n, "c", "C", f"c/{n}.jpg", "2024-01-01", "s", 0, "", 'a "b", c', "full", caption)
    first = [row(2, "two\nlines, \"quoted\" \\"), row(1, "")]
    sinks.write_manifest(spark.createDataFrame(first, schema), folder)
    assert [tuple(r) for r in sinks.read_manifest(spark, folder).orderBy("order").collect()] == first[::-1]
    broken = spark.createDataFrame(first, schema).withColumn("res", F.when(F.col("order") < 2, F.col("res")).otherwise(
        F.raise_error(F.lit("no such file")).cast("string")))
    with pytest.raises(Exception, match="no such file"):
        sinks.write_manifest(broken, folder)
    assert sinks.read_manifest(spark, folder).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["manifest"]
    sinks.write_manifest(spark.createDataFrame([row(7, "x")], schema), folder)
    assert [r["order"] for r in sinks.read_manifest(spark, folder).collect()] == [7]
    sinks.write_captions(spark.createDataFrame(first, schema), folder)
    assert [r[0] for r in sinks.read_captions(spark, folder).collect()] == ['c/2.jpg\ttwo lines, "quoted" \\']
    for value, run in ((1, "a"), (2, "a"), (3, "b")):
        sinks.write_metrics(spark.createDataFrame([(value,)], "total int"), f"{folder}/log", "dedup", run)
    log = sinks.read_metrics(spark, f"{folder}/log")
    assert sorted((r["stage"], r["run"], r["metric"], r["value"]) for r in log.collect()) == [("dedup", "a", "total", 2.0), ("dedup", "b", "total", 3.0)]


def test_config_files(tmp_path):
    (tmp_path / "scoring.yaml").write_text("dedup: {phash_hamming_max: 9}\nscore: {max_per_day: 15, weights: {hero: 7}}\n")
    (tmp_path / "chapters.yaml").write_text("chapters:\n  - {id: b, start: 2002-01-01, end: 2002-12-31}\n  - {id: a, start: '2001-01-01', end: '2001-12-31', title: T}\ntargets: {a: 3}\n")
    (tmp_path / "sources.yaml").write_text("priority: {x: 100}\nfilename_date_patterns:\n  - {name: n, pattern: '(\\d{4})(\\d{2})(\\d{2})', groups: [year, month, day]}\n")
    c = load_config(tmp_path)
    assert (c.dedup.max_distance, c.dedup.window_days, c.score.max_per_day, c.score.hero, c.score.quality) == (9, 30, 15, 7, 1.0)
    assert [x.id for x in c.chapters] == ["a", "b"] and c.chapters[0].label == "T" and c.chapter_order == {"a": 1, "b": 2}
    assert c.priority == {"x": 100} and len(c.patterns) == 1 and load_config(tmp_path / "none").score.max_per_day == 3


def test_stream_appends_closed_bursts_and_drops_late_rows(spark, tmp_path):
    schema = "k string, at timestamp"
    rows = lambda values: spark.createDataFrame(values, "k string, t string").select("k", F.to_timestamp("t").alias("at"))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: jobs.run_to_files(jobs.bursts(jobs.read_files(spark, source, schema), "k", "at"), out, state).awaitTermination()
    rows([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:02:00"), ("x", "2024-01-01 05:00:00")]).write.mode("append").parquet(source)
    run()
    rows([("x", "2024-01-01 00:03:00"), ("x", "2024-01-01 09:00:00")]).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out).collect()
    assert [(str(r["first_at"]), r["n"]) for r in got] == [("2024-01-01 00:00:00", 2)]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    schema = "asset_id string, arrived_at timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = lambda *v: spark.createDataFrame(list(v), "asset_id string, t string").select("asset_id", F.to_timestamp("t").alias("arrived_at"))
    run = lambda: jobs.stream_ingest(jobs.read_files(spark, source, schema), out, state).awaitTermination()
    rows(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-05 00:00:00")).write.mode("append").parquet(source)
    run()
    # A late row with a new key is kept as well.
    rows(("a", "2024-01-06 00:00:00"), ("c", "2023-01-06 00:00:00")).write.mode("append").parquet(source)
    run()
    assert sorted(r["asset_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
