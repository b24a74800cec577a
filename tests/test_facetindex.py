"""Bitmap index of facets against the plain filters."""

import random

from gleaner.operators import catalog, facetindex

SCHEMA = "asset_id string, best_datetime string, chapter string, event string, tags string, favorited boolean"


def test_bitmaps_agree_with_the_plain_filters(spark, tmp_path):
    rng = random.Random(5)
    pick = lambda *options: rng.choice(options)
    rows = [
        (f"a{i:05d}", pick(None, "2024-01-05T00:00:00", "2024-02-01", "2023-12-31T10:00:00"), pick("x", "y", "", None),
         pick(None, "", "Trip"), pick(None, "", "sea", "sun,sea", "fun"), pick(True, False, None))
        for i in range(70_000)  # three buckets
    ]
    assets = spark.createDataFrame(rows, SCHEMA).cache()
    placements = spark.createDataFrame([(f"a{i:05d}",) for i in range(0, 70_000, 3)] + [("a00000",), ("gone",)], "asset_id string")
    folder = str(tmp_path)
    facetindex.write_index(assets, placements, folder)
    assert sorted(facetindex.facet_counts(spark, folder).collect()) == sorted(catalog.facets(assets).collect())
    cases = [
        {}, {"favorited": True}, {"usage": "unused", "era": "x"}, {"usage": "used", "tag": "sea", "month": "2024-01"},
        {"event": "Trip", "tag": "sun"}, {"era": "none such"}, {"era": "x", "event": "none such"},
    ]
    for case in cases:
        conditions = [(facet, "true" if value is True else value) for facet, value in case.items()]
        want = catalog.facet_filter(assets, placements, **case)
        ids = sorted(r["asset_id"] for r in want.select("asset_id").collect())
        assert sorted(r["asset_id"] for r in facetindex.ids_filtered(spark, folder, conditions).collect()) == ids
        assert facetindex.count_filtered(spark, folder, conditions).first()["n"] == len(ids)
        assert sorted(facetindex.facet_counts(spark, folder, conditions).collect()) == sorted(catalog.facets(want).collect())


def test_an_empty_table_has_no_bitmaps(spark, tmp_path):
    assets = spark.createDataFrame([], SCHEMA)
    facetindex.write_index(assets, spark.createDataFrame([], "asset_id string"), str(tmp_path))
    assert facetindex.ids_filtered(spark, str(tmp_path), []).count() == 0
    assert facetindex.count_filtered(spark, str(tmp_path), [("era", "x")]).first()["n"] == 0
    assert facetindex.facet_counts(spark, str(tmp_path)).count() == 0
