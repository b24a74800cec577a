"""Review feeds (from the conversations table) folded into the asset view, and review lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import review
from gleaner.plans.assets import asset_view, sql, table
from gleaner.plans.registry import query
from gleaner.session import checkpoint_dir
from gleaner.sources import sweeps

FEED_CTE = """, ids AS (SELECT doc_id, sha1(text) AS asset_id FROM documents),
feed AS (
  SELECT c.conv_id AS file, c.turn AS seq, coalesce(i.asset_id, 'missing-' || (c.conv_id * 10 + c.turn * 5)) AS asset_id,
    CASE WHEN length(c.text) % 17 = 0 THEN 'maybe' WHEN c.role = 'user' THEN 'Accept'
      WHEN c.role = 'assistant' THEN 'reject' ELSE 'HERO' END AS verdict,
    CASE WHEN c.turn = 1 THEN 'said in ' || c.conv_id END AS caption,
    CASE c.role WHEN 'user' THEN '01_early' WHEN 'assistant' THEN 'zz_other' ELSE '' END AS era,
    CASE WHEN c.role <> 'system' THEN 'Party ' || (c.conv_id % 7) END AS event,
    CASE c.turn WHEN 0 THEN '2024' WHEN 2 THEN '2024-03' WHEN 4 THEN '2024-02-10' ELSE '' END AS date,
    CASE c.turn % 3 WHEN 0 THEN ' family ' WHEN 1 THEN 'fr' ELSE 'picnic' END AS tag,
    'b' || (c.conv_id % 4) AS batch
  FROM conversations c LEFT JOIN ids i ON i.doc_id = c.conv_id * 10 + c.turn * 5
)"""


def feed(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("id"))
    c = table(spark, sf_dir, "conversations").withColumn("target", F.col("conv_id") * 10 + F.col("turn") * 5)
    turn, role = F.col("turn"), F.col("role")
    return c.join(ids, F.col("target") == F.col("doc_id"), "left").select(
        F.col("conv_id").alias("file"),
        turn.alias("seq"),
        F.coalesce("id", F.concat(F.lit("missing-"), F.col("target").cast("string"))).alias("asset_id"),
        F.when(F.length("text") % 17 == 0, "maybe").when(role == "user", "Accept")
        .when(role == "assistant", "reject").otherwise("HERO").alias("verdict"),
        F.when(turn == 1, F.concat(F.lit("said in "), F.col("conv_id").cast("string"))).alias("caption"),
        F.when(role == "user", "01_early").when(role == "assistant", "zz_other").otherwise("").alias("era"),
        F.when(role != "system", F.concat(F.lit("Party "), (F.col("conv_id") % 7).cast("string"))).alias("event"),
        F.when(turn == 0, "2024").when(turn == 2, "2024-03").when(turn == 4, "2024-02-10").otherwise("").alias("date"),
        F.when(turn % 3 == 0, " family ").when(turn % 3 == 1, "fr").otherwise("picnic").alias("tag"),
        F.concat(F.lit("b"), (F.col("conv_id") % 4).cast("string")).alias("batch"),
    )


FOLD_CTE = FEED_CTE + """, decided AS (
  SELECT asset_id, arg_max(lower(verdict), file * 1000 + seq) AS v FROM feed
  WHERE lower(verdict) IN ('accept', 'reject', 'hero') GROUP BY asset_id
), said AS (SELECT asset_id, arg_max(caption, file * 1000 + seq) AS c FROM feed WHERE caption IS NOT NULL GROUP BY asset_id),
folded AS (
  SELECT a.asset_id, CASE WHEN v = 'reject' THEN 'reject' WHEN v IS NOT NULL THEN 'accept' ELSE review_status END AS review_status,
    CASE WHEN v = 'hero' THEN true WHEN v = 'accept' THEN false ELSE is_hero END AS is_hero,
    CASE WHEN v IS NOT NULL THEN coalesce(c, caption) ELSE caption END AS caption
  FROM assets a LEFT JOIN decided USING (asset_id) LEFT JOIN said USING (asset_id)
)"""


@query("o6_fold_decisions", sql(FOLD_CTE + " SELECT * FROM folded"))
def o6_fold_decisions(spark, sf_dir):
    return review.fold_decisions(asset_view(spark, sf_dir), feed(spark, sf_dir)).select(
        "asset_id", "review_status", "is_hero", "caption"
    )


@query("a14_accept_bound", sql(FOLD_CTE + """
SELECT count(*) FILTER (review_status = 'accept') AS accept_count, count(*) FILTER (is_hero) AS hero_count,
  count(*) FILTER (review_status = 'accept') BETWEEN 150 AND 250 AS in_bound FROM folded"""))
def a14_accept_bound(spark, sf_dir):
    counts = review.accept_counts(o6_fold_decisions(spark, sf_dir))
    return counts.withColumn("in_bound", F.col("accept_count").between(150, 250))


@query("o7_fold_eras", sql(FEED_CTE + """, last AS (
  SELECT asset_id, arg_max(era, file * 1000 + seq) AS era FROM feed WHERE era <> '' GROUP BY asset_id)
SELECT a.asset_id, coalesce(era, chapter) AS chapter FROM assets a LEFT JOIN last USING (asset_id)"""))
def o7_fold_eras(spark, sf_dir):
    return review.fold_eras(asset_view(spark, sf_dir), feed(spark, sf_dir)).select("asset_id", "chapter")


@query("a1_applied_eras", sql(FEED_CTE + """
SELECT era, count(*) AS applied FROM feed WHERE era <> '' AND asset_id IN (SELECT asset_id FROM assets) GROUP BY era"""))
def a1_applied_eras(spark, sf_dir):
    return review.applied_counts(feed(spark, sf_dir), asset_view(spark, sf_dir), "era")


@query("o8_fold_events", sql(FEED_CTE + """, named AS (
  SELECT *, CASE length(date) WHEN 4 THEN date || '-07-01T12:00:00' WHEN 7 THEN date || '-15T12:00:00'
    WHEN 10 THEN date || 'T12:00:00' END AS iso FROM feed WHERE event IS NOT NULL
), last AS (SELECT asset_id, arg_max(event, file * 1000 + seq) AS ev,
    arg_max(iso, file * 1000 + seq) FILTER (iso IS NOT NULL) AS iso FROM named GROUP BY asset_id)
SELECT a.asset_id, coalesce(ev, event) AS event, coalesce(iso, best_datetime) AS best_datetime,
  CASE WHEN iso IS NOT NULL THEN 'event' ELSE date_source END AS date_source,
  CASE WHEN iso IS NOT NULL THEN 'medium' ELSE date_confidence END AS date_confidence
FROM assets a LEFT JOIN last USING (asset_id)"""))
def o8_fold_events(spark, sf_dir):
    return review.fold_events(asset_view(spark, sf_dir), feed(spark, sf_dir)).select(
        "asset_id", "event", "best_datetime", "date_source", "date_confidence"
    )


@query("o9_fold_cuts", sql(FEED_CTE + """
SELECT asset_id, CASE WHEN review_status = 'accept' AND asset_id IN (SELECT asset_id FROM feed WHERE verdict = 'reject')
  THEN 'reject' ELSE review_status END AS review_status FROM assets"""))
def o9_fold_cuts(spark, sf_dir):
    cuts = feed(spark, sf_dir).where("verdict = 'reject'")
    return review.fold_cuts(asset_view(spark, sf_dir), cuts).select("asset_id", "review_status")


@query("o9_cut_counts", sql(FEED_CTE + """, first AS (
  SELECT asset_id, arg_min(batch, file * 1000 + seq) AS era FROM feed WHERE verdict = 'reject' GROUP BY asset_id)
SELECT era, count(*) AS cut FROM first JOIN assets USING (asset_id) WHERE review_status = 'accept' GROUP BY era"""))
def o9_cut_counts(spark, sf_dir):
    cuts = feed(spark, sf_dir).where("verdict = 'reject'").withColumn("era", F.col("batch"))
    return review.cut_counts(asset_view(spark, sf_dir), cuts)


@query("o10_set_flag", sql(FEED_CTE + """, kinds AS (
  SELECT *, CASE seq % 3 WHEN 0 THEN 'favorite' WHEN 1 THEN 'hero' ELSE 'reject' END AS kind, verdict <> 'reject' AS val FROM feed
), last AS (
  SELECT asset_id, arg_max(val, file * 1000 + seq) FILTER (kind = 'favorite') AS fav,
    arg_max(val, file * 1000 + seq) FILTER (kind = 'hero') AS hero, count(*) FILTER (kind = 'reject') AS rej
  FROM kinds GROUP BY asset_id)
SELECT a.asset_id, coalesce(fav, favorited) AS favorited, coalesce(hero, is_hero) AS is_hero,
  CASE WHEN rej > 0 THEN 'reject' ELSE review_status END AS review_status
FROM assets a LEFT JOIN last USING (asset_id)"""))
def o10_set_flag(spark, sf_dir):
    kinds = feed(spark, sf_dir).select(
        "file", "seq", "asset_id",
        F.when(F.col("seq") % 3 == 0, "favorite").when(F.col("seq") % 3 == 1, "hero").otherwise("reject").alias("kind"),
        (F.col("verdict") != "reject").alias("on"),
    )
    return review.set_flags(asset_view(spark, sf_dir), kinds).select(
        "asset_id", "favorited", "is_hero", "review_status"
    )


TAGS_CTE = FEED_CTE + """, pairs AS (SELECT DISTINCT asset_id, trim(tag) AS tag FROM feed),
have AS (SELECT *, list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '') AS have_tags FROM assets),
fresh AS (SELECT p.asset_id, p.tag FROM pairs p JOIN have USING (asset_id) WHERE NOT list_contains(have_tags, tag))"""


@query("o4_tag_union", sql(TAGS_CTE + """, n AS (SELECT asset_id, list(tag) AS new FROM fresh GROUP BY asset_id)
SELECT asset_id, coalesce(length(new), 0) AS n_added,
  CASE WHEN new IS NULL THEN tags ELSE array_to_string(list_sort(list_distinct(list_concat(have_tags, new))), ',') END AS tags
FROM have LEFT JOIN n USING (asset_id)"""))
def o4_tag_union(spark, sf_dir):
    return review.fold_tags(asset_view(spark, sf_dir), feed(spark, sf_dir)).select(
        "asset_id", F.col("n_added").cast("bigint").alias("n_added"), "tags"
    )


@query("o4_tag_additions", sql(TAGS_CTE + " SELECT tag, count(*) AS added FROM fresh GROUP BY tag"))
def o4_tag_additions(spark, sf_dir):
    return review.tag_additions(asset_view(spark, sf_dir), feed(spark, sf_dir))


@query("a17_review_progress", sql(FEED_CTE + """, last AS (
  SELECT batch, asset_id, arg_max(lower(verdict), file * 1000 + seq) AS v FROM feed GROUP BY ALL
), per AS (
  SELECT batch, count(*) FILTER (v IN ('accept', 'hero')) AS accepted, count(*) FILTER (v = 'reject') AS rejected,
    count(*) FILTER (v = 'hero') AS heroes, count(*) AS touched FROM last GROUP BY batch)
SELECT * FROM per UNION ALL
SELECT 'all', sum(accepted)::BIGINT, sum(rejected)::BIGINT, sum(heroes)::BIGINT, sum(touched)::BIGINT FROM per"""))
def a17_review_progress(spark, sf_dir):
    return review.review_progress(feed(spark, sf_dir))


@query("j8_missing_refs", sql(FEED_CTE + """
SELECT DISTINCT asset_id FROM feed WHERE asset_id NOT IN (SELECT asset_id FROM assets)"""))
def j8_missing_refs(spark, sf_dir):
    return review.unknown_ids(feed(spark, sf_dir), asset_view(spark, sf_dir))


@query("a15_first_ids", sql(FEED_CTE + """, lost AS (
  SELECT DISTINCT asset_id FROM feed WHERE asset_id NOT IN (SELECT asset_id FROM assets))
SELECT (SELECT count(*) FROM lost) AS total,
  coalesce((SELECT string_agg(asset_id, ',' ORDER BY asset_id) FROM (SELECT * FROM lost ORDER BY 1 LIMIT 5)), '') AS sample"""))
def a15_first_ids(spark, sf_dir):
    return review.first_ids(j8_missing_refs(spark, sf_dir))


@query("f8_id_format", sql(FEED_CTE + """
SELECT asset_id, regexp_full_match(asset_id, '[0-9a-f]{40}') AS ok, count(*) AS n FROM feed GROUP BY ALL"""))
def f8_id_format(spark, sf_dir):
    return feed(spark, sf_dir).groupBy("asset_id", text.is_asset_id(F.col("asset_id")).alias("ok")).agg(F.count("*").alias("n"))


@query("s7_read_sweeps", """
SELECT lpad(conv_id::VARCHAR, 6, '0') AS file, turn::VARCHAR AS asset_id, lower(role) AS verdict FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1""")
def s7_read_sweeps(spark, sf_dir):
    # One decision document per conversation, written as JSON text and parsed back.
    entries = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    documents = entries.groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "role"))).alias("decisions")
    ).select(
        F.lpad(F.col("conv_id").cast("string"), 6, "0").alias("file"),
        F.to_json(F.struct("decisions")).alias("value"),
    )
    return sweeps.parse_decisions(documents).select("file", "asset_id", F.lower("verdict").alias("verdict"))


def sweep_documents(spark, sf_dir):
    """(kind, file, value): each conversation as one JSON document of every kind that lists ids."""
    entries = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    conv = F.col("conv_id")
    # A document holds its conversation; the turns of one role stand under that theme.
    listed = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string"))
    whole = entries.groupBy("conv_id").agg(listed.alias("asset_ids"))
    themes = entries.groupBy("conv_id", "role").agg(listed.alias("ids")).groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), "role"), "ids"))).alias("themes"))
    era = F.concat(F.lit("era_"), (conv % 3).cast("string"))
    date = F.when(conv % 2 == 0, F.concat(F.lit("2024-0"), (conv % 9 + 1).cast("string")))
    as_kind = lambda kind, rows, *fields: rows.select(
        F.lit(kind).alias("kind"), F.lpad(conv.cast("string"), 6, "0").alias("file"), F.to_json(F.struct(*fields)).alias("value"))
    odd, even = whole.where(conv % 2 == 1), themes.where(conv % 2 == 0)
    parts = [
        as_kind("eras", whole, era.alias("era"), "asset_ids"),
        as_kind("events", whole, F.concat(F.lit("Event "), (conv % 7).cast("string")).alias("event"), date.alias("date"), "asset_ids"),
        as_kind("tags", odd, F.lit(" odd ").alias("tag"), "asset_ids"),
        as_kind("tags", even, "themes"),
        as_kind("cuts", whole, F.when(conv % 5 > 0, era).alias("era"), F.col("asset_ids").alias("cut")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s7_sweep_kinds", """
WITH e AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL),
n AS (SELECT lpad(conv_id::VARCHAR, 6, '0') AS file, turn::VARCHAR AS asset_id, conv_id, role, 'era_' || conv_id % 3 AS era,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS role_seq FROM e)
SELECT 'eras' AS kind, file, seq, asset_id, era AS label, NULL AS date FROM n
UNION ALL SELECT 'events', file, seq, asset_id, 'Event ' || conv_id % 7, CASE WHEN conv_id % 2 = 0 THEN '2024-0' || (conv_id % 9 + 1) END FROM n
UNION ALL SELECT 'tags', file, CASE WHEN conv_id % 2 = 0 THEN role_seq ELSE seq END, asset_id, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'odd' END, NULL FROM n
UNION ALL SELECT 'cuts', file, seq, asset_id, CASE WHEN conv_id % 5 > 0 THEN era ELSE '?' END, NULL FROM n""")
def s7_sweep_kinds(spark, sf_dir):
    """Era, event, tag (both shapes) and cut sweeps, stored as documents and read back by their parsers."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sweeps-{uuid.uuid4().hex}"
    sweep_documents(spark, sf_dir).write.partitionBy("kind").parquet(folder)
    labels = {"eras": "era", "events": "event", "tags": "tag", "cuts": "era"}
    parts = []
    for kind, label in labels.items():
        rows = sweeps.PARSERS[kind](spark.read.schema("file string, value string").parquet(f"{folder}/kind={kind}"))
        date = F.col("date") if kind == "events" else F.lit(None).cast("string")
        parts.append(rows.select(F.lit(kind).alias("kind"), "file", F.col("seq").cast("bigint").alias("seq"), "asset_id",
                                 F.col(label).alias("label"), date.alias("date")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- selections -------------------------------------------------------------------------------

SELECTIONS = {
    "shortlist": ({}, "review_status IN ('pending', 'accept')"),
    "pending": ({"include_accepted": False}, "review_status = 'pending'"),
    "batch": ({"batch": "B1"}, "ingest_batch = 'B1' AND review_status = 'pending'"),
    "batch_all": ({"batch": "B2", "batch_all": True},
                  "ingest_batch = 'B2' AND quality_pass AND (review_status IS NULL OR review_status IN ('pending', 'accept'))"),
    "all": ({"only_shortlist": False}, "true"),
}


@query("f1_review_selection", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS mode, asset_id FROM assets WHERE is_dup_keep AND {w}" for k, (_, w) in SELECTIONS.items())))
def f1_review_selection(spark, sf_dir):
    rows, out = asset_view(spark, sf_dir), None
    for mode, (args, _) in SELECTIONS.items():
        part = review.review_selection(rows, **args).select(F.lit(mode).alias("mode"), "asset_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("f3_accepted", sql("""SELECT asset_id, chapter FROM assets
WHERE review_status = 'accept' AND chapter IN ('01_early', '03_home')"""))
def f3_accepted(spark, sf_dir):
    return review.accepted(asset_view(spark, sf_dir), ["01_early", "03_home"]).select("asset_id", "chapter")
