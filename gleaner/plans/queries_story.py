"""Story order, budgets, even samples and pagination over the accepted assets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import dates
from gleaner.operators import pagination, story
from gleaner.plans.assets import CHAPTERS, CONFIG, asset_view, sql, table
from gleaner.plans.registry import query
from gleaner.operators.chapters import chapter_dim
from gleaner.session import cut_lineage

WINDOWS = {c.id: (c.start, c.end) for c in CHAPTERS if c.id != "04_family"}

SLUG = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '-', 'g'), '-')"
GROUPS_CTE = f""", win(chapter, ws, we) AS (VALUES ('01_early', '2024-01-03', '2024-01-09'), ('02_travel', '2024-01-10', '2024-01-16'),
  ('03_home', '2024-01-17', '2024-01-23')),
acc AS (
  SELECT a.*, ws, we, CASE WHEN a.chapter = '02_travel' AND {SLUG.format('event')} IN ('trip-en', 'trip-de') THEN 'big-trip' ELSE {SLUG.format('event')} END AS ev,
    {SLUG.format('caption')} AS cap,
    list_filter(list_transform(string_split(tags, ','), lambda t: trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-')), lambda t: t <> '') AS tg,
    CASE WHEN date_source IN ('exif', 'sidecar', 'filename') THEN true WHEN date_source IN ('filename_seq', 'mtime') THEN false
      ELSE date_confidence IN ('high', 'medium') END AS trusted,
    row_number() OVER (PARTITION BY a.chapter, is_hero ORDER BY asset_id) - 1 AS hero_no
  FROM assets a LEFT JOIN win USING (chapter) WHERE review_status = 'accept'
), g0 AS (
  SELECT *, CASE WHEN is_hero AND chapter = '01_early' THEN hero_no END AS pin_no,
    CASE WHEN trusted OR ws IS NULL THEN coalesce(best_datetime, '9999')
      WHEN best_datetime IS NULL OR left(best_datetime, 10) < ws THEN ws WHEN left(best_datetime, 10) > we THEN we ELSE best_datetime END AS clamped
  FROM acc
), g1 AS (
  SELECT *, CASE WHEN clamped = '9999' THEN 1 ELSE 0 END AS flag,
    CASE WHEN length(clamped) = 10 THEN clamped || 'T00:00:00' ELSE clamped END AS sort_text,
    CASE WHEN pin_no IS NOT NULL THEN 'pinned' WHEN ev <> '' THEN 'event:' || ev
      WHEN chapter = '02_travel' AND list_contains(tg, 'milestones') THEN 'tag:milestones'
      WHEN chapter = '03_home' THEN 'source:' || src
      WHEN length(tg) > 0 THEN 'tag:' || tg[1] || ':' || left(coalesce(best_datetime, 'unknown'), 4)
      ELSE 'other' END AS story_group,
    CASE WHEN chapter = '02_travel' AND ev = 'big-trip' THEN 0 WHEN chapter = '02_travel' AND ev = '' AND list_contains(tg, 'milestones') THEN 1
      WHEN chapter = '03_home' AND ev = '' AND src IN ('src3', 'src1', 'src2') THEN 2 ELSE 3 END AS kind,
    CASE WHEN chapter = '03_home' AND ev = '' THEN coalesce(list_position(['src3', 'src1', 'src2'], src), 0) ELSE 0 END AS rank_no
  FROM g0
)"""
ORDER_CTE = GROUPS_CTE + """, g2 AS (
  SELECT *, min(CASE WHEN pin_no IS NULL THEN flag || sort_text END) OVER (PARTITION BY chapter, story_group) AS earliest FROM g1
), stories AS (
  SELECT *, coalesce(pin_no, 999 + row_number() OVER (PARTITION BY chapter, pin_no IS NULL
    ORDER BY kind, rank_no, CASE WHEN kind < 3 THEN '' ELSE earliest END, story_group, flag, sort_text, asset_id)) AS story_order
  FROM g2
)"""


def accepted(spark, sf_dir):
    return asset_view(spark, sf_dir).where("review_status = 'accept'")


def tables(spark, rows):
    """Configured settings; the heroes of the first chapter are its pins."""
    pins = rows.where("is_hero AND chapter = '01_early'").select(
        "chapter", "asset_id",
        (F.row_number().over(Window.partitionBy("chapter").orderBy("asset_id")) - 1).alias("pin_no"),
        F.lit("pinned").alias("pin_group"),
    )
    return replace(story.story_tables(spark, CONFIG.story, WINDOWS), pins=pins)


def storied(spark, sf_dir):
    rows = cut_lineage(accepted(spark, sf_dir).select(
        "asset_id", "chapter", "event", "tags", "is_hero", "favorited", "score", "w", "h", "best_datetime",
        "date_source", "date_confidence", "src", "caption", "orig_path",
    ))
    return story.story_order(rows, tables(spark, rows))


@query("p13_clamped_sort_date", sql(GROUPS_CTE + " SELECT asset_id, clamped FROM g1"))
def p13_clamped_sort_date(spark, sf_dir):
    rows = accepted(spark, sf_dir).join(story.story_tables(spark, CONFIG.story, WINDOWS).settings, "chapter", "left")
    return rows.select("asset_id", dates.clamped_sort_date(
        F.col("best_datetime"), dates.date_trust(F.col("date_source"), F.col("date_confidence")),
        F.col("window_start"), F.col("window_end")).alias("clamped"))


@query("j13_alias_lookup", sql(GROUPS_CTE + " SELECT asset_id, ev AS event_label FROM g1"))
def j13_alias_lookup(spark, sf_dir):
    from gleaner.functions.text import slug

    rows = accepted(spark, sf_dir).select("asset_id", "chapter", slug(F.col("event")).alias("event_label"))
    found = rows.join(story.story_tables(spark, CONFIG.story, WINDOWS).aliases, ["chapter", "event_label"], "left")
    return found.select("asset_id", F.coalesce("canonical", "event_label").alias("event_label"))


@query("w9_story_group", sql(GROUPS_CTE + " SELECT asset_id, story_group, kind::BIGINT AS kind FROM g1"))
def w9_story_group(spark, sf_dir):
    rows = accepted(spark, sf_dir)
    return story.story_groups(rows, tables(spark, rows)).select(
        "asset_id", "story_group", F.col("group_class.kind").cast("bigint").alias("kind")
    )


@query("w8_story_order", sql(ORDER_CTE + " SELECT asset_id, story_group, story_order FROM stories"))
def w8_story_order(spark, sf_dir):
    return storied(spark, sf_dir).select("asset_id", "story_group", "story_order")


SIZES = "SELECT source || '/' || lang AS chapter, count(*) AS n FROM documents GROUP BY 1"


def budget_sql(sizes: str, total: int) -> str:
    return f"""
sizes AS ({sizes}), t AS (SELECT *, least({total}, sum(n) OVER ()) AS total, n > 24 AS large,
  sum(CASE WHEN n > 24 THEN 0 ELSE n END) OVER () AS small, sum(CASE WHEN n > 24 THEN sqrt(n) ELSE 0 END) OVER () AS roots FROM sizes),
f AS (SELECT *, CASE WHEN large THEN least(n, greatest(4, round_even(greatest(0, total - small) * sqrt(n) / roots, 0)::BIGINT)) ELSE n END AS first FROM t),
d AS (SELECT *, (total - sum(first) OVER ())::BIGINT AS delta, row_number() OVER (ORDER BY large DESC, n DESC, chapter) AS rk FROM f),
u AS (SELECT chapter, rk, delta, unnest(range(1, least(CASE WHEN delta > 0 THEN n - first ELSE first - 4 END, abs(delta)) + 1)) AS rnd FROM d WHERE large AND delta <> 0),
s AS (SELECT chapter, delta, row_number() OVER (ORDER BY rnd, rk) AS ofs FROM u),
m AS (SELECT chapter, sum(sign(delta)) AS moved FROM s WHERE ofs <= abs(delta) GROUP BY chapter),
budget AS (SELECT chapter, n, (first + coalesce(moved, 0))::BIGINT AS target FROM d LEFT JOIN m USING (chapter))"""


@query("o5_budget_allocation", f"WITH {budget_sql(SIZES, 480)} SELECT * FROM budget")
def o5_budget_allocation(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(
        F.concat_ws("/", "source", "lang").alias("chapter")
    ).agg(F.count("*").alias("n"))
    return story.budgets(sizes, 480)


SAMPLE_CTE = ORDER_CTE + "," + budget_sql("SELECT chapter, count(*) AS n FROM stories GROUP BY 1", 240) + """, musts AS (
  SELECT s.*, b.n, CASE WHEN target >= b.n THEN b.n ELSE greatest(4, target) END AS k,
    is_hero OR favorited OR pin_no IS NOT NULL AS must
  FROM stories s JOIN budget b USING (chapter)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY chapter, must ORDER BY story_order, asset_id) AS place,
    count(*) FILTER (must) OVER (PARTITION BY chapter) AS m FROM musts
), slotted AS (
  SELECT p.*, s.slot FROM placed p LEFT JOIN LATERAL (
    SELECT slot FROM (SELECT unnest(range(0, greatest(p.k - p.m, 0))) AS slot)
    WHERE NOT p.must AND round_even(slot * (p.n - p.m) / (p.k - p.m), 0) <= p.place - 1
      AND p.place - 1 < round_even((slot + 1) * (p.n - p.m) / (p.k - p.m), 0)) s ON true
), best AS (
  SELECT asset_id, chapter, story_order, story_group, w, h, best_datetime FROM slotted WHERE k >= n OR (must AND place <= k)
  UNION ALL
  SELECT asset_id, chapter, story_order, story_group, w, h, best_datetime FROM slotted WHERE k < n AND NOT must AND k > m
  QUALIFY row_number() OVER (PARTITION BY chapter, slot ORDER BY is_hero DESC, favorited DESC, coalesce(score, 0) DESC, w * h DESC, place) = 1
)"""


def sampled(spark, sf_dir):
    rows = cut_lineage(storied(spark, sf_dir))
    targets = story.budgets(rows.groupBy("chapter").agg(F.count("*").alias("n")), 240)
    return story.even_sample(rows, targets)


@query("w7_even_sample", sql(SAMPLE_CTE + " SELECT asset_id, chapter FROM best"))
def w7_even_sample(spark, sf_dir):
    return sampled(spark, sf_dir).select("asset_id", "chapter")


@query("w10_spread_split", """
WITH sizes AS (SELECT o_custkey AS chapter, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT *, CASE WHEN n <= 7 THEN 1 ELSE -((-n) // 7) + CASE WHEN (-n) % 7 = 0 THEN 0 ELSE 0 END END AS s0 FROM sizes),
s AS (SELECT chapter, n, CASE WHEN n <= 7 THEN 1 ELSE (n + 6) // 7 END AS s FROM c),
e AS (SELECT *, unnest(range(0, s)) AS spread_no FROM s),
t AS (SELECT *, n // s + CASE WHEN spread_no < n % s THEN 1 ELSE 0 END AS n_items FROM e)
SELECT chapter, spread_no, n_items, CASE WHEN n_items % 2 = 1 AND spread_no % 2 = 0 THEN n_items // 2 + 1 ELSE n_items // 2 END AS left_items,
  n_items - CASE WHEN n_items % 2 = 1 AND spread_no % 2 = 0 THEN n_items // 2 + 1 ELSE n_items // 2 END AS right_items FROM t""")
def w10_spread_split(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chapter")).agg(F.count("*").alias("n"))
    # The view takes customers with enough orders for chapters.
    return pagination.spread_sizes(sizes.where("n >= 4"))


PAGES_CTE = SAMPLE_CTE + """, pos AS (
  SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY story_order, asset_id) - 1 AS p, count(*) OVER (PARTITION BY chapter) AS cn FROM best
), sp AS (SELECT *, CASE WHEN cn <= 7 THEN 1 ELSE (cn + 6) // 7 END AS s FROM pos WHERE cn >= 4),
sp2 AS (SELECT *, cn // s AS base, cn % s AS extra FROM sp),
sp3 AS (SELECT *, CASE WHEN p < extra * (base + 1) THEN p // (base + 1) ELSE extra + (p - extra * (base + 1)) // base END AS spread_no,
  CASE WHEN p < extra * (base + 1) THEN p % (base + 1) ELSE (p - extra * (base + 1)) % base END AS ofs FROM sp2),
sp4 AS (SELECT *, base + CASE WHEN spread_no < extra THEN 1 ELSE 0 END AS total FROM sp3),
sp5 AS (SELECT *, CASE WHEN total % 2 = 1 AND spread_no % 2 = 0 THEN total // 2 + 1 ELSE total // 2 END AS dl FROM sp4),
opts AS (
  SELECT DISTINCT s5.chapter, s5.spread_no, s5.total, s5.dl, l.l FROM sp5 s5, (VALUES (2), (3), (4)) l(l) WHERE s5.total - l.l BETWEEN 2 AND 4
), pen AS (
  SELECT o.*, (a.story_group = b.story_group)::INTEGER AS splits FROM opts o
  JOIN sp5 a ON a.chapter = o.chapter AND a.spread_no = o.spread_no AND a.ofs = o.l - 1
  JOIN sp5 b ON b.chapter = o.chapter AND b.spread_no = o.spread_no AND b.ofs = o.l
), pick AS (
  SELECT chapter, spread_no, l FROM pen
  QUALIFY row_number() OVER (PARTITION BY chapter, spread_no ORDER BY splits, abs(2 * l - total), abs(l - dl), l) = 1
), many AS (SELECT chapter, count(DISTINCT story_group) > 1 AS many FROM sp5 GROUP BY 1),
lefts AS (SELECT DISTINCT s5.chapter, s5.spread_no, CASE WHEN many THEN l ELSE dl END AS left_items FROM sp5 s5 JOIN pick USING (chapter, spread_no) JOIN many USING (chapter)),
pages AS (
  SELECT s5.*, left_items, CASE WHEN ofs < left_items THEN 'left' ELSE 'right' END AS side,
    CASE WHEN ofs < left_items THEN ofs ELSE ofs - left_items END AS cell, spread_no * 2 + CASE WHEN ofs < left_items THEN 1 ELSE 2 END AS chapter_page
  FROM sp5 s5 JOIN lefts USING (chapter, spread_no)
), nums AS (SELECT chapter, max(spread_no) + 1 AS cnt FROM pages GROUP BY 1),
starts AS (SELECT chapter, coalesce(sum(cnt) OVER (ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  row_number() OVER (ORDER BY chapter) AS ordinal FROM nums),
book AS (SELECT p.*, start + spread_no AS spread, ordinal, (start + spread_no) * 2 + CASE WHEN side = 'left' THEN 1 ELSE 2 END AS page_number FROM pages p JOIN starts USING (chapter))"""


def book_pages(spark, sf_dir):
    kept, _ = pagination.set_small_aside(cut_lineage(sampled(spark, sf_dir)))
    placed = pagination.place_on_spreads(kept)
    pages = pagination.assign_pages(placed, pagination.story_aware_left(placed))
    return pagination.number_spreads(pages, chapter_dim(spark, CHAPTERS))


@query("w11_story_aware_split", sql(PAGES_CTE + " SELECT asset_id, chapter, spread_no, side, cell, chapter_page FROM pages"))
def w11_story_aware_split(spark, sf_dir):
    return book_pages(spark, sf_dir).select("asset_id", "chapter", "spread_no", "side", "cell", "chapter_page")


@query("w12_first_of_chapter", sql(PAGES_CTE + """
SELECT DISTINCT spread, chapter, spread_no = 0 AS opener, ordinal AS chapter_ordinal FROM book"""))
def w12_first_of_chapter(spark, sf_dir):
    return book_pages(spark, sf_dir).select(
        "spread", "chapter", "opener", F.col("chapter_ordinal").cast("bigint").alias("chapter_ordinal")
    ).distinct()


@query("p26_spread_labels", sql(PAGES_CTE + """, sides AS (
  SELECT spread, bool_or(spread_no = 0) AS opener, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r,
    bool_or(w / h >= 2.2) AS pano FROM book GROUP BY spread)
SELECT spread, l AS left_items, r AS right_items,
  CASE WHEN pano AND NOT opener THEN 'panorama_plus_support' WHEN opener AND l = 3 AND r = 1 THEN 'chapter_triptych_plus_feature'
    WHEN opener AND l = 2 AND r = 2 THEN 'chapter_balanced_pair' WHEN opener AND l >= 3 AND r >= 3 THEN 'chapter_dense_pair'
    WHEN opener AND l < r THEN 'chapter_feature_plus_cluster' WHEN l < r THEN 'feature_plus_cluster'
    WHEN l > r THEN 'cluster_plus_feature' ELSE 'balanced_sequence' END AS archetype,
  CASE WHEN l <= 2 THEN 'feature' WHEN l >= 4 THEN 'cluster' ELSE 'sequence' END AS left_role,
  CASE WHEN r <= 3 THEN 1 WHEN r <= 5 THEN 2 ELSE 3 END::BIGINT AS right_weight,
  CASE WHEN r <= 2 THEN 'feature' WHEN r >= 4 THEN 'cluster' ELSE 'sequence' END AS right_role,
  CASE WHEN l <= 3 THEN 1 WHEN l <= 5 THEN 2 ELSE 3 END::BIGINT AS left_weight,
  ['single_feature', 'two_up', 'three_up', 'four_up', 'five_up', 'six_up', 'seven_gallery'][l] AS left_style,
  ['single_feature', 'two_up', 'three_up', 'four_up', 'five_up', 'six_up', 'seven_gallery'][r] AS right_style FROM sides"""))
def p26_spread_labels(spark, sf_dir):
    return pagination.spread_labels(book_pages(spark, sf_dir)).select(
        "spread", "left_items", "right_items", "archetype", "left_role", "right_role",
        *[F.col(c).cast("bigint").alias(c) for c in ("left_weight", "right_weight")], "left_style", "right_style",
    )


@query("w14_page_counts", """
WITH n AS (SELECT l_orderkey AS chapter, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT *, greatest(2, (n + 3) // 4) AS p0 FROM n),
e AS (SELECT chapter, n, p0 + p0 % 2 AS pages FROM p),
i AS (SELECT *, unnest(range(0, pages)) AS i, n // pages AS base, n % pages AS extra FROM e WHERE n >= 4)
SELECT chapter, i + 1 AS page_no, base + CASE WHEN pages = 2 AND extra = 1 THEN (i = CASE WHEN base % 2 = 0 THEN 0 ELSE 1 END)::INTEGER
  ELSE (CASE WHEN i % 2 = 1 THEN i // 2 ELSE pages // 2 + i // 2 END < extra)::INTEGER END AS items FROM i
UNION ALL SELECT chapter, unnest([1, 2]), unnest([1, 2]) FROM n WHERE n = 3
UNION ALL SELECT chapter, 0, n FROM n WHERE n < 3""")
def w14_page_counts(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chapter")).agg(F.count("*").alias("n"))
    found = pagination.split_pages(sizes, allow_single=True, set_aside=True)
    return found.withColumn("page_no", F.coalesce("page_no", F.lit(0)))  # 0: set aside, no page


@query("f5_draft_pool", sql("""SELECT asset_id, chapter FROM assets WHERE review_status = 'accept'
  AND (chapter <> '01_early' OR favorited OR is_hero OR people_count >= 2) AND NOT is_document"""))
def f5_draft_pool(spark, sf_dir):
    rows = accepted(spark, sf_dir)
    include = rows.where("chapter = '01_early' AND (favorited OR is_hero OR people_count >= 2)").select("chapter", "asset_id")
    exclude = rows.where("is_document").select("chapter", "asset_id")
    return story.draft_pool(rows, include, exclude).select("asset_id", "chapter")


@query("v9_override_permutation", """
WITH items AS (SELECT l_orderkey AS page, list_sort(list(l_partkey::VARCHAR)) AS given FROM lineitem GROUP BY 1),
wanted AS (SELECT l_orderkey AS page, list_sort(list(CASE WHEN l_orderkey % 5 = 0 AND l_discount > 0.08 THEN 'x' ELSE l_partkey::VARCHAR END)) AS w
  FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_returnflag = 'R') GROUP BY 1)
SELECT page, length(w) AS n_wanted, length(given) AS n_given FROM wanted JOIN items USING (page) WHERE w <> given""")
def v9_override_permutation(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").cast("string").alias("asset_id"), "l_discount", "l_returnflag"
    )
    wanted = items.where(~((F.col("page") % 7 == 0) & (F.col("l_returnflag") == "R"))).withColumn(
        "asset_id", F.when((F.col("page") % 5 == 0) & (F.col("l_discount") > 0.08), "x").otherwise(F.col("asset_id"))
    )
    found = pagination.override_mismatches(items, wanted)
    return found.select("page", F.col("n_wanted").cast("bigint").alias("n_wanted"), F.col("n_given").cast("bigint").alias("n_given"))
