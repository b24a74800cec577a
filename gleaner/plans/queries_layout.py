"""Layouts of the book's pages, and face boxes from the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import flags, geometry
from gleaner.functions.text import base_name
from gleaner.operators import faces, layout, moments
from gleaner.plans.assets import asset_view, sql, table
from gleaner.plans.queries_story import PAGES_CTE, accepted, book_pages
from gleaner.plans.registry import query
from gleaner.session import cut_lineage

TAGGED = "list_has_any(list_transform(string_split(tags, ','), lambda t: lower(trim(t))), ['family', 'milestones'])"
ITEMS_CTE = PAGES_CTE + f""", items AS (
  SELECT b.page_number AS page, b.spread, b.side, b.cell AS pos, b.asset_id, b.w AS px_w, b.h AS px_h, b.w / b.h AS ratio,
    b.spread_no = 0 AS title, count(*) OVER (PARTITION BY b.page_number) AS k,
    CASE WHEN a.is_hero THEN 3 WHEN a.favorited THEN 2 WHEN {TAGGED} THEN 1 ELSE 0 END AS weight
  FROM book b JOIN assets a USING (asset_id)
), recipes(k, recipe_no, in_rows, strip) AS (VALUES
  (1, 0, true, [0]), (1, 1, false, [0]), (2, 0, true, [0, 1]), (2, 1, false, [0, 1]), (2, 2, true, [0, 0]), (2, 3, false, [0, 0]),
  (3, 0, true, [0, 1, 1]), (3, 1, false, [0, 1, 1]), (3, 2, true, [0, 0, 1]), (3, 3, false, [0, 0, 1]), (3, 4, true, [0, 0, 0]), (3, 5, false, [0, 0, 0]),
  (4, 0, true, [0, 0, 1, 1]), (4, 1, false, [0, 0, 1, 1]), (4, 2, true, [0, 1, 1, 1]), (4, 3, false, [0, 1, 1, 1]), (4, 4, true, [0, 0, 0, 1]), (4, 5, false, [0, 0, 0, 1])
)"""
# Cells of ``cand`` (c = candidate key, page, title, k, in_rows, slot, strip_no, ratio), one row per slot.
CELLS_CTE = """, dims AS (
  SELECT *, 11.76 - CASE WHEN title THEN 0.65 ELSE 0 END AS uh, 0.12 + CASE WHEN title THEN 0.65 ELSE 0 END AS top FROM cand
), ax AS (
  SELECT *, CASE WHEN in_rows THEN 11.76 ELSE uh END AS along, CASE WHEN in_rows THEN uh ELSE 11.76 END AS across,
    CASE WHEN in_rows THEN ratio ELSE 1 / ratio END AS r FROM dims
), strips AS (
  SELECT c, strip_no, any_value(across) AS across, any_value(k) AS k, (any_value(along) - 0.05 * (count(*) - 1)) / sum(r) AS t FROM ax GROUP BY c, strip_no
), tot AS (SELECT *, sum(t) OVER (PARTITION BY c) AS st, count(*) OVER (PARTITION BY c) AS n FROM strips),
sc AS (SELECT *, least(1, across / greatest(0.0001, st + 0.05 * (n - 1))) AS scale FROM tot),
gp AS (SELECT *, CASE WHEN k >= 4 AND n > 1 THEN greatest(0.05, (across - st * scale) / (n - 1)) ELSE 0.05 END AS gap,
  CASE WHEN k >= 4 AND n > 1 THEN 0 ELSE greatest(0, (across - (st * scale + 0.05 * (n - 1))) / 2) END AS first FROM sc),
sp6 AS (SELECT *, first + coalesce(sum(t * scale) OVER (PARTITION BY c ORDER BY strip_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap * strip_no AS off FROM gp),
it AS (SELECT ax.*, s.off, s.t * s.scale AS th, ax.r * s.t * s.scale AS len FROM ax JOIN sp6 s ON s.c = ax.c AND s.strip_no = ax.strip_no),
il AS (SELECT *, sum(len) OVER (PARTITION BY c, strip_no) AS used, count(*) OVER (PARTITION BY c, strip_no) AS m,
  coalesce(sum(len) OVER (PARTITION BY c, strip_no ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY c, strip_no ORDER BY slot) - 1 AS j FROM it),
ig AS (SELECT *, CASE WHEN k >= 4 AND m > 1 THEN greatest(0.05, (along - used) / (m - 1)) ELSE 0.05 END AS igap,
  CASE WHEN k >= 4 AND m > 1 THEN 0 ELSE greatest(0, (along - (used + 0.05 * (m - 1))) / 2) END AS ifirst FROM il),
cells AS (SELECT *, round(0.12 + CASE WHEN in_rows THEN ifirst + before + igap * j ELSE off END, 4) AS x,
  round(top + CASE WHEN in_rows THEN off ELSE ifirst + before + igap * j END, 4) AS y,
  round(CASE WHEN in_rows THEN len ELSE th END, 4) AS w, round(CASE WHEN in_rows THEN th ELSE len END, 4) AS h FROM ig)"""


def items(spark, sf_dir):
    """Items of the book's pages with size, title flag and feature weight."""
    extra = accepted(spark, sf_dir).select(
        "asset_id", flags.feature_weight(F.col("is_hero"), F.col("favorited"), F.col("tags")).alias("weight"),
        "people_count", "best_datetime",
    )
    pages = book_pages(spark, sf_dir).select(
        F.col("page_number").alias("page"), "spread", "side", F.col("cell").alias("pos"), "asset_id", "is_hero", "orig_path",
        F.col("w").alias("px_w"), F.col("h").alias("px_h"), F.col("opener").alias("title"), "chapter",
    )
    return cut_lineage(pages.join(extra.drop("best_datetime"), "asset_id"))


def _grid(spark, sf_dir, in_rows):
    recipes = layout.default_recipes(spark).where(F.col("in_rows") == in_rows)
    rows = layout.grid(layout.page_rows(items(spark, sf_dir)), recipes)
    return rows.select(
        "page", F.col("recipe_no").cast("bigint").alias("recipe_no"), "items", F.posexplode("cells").alias("at", "c")
    ).select(
        "page", "recipe_no", F.get("items.asset_id", F.col("at")).alias("asset_id"),
        *[F.round(F.col(f"c.{v}") + 1e-6, 3).alias(v) for v in "xywh"],
    )


GRID_SQL = ITEMS_CTE + """, cand AS (
  SELECT page || '/' || r.recipe_no AS c, page, title, i.k, in_rows, r.recipe_no, pos AS slot, strip[pos + 1] AS strip_no, ratio, asset_id
  FROM items i JOIN recipes r ON r.k = i.k AND r.in_rows = {0}
)""" + CELLS_CTE + """ SELECT page, recipe_no::BIGINT AS recipe_no, asset_id, round(x + 1e-6, 3) AS x, round(y + 1e-6, 3) AS y, round(w + 1e-6, 3) AS w, round(h + 1e-6, 3) AS h FROM cells"""


@query("l1_row_grid", sql(GRID_SQL.replace("{0}", "true")))
def l1_row_grid(spark, sf_dir):
    return _grid(spark, sf_dir, True)


@query("l2_column_grid", sql(GRID_SQL.replace("{0}", "false")))
def l2_column_grid(spark, sf_dir):
    return _grid(spark, sf_dir, False)


CAND_CTE = ITEMS_CTE + """, digits(i) AS (VALUES (0), (1), (2), (3)),
perms AS (
  SELECT 1 AS k, [0] AS perm UNION ALL SELECT 2, [a.i, b.i] FROM digits a, digits b WHERE a.i < 2 AND b.i < 2 AND a.i <> b.i
  UNION ALL SELECT 3, [a.i, b.i, c.i] FROM digits a, digits b, digits c WHERE a.i < 3 AND b.i < 3 AND c.i < 3 AND a.i <> b.i AND a.i <> c.i AND b.i <> c.i
  UNION ALL SELECT 4, [a.i, b.i, c.i, d.i] FROM digits a, digits b, digits c, digits d
    WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND b.i <> c.i AND b.i <> d.i AND c.i <> d.i
), ranked_perms AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY perm) - 1 AS order_no FROM perms),
cand AS (
  SELECT page || '/' || r.recipe_no || '/' || order_no AS c, page, spread, side, title, i.k, in_rows, r.recipe_no, order_no,
    list_position(perm, pos) - 1 AS slot, strip[list_position(perm, pos)] AS strip_no, ratio, asset_id, px_w, px_h, weight,
    abs(list_position(perm, pos) - 1 - pos) AS moved
  FROM items i JOIN recipes r ON r.k = i.k JOIN ranked_perms p ON p.k = i.k WHERE NOT title OR perm[1] = 0
)""" + CELLS_CTE + """, meas AS (
  SELECT *, CASE WHEN ratio >= w / h THEN w ELSE h * ratio END AS pw, CASE WHEN ratio >= w / h THEN w / ratio ELSE h END AS ph FROM cells
), per AS (
  SELECT page, any_value(spread) AS spread, any_value(side) AS side, recipe_no, order_no, any_value(in_rows) AS in_rows, any_value(title) AS title,
    sum(pw * ph) AS area, sum(greatest(0, 240 - least(px_w / pw, px_h / ph))) AS deficit,
    sum(pw * ph) + 0.6 * sum(weight * pw * ph) - 50 * sum(greatest(0, 240 - least(px_w / pw, px_h / ph))) - sum(moved) * 1e-6 AS score,
    min(x) AS ex, min(y) AS ey, max(x + w) AS er, max(y + h) AS eb, arg_max(asset_id, w * h) AS largest
  FROM meas GROUP BY page, recipe_no, order_no
), best_order AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY page, recipe_no ORDER BY score DESC, order_no) = 1)"""


def candidates(spark, sf_dir):
    rows = items(spark, sf_dir)
    found = layout.recipe_candidates(layout.page_rows(rows, 4), layout.default_recipes(spark), layout.order_table(spark, 4))
    sides = rows.select("page", "spread", "side").distinct()
    return found.join(sides, "page")


@query("l3_recipe_candidates", sql(CAND_CTE + """
SELECT page, recipe_no::BIGINT AS recipe_no, round(area, 2) AS area, round(deficit, 1) AS deficit FROM best_order"""))
def l3_recipe_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "page", F.col("recipe_no").cast("bigint").alias("recipe_no"), F.round("area", 2).alias("area"), F.round("deficit", 1).alias("deficit")
    )


FULL_PAGES = """WITH RECURSIVE lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS n FROM lineitem
), items AS (
  SELECT l_orderkey || '/' || n // 7 AS page, n % 7 AS pos, count(*) OVER (PARTITION BY l_orderkey, n // 7) AS k, 200 + p_size * 60 AS px_w, 300 + p_partkey % 50 * 70 AS px_h,
    (200 + p_size * 60) / (300 + p_partkey % 50 * 70) AS ratio, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END AS weight,
    o_orderpriority = '1-URGENT' AND n < 7 AS title
  FROM lines JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
), recipes(no, sizes) AS (VALUES
  (0, [1]), (0, [1, 1]), (1, [2]), (0, [1, 2]), (1, [2, 1]), (2, [3]), (0, [2, 2]), (1, [1, 3]), (2, [3, 1]),
  (0, [2, 3]), (1, [3, 2]), (2, [1, 2, 2]), (3, [2, 2, 1]), (4, [1, 4]), (5, [4, 1]),
  (0, [3, 3]), (1, [2, 2, 2]), (2, [1, 2, 3]), (3, [3, 2, 1]), (4, [2, 4]), (5, [4, 2]),
  (0, [3, 4]), (1, [4, 3]), (2, [2, 3, 2]), (3, [1, 3, 3]), (4, [3, 3, 1])
), deal(no, sizes, strip) AS (
  SELECT no, sizes, []::INTEGER[] FROM recipes
  UNION ALL
  SELECT no, sizes, list_append(strip, s) FROM deal, (SELECT unnest(range(0, 4))::INTEGER AS s)
  WHERE len(strip) < list_sum(sizes) AND s < len(sizes) AND len(list_filter(strip, lambda x: x = s)) < sizes[s + 1]
), dealt AS (
  SELECT no, sizes, strip, list_sum(sizes) AS k, row_number() OVER () AS c FROM deal WHERE len(strip) = list_sum(sizes)
), cand AS (
  SELECT page, title, c, i.k, 2 * no + CASE WHEN in_rows THEN 0 ELSE 1 END AS recipe_no, in_rows, strip[pos + 1] AS s, ratio, px_w, px_h, weight,
    CASE WHEN in_rows THEN ratio ELSE 1 / ratio END AS r, 11.76 - CASE WHEN title THEN 0.65 ELSE 0 END AS uh
  FROM items i JOIN dealt d ON d.k = i.k, (VALUES (true), (false)) o(in_rows)
  WHERE NOT title OR strip[1] = 0
), thick AS (
  SELECT page, c, in_rows, s, any_value(uh) AS uh, (any_value(CASE WHEN in_rows THEN 11.76 ELSE uh END) - 0.05 * (count(*) - 1)) / sum(r) AS t
  FROM cand GROUP BY page, c, in_rows, s
), shrink AS (
  SELECT page, c, in_rows, least(1, any_value(CASE WHEN in_rows THEN uh ELSE 11.76 END) / greatest(0.0001, sum(t) + 0.05 * (count(*) - 1))) AS by_
  FROM thick GROUP BY page, c, in_rows
), cells AS (
  SELECT cand.*, round(CASE WHEN in_rows THEN r * t * by_ ELSE t * by_ END, 4) AS w, round(CASE WHEN in_rows THEN t * by_ ELSE r * t * by_ END, 4) AS h
  FROM cand JOIN thick USING (page, c, in_rows, s) JOIN shrink USING (page, c, in_rows)
), fit AS (
  SELECT *, CASE WHEN ratio >= w / h THEN w ELSE h * ratio END AS pw, CASE WHEN ratio >= w / h THEN w / ratio ELSE h END AS ph FROM cells
), per AS (
  SELECT page, c, recipe_no, any_value(k) AS k, sum(pw * ph) AS area, sum(greatest(0, 240 - least(px_w / pw, px_h / ph))) AS deficit,
    sum(pw * ph) + 0.6 * sum(weight * pw * ph) - 50 * sum(greatest(0, 240 - least(px_w / pw, px_h / ph))) AS score
  FROM fit GROUP BY page, c, recipe_no
)
SELECT page, recipe_no::BIGINT AS recipe_no, max(k)::BIGINT AS k, round(max(score) / 50 + 0.0123456, 0) AS points FROM per GROUP BY page, recipe_no"""


def order_items(spark, sf_dir):
    """Orders as pages of one to seven items, longer ones on several pages; their parts are the pictures."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    lines = table(spark, sf_dir, "lineitem").withColumn("n", place - 1).withColumn("sheet", F.floor(F.col("n") / 7))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), (200 + F.col("p_size") * 60).alias("px_w"), (300 + F.col("p_partkey") % 50 * 70).alias("px_h")
    )
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderpriority") == "1-URGENT").alias("title"))
    weight = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return lines.join(parts, "l_partkey").join(titles, "l_orderkey").select(
        F.concat_ws("/", "l_orderkey", "sheet").alias("page"), (F.col("n") % 7).alias("pos"), F.col("l_partkey").cast("string").alias("asset_id"), "px_w", "px_h", weight.alias("weight"),
        (F.col("title") & (F.col("sheet") == 0)).alias("title"),
    )


@query("l3_full_pages", FULL_PAGES)
def l3_full_pages(spark, sf_dir):
    # A cell side half way between two roundings moves the score by some tenths, so it is compared in points of 50.
    found = layout.strip_candidates(layout.page_rows(order_items(spark, sf_dir)), layout.default_recipes(spark))
    return found.select("page", F.col("recipe_no").cast("bigint").alias("recipe_no"), F.col("k").cast("bigint").alias("k"), F.round(F.col("score") / 50 + 0.0123456, 0).alias("points"))


PAIR_CTE = CAND_CTE + """, gr AS (SELECT *, eb - ey AS gh, (er - ex) / (eb - ey) AS ga FROM best_order),
pr AS (
  SELECT l.spread, l.recipe_no AS ln, r.recipe_no AS rn, l.area AS la, r.area AS ra, l.gh AS lgh, r.gh AS rgh, l.deficit + r.deficit AS def,
    abs(ln(l.ga / r.ga)) AS mis, l.in_rows = r.in_rows AS same, CASE WHEN l.title OR r.title THEN 11.11 ELSE 11.76 END AS uh, l.ga AS lga, r.ga AS rga
  FROM gr l JOIN gr r ON l.spread = r.spread AND l.side = 'left' AND r.side = 'right'
), ps AS (
  SELECT *, least(uh, 11.76 / lga, 11.76 / rga) AS ch FROM pr
), pv AS (
  SELECT *, (la * (ch / lgh) ** 2 + ra * (ch / rgh) ** 2) / (2 * 11.76 * uh) - 0.003 * def - 0.05 * mis + CASE WHEN same THEN 0.01 ELSE 0 END AS score FROM ps
), pair AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY spread ORDER BY round(score, 9) DESC, ln, rn) = 1)"""


@query("l4_facing_pair", sql(PAIR_CTE + " SELECT spread, round(score, 2) AS score FROM pair"))
def l4_facing_pair(spark, sf_dir):
    best = layout.facing_pair(candidates(spark, sf_dir))
    # Recipes can tie to the last digit, so only the score is compared.
    return best.select("spread", F.round("score", 2).alias("score"))


@query("l5_align_pair")
def l5_align_pair(spark, sf_dir):
    pages = layout.align_pair(layout.facing_pair(candidates(spark, sf_dir)))
    return pages.select("spread", "side", "recipe", F.posexplode("cells").alias("at", "c"), "arranged").select(
        "spread", "side", "recipe", F.get("arranged.asset_id", F.col("at")).alias("asset_id"), "c.x", "c.y", "c.w", "c.h"
    )


@query("l6_partitions", sql(ITEMS_CTE + """, parts(k, recipe_no, n_rows, strip) AS (VALUES (1, 0, 1, [0]), (2, 0, 2, [0, 1]), (2, 1, 1, [0, 0]),
  (3, 0, 3, [0, 1, 2]), (3, 1, 2, [0, 1, 1]), (3, 2, 2, [0, 0, 1]), (3, 3, 1, [0, 0, 0]),
  (4, 0, 3, [0, 1, 2, 2]), (4, 1, 3, [0, 1, 1, 2]), (4, 2, 2, [0, 1, 1, 1]), (4, 3, 3, [0, 0, 1, 2]), (4, 4, 2, [0, 0, 1, 1]), (4, 5, 2, [0, 0, 0, 1])),
cand AS (SELECT page || '/' || p.recipe_no AS c, page, title, 1 AS k, true AS in_rows, p.recipe_no, n_rows, pos AS slot, strip[pos + 1] AS strip_no, ratio
  FROM items i JOIN parts p ON p.k = i.k)""" + CELLS_CTE + """, area AS (
  SELECT page, recipe_no, any_value(n_rows) AS n_rows, sum(w * h) AS area FROM cells GROUP BY page, recipe_no)
SELECT page, round(area, 2) AS area, n_rows::BIGINT AS n_rows FROM area
QUALIFY row_number() OVER (PARTITION BY page ORDER BY area - 0.12 * (n_rows - 1) DESC, recipe_no) = 1"""))
def l6_partitions(spark, sf_dir):
    best = layout.best_partition(layout.page_rows(items(spark, sf_dir), 5), layout.partition_table(spark))
    return best.select("page", F.round("area", 2).alias("area"), F.size("sizes").cast("bigint").alias("n_rows"))


@query("l8_layout_list", sql(CAND_CTE + " SELECT page, recipe_no::BIGINT AS recipe_no, round(area / 144, 4) AS coverage FROM best_order"))
def l8_layout_list(spark, sf_dir):
    listed = layout.layout_list(candidates(spark, sf_dir)).orderBy("page", F.desc("coverage"))
    return listed.select("page", F.col("recipe_no").cast("bigint").alias("recipe_no"), F.col("coverage"))


# --- same moment on one page ------------------------------------------------------------------


def placed_hashes(spark, sf_dir):
    hashes = asset_view(spark, sf_dir, signals=True).select("asset_id", "phash", "best_datetime")
    pages = book_pages(spark, sf_dir).select("page_number", "spread", "asset_id")
    return pages.join(hashes, "asset_id")


NEAR_PAGE = """SELECT a.{0} AS page, a.asset_id AS asset_a, b.asset_id AS asset_b, (bit_count(xor(fa.hi, fb.hi)) + bit_count(xor(fa.lo, fb.lo)))::BIGINT AS distance
FROM book a JOIN book b ON a.{0} = b.{0} AND a.asset_id < b.asset_id AND left(a.best_datetime, 10) = left(b.best_datetime, 10)
JOIN fp fa ON fa.asset_id = a.asset_id JOIN fp fb ON fb.asset_id = b.asset_id
WHERE bit_count(xor(fa.hi, fb.hi)) + bit_count(xor(fa.lo, fb.lo)) <= {1}"""


@query("l9_same_moment_on_page", sql(PAGES_CTE + " " + NEAR_PAGE.format("page_number", 26), signals=True))
def l9_same_moment_on_page(spark, sf_dir):
    pairs = moments.same_moment_pairs(placed_hashes(spark, sf_dir).withColumnRenamed("page_number", "page"), 26)
    return pairs.withColumn("distance", F.col("distance").cast("bigint"))


@query("j4_same_moment_pairs", sql(PAGES_CTE + " " + NEAR_PAGE.format("spread", 28), signals=True))
def j4_same_moment_pairs(spark, sf_dir):
    pairs = moments.same_moment_pairs(placed_hashes(spark, sf_dir).withColumnRenamed("spread", "page"), 28)
    return pairs.withColumn("distance", F.col("distance").cast("bigint"))


# --- faces ------------------------------------------------------------------------------------

FACES_CTE = """, e AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS v FROM embeddings),
fb AS (SELECT vec_id, unnest(range(0, vec_id % 3)) AS j, v FROM e),
faces AS (
  SELECT d.asset_id, j AS face_no, least(0.8, v[4*j+1] * 2) AS x0, least(0.8, v[4*j+2] * 2) AS y0,
    least(1.0, least(0.8, v[4*j+1] * 2) + 0.05 + least(0.3, v[4*j+3])) AS x1, least(1.0, least(0.8, v[4*j+2] * 2) + 0.05 + least(0.3, v[4*j+4])) AS y1
  FROM fb JOIN docs d ON d.doc_id = fb.vec_id
), fa AS (SELECT asset_id, list({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY face_no) AS f, sum((x0 + x1) / 2) AS sx, sum((y0 + y1) / 2) AS sy, count(*) AS n FROM faces GROUP BY 1),
box AS (
  SELECT a.*, coalesce(f, []) AS f, coalesce(n, 0) AS n, sx, sy, 1.0 + (doc_id % 9) * 0.5 AS bw, 2.0 + (doc_id % 4) * 1.5 AS bh,
    coalesce(people_count > coalesce(n, 0), false) AS cautious, regexp_extract(orig_path, '([^/]*)$', 1) AS name
  FROM assets a LEFT JOIN fa USING (asset_id)
), c1 AS (
  SELECT *, CASE WHEN w / h >= bw / bh THEN (bw / bh) / (w / h) ELSE 1.0 END AS cw, CASE WHEN w / h >= bw / bh THEN 1.0 ELSE (w / h) / (bw / bh) END AS ch,
    CASE WHEN n > 0 AND NOT cautious THEN sx / n ELSE 0.5 END AS fx, CASE WHEN n > 0 AND NOT cautious THEN sy / n ELSE 0.5 END AS fy FROM box
), c2 AS (
  SELECT *, least(greatest(fx - cw / 2, 0), 1 - cw) AS ax, least(greatest(fy - ch / 2, 0), 1 - ch) AS ay, f[1] AS f1, f[2] AS f2 FROM c1
), c3 AS (SELECT *, CASE WHEN f1.x0 < ax THEN greatest(0, least(f1.x0, 1 - cw)) ELSE ax END AS bx, CASE WHEN f1.y0 < ay THEN greatest(0, least(f1.y0, 1 - ch)) ELSE ay END AS by_ FROM c2),
c4 AS (SELECT *, CASE WHEN f1.x1 > bx + cw THEN least(1 - cw, greatest(bx, f1.x1 - cw)) ELSE bx END AS cx, CASE WHEN f1.y1 > by_ + ch THEN least(1 - ch, greatest(by_, f1.y1 - ch)) ELSE by_ END AS cy FROM c3),
c5 AS (SELECT *, CASE WHEN f2.x0 < cx THEN greatest(0, least(f2.x0, 1 - cw)) ELSE cx END AS dx, CASE WHEN f2.y0 < cy THEN greatest(0, least(f2.y0, 1 - ch)) ELSE cy END AS dy FROM c4),
crops AS (
  SELECT *, round(CASE WHEN f2.x1 > dx + cw THEN least(1 - cw, greatest(dx, f2.x1 - cw)) ELSE dx END, 4) AS crop_x,
    round(CASE WHEN f2.y1 > dy + ch THEN least(1 - ch, greatest(dy, f2.y1 - ch)) ELSE dy END, 4) AS crop_y, round(cw, 4) AS crop_w, round(ch, 4) AS crop_h FROM c5
), clip AS (
  SELECT *, length(list_filter(f, lambda b: b.x0 < crop_x - 1e-6 OR b.y0 < crop_y - 1e-6 OR b.x1 > crop_x + crop_w + 1e-6 OR b.y1 > crop_y + crop_h + 1e-6)) > 0 AS clips FROM crops
), fit AS (
  SELECT *, NOT (upper(name) LIKE '%COLLAGE%' OR lower(name) LIKE '%\\_all\\_%' ESCAPE '\\')
    AND 1 - crop_w * crop_h <= CASE WHEN cautious THEN 0.12 WHEN n = 0 THEN 0.15 ELSE 0.45 END + 1e-6 AND NOT clips
    AND (least(w * crop_w / bw, h * crop_h / bh) >= 110 OR is_hero) AS cover FROM clip
), cont AS (
  SELECT *, CASE WHEN bw / bh >= w / h THEN bh * w / h ELSE bw END AS kw, CASE WHEN bw / bh >= w / h THEN bh ELSE bw / (w / h) END AS kh FROM fit
), shr AS (SELECT *, CASE WHEN NOT is_hero AND least(w / kw, h / kh) < 110 THEN least(w / kw, h / kh) / 110 ELSE 1 END AS s FROM cont)"""


def face_table(spark, sf_dir):
    """A deterministic box table: up to two boxes per embedded asset."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 3 > 0").select(
        "vec_id", v.alias("v"), F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 3 - 1).cast("int"))).alias("face_no")
    )
    at = lambda i: F.get("v", F.col("face_no") * 4 + i)
    x0, y0 = F.least(F.lit(0.8), at(0) * 2), F.least(F.lit(0.8), at(1) * 2)
    boxes = rows.select(
        "vec_id", "face_no", x0.alias("x0"), y0.alias("y0"),
        F.least(F.lit(1.0), x0 + 0.05 + F.least(F.lit(0.3), at(2))).alias("x1"),
        F.least(F.lit(1.0), y0 + 0.05 + F.least(F.lit(0.3), at(3))).alias("y1"),
    )
    ids = asset_view(spark, sf_dir).select("asset_id", "doc_id")
    return boxes.join(ids, F.col("vec_id") == F.col("doc_id")).select("asset_id", "face_no", "x0", "y0", "x1", "y1")


def boxed(spark, sf_dir):
    rows = faces.with_faces(asset_view(spark, sf_dir), face_table(spark, sf_dir))
    return rows.withColumns(
        {"bw": F.lit(1.0) + F.col("doc_id") % 9 * 0.5, "bh": F.lit(2.0) + F.col("doc_id") % 4 * 1.5, "name": base_name(F.col("orig_path"))}
    )


def _crops(spark, sf_dir):
    c = F.col
    rows = boxed(spark, sf_dir)
    cautious = F.coalesce(c("people_count") > F.size("faces"), F.lit(False))
    return rows.withColumn("crop", geometry.cover_crop(c("w"), c("h"), c("bw") / c("bh"), c("faces"), ~cautious))


@query("p24_cover_crop", sql(FACES_CTE + " SELECT asset_id, round(crop_x + 1e-9, 3) AS x, round(crop_y + 1e-9, 3) AS y, round(crop_w + 1e-9, 3) AS w, round(crop_h + 1e-9, 3) AS h FROM crops"))
def p24_cover_crop(spark, sf_dir):
    return _crops(spark, sf_dir).select("asset_id", *[F.round(F.col(f"crop.{v}") + 1e-9, 3).alias(v) for v in "xywh"])


@query("p25_resolve_cell", sql(FACES_CTE + """ SELECT asset_id, CASE WHEN cover THEN 'cover' ELSE 'contain' END AS fit,
  round(CASE WHEN cover THEN bw ELSE kw * s END + 1e-9, 4) AS w, round(CASE WHEN cover THEN bh ELSE kh * s END + 1e-9, 4) AS h FROM shr"""))
def p25_resolve_cell(spark, sf_dir):
    c = F.col
    r = geometry.resolve_cell(
        c("w"), c("h"), c("is_hero"), c("people_count"), c("name"), F.lit(False), c("faces"), F.lit(0.0), F.lit(0.0), c("bw"), c("bh")
    )
    return boxed(spark, sf_dir).select("asset_id", r.alias("r")).select(
        "asset_id", "r.fit", F.round(c("r.box.w") + 1e-9, 4).alias("w"), F.round(c("r.box.h") + 1e-9, 4).alias("h")
    )


@query("j12_face_in_crop", sql(FACES_CTE + " SELECT asset_id FROM clip WHERE clips"))
def j12_face_in_crop(spark, sf_dir):
    return faces.clipped(_crops(spark, sf_dir)).select("asset_id")


@query("v5_face_gate", sql(FACES_CTE + " SELECT count(*) FILTER (clips) AS clipped, count(*) FILTER (cover AND clips) AS clipped_covers FROM fit"))
def v5_face_gate(spark, sf_dir):
    c = F.col
    rows = _crops(spark, sf_dir)
    r = geometry.resolve_cell(
        c("w"), c("h"), c("is_hero"), c("people_count"), c("name"), F.lit(False), c("faces"), F.lit(0.0), F.lit(0.0), c("bw"), c("bh")
    )
    clips = geometry.clips_a_face(c("crop"), c("faces"))
    return rows.withColumn("r", r).agg(
        F.count_if(clips).alias("clipped"), F.count_if((c("r.fit") == "cover") & clips).alias("clipped_covers")
    )


@query("v6_gutter_scan", """
WITH e AS (SELECT vec_id + 1 AS page_no, floor(abs(embedding[1]::DOUBLE) * 9000)::BIGINT % 3000 AS x, floor(abs(embedding[2]::DOUBLE) * 3000)::BIGINT % 600 + 40 AS w FROM embeddings),
d AS (SELECT *, CASE WHEN page_no % 2 = 0 THEN 3637 - (x + w) ELSE x - 38 END AS distance FROM e WHERE page_no >= 2 AND page_no < (SELECT max(page_no) FROM e))
SELECT page_no, count(*) AS faces, round(min(distance) / 300 + 1e-9, 2) AS nearest, page_no % 2 = 0 AS verso, (page_no - 2) // 2 AS spread
FROM d WHERE distance < 105 GROUP BY page_no""")
def v6_gutter_scan(spark, sf_dir):
    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    boxes = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("page_no"), (F.floor(e(0) * 9000) % 3000).alias("x"), (F.floor(e(1) * 3000) % 600 + 40).alias("w")
    )
    return faces.gutter_scan(boxes)


@query("l7_fill_ladder")
def l7_fill_ladder(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"name": base_name(F.col("orig_path")), "curated": F.lit(False)})
    boxes = faces.with_faces(rows, face_table(spark, sf_dir))
    filled = layout.fill_ladder(boxes.select(
        "page", "pos", "asset_id", "px_w", "px_h", "is_hero", "people_count", "name", "curated", "faces", "title"
    ), layout.rowing_table(spark))
    return filled.select(
        "page", "pos", "n_rows", F.round("coverage", 5).alias("coverage"), "fit", "box.x", "box.y", "box.w", "box.h"
    )
