"""Placements from lineitem: an order is a page, two orders a spread, a part an asset."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import geometry
from gleaner.operators import placement
from gleaner.plans.assets import table
from gleaner.plans.registry import query
from gleaner.session import dimension
from gleaner.sources import book

CHAPTER_WINDOWS = (
    ("1-URGENT", "1995-06-01", "1998-12-31"), ("2-HIGH", "1996-01-01", "1999-12-31"), ("5-LOW", "1997-01-01", "2001-12-31"),
)
BOOK_CTE = """WITH tpl AS (
  SELECT 'grid_' || n AS template, i AS pos, n, ceil(sqrt(n)) AS c, ceil(n / ceil(sqrt(n))) AS r
  FROM (SELECT DISTINCT count(*) AS n FROM lineitem GROUP BY l_orderkey), LATERAL (SELECT unnest(range(0, n)) AS i)
), templates AS (
  SELECT template, pos, 0.12 + (pos % c) * (11.76 / c) AS x, 0.12 + floor(pos / c) * (11.76 / r) AS y,
    11.76 / c - 0.05 AS w, 11.76 / r - 0.05 AS h FROM tpl
), cells AS (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS cell, l.*
  FROM lineitem l
), placements AS (
  SELECT page // 2 AS spread, CASE WHEN page % 2 = 0 THEN 'left' ELSE 'right' END AS side,
    (page // 2) * 2 + CASE WHEN page % 2 = 0 THEN 1 ELSE 2 END AS page_number, o.o_orderpriority AS chapter,
    'grid_' || count(*) OVER (PARTITION BY page) AS template, cell, l_partkey::VARCHAR AS asset_id,
    CASE WHEN l_returnflag = 'R' THEN 1 - l_discount * 5 END AS crop_w, CASE WHEN l_returnflag = 'R' THEN 1 - l_tax * 5 END AS crop_h,
    CASE WHEN l_tax > 0.06 THEN 'agreed' WHEN l_tax > 0.03 THEN (l_quantity * 4)::INTEGER::VARCHAR END AS override_dpi,
    CASE WHEN l_returnflag = 'R' THEN 'cover' ELSE 'contain' END AS fit, l_linestatus = 'F' AS intentional_hero,
    CASE WHEN l_linestatus = 'O' THEN '  ' ELSE 'cap ' || l_suppkey END AS caption
  FROM cells JOIN orders o ON o.o_orderkey = page
), parts AS (
  SELECT p_partkey::VARCHAR AS asset_id, 200 + p_size * 60 AS px_w, 300 + p_partkey % 50 * 70 AS px_h,
    p_size % 3 > 0 AS date_trusted, CASE WHEN p_size % 7 > 0 THEN strftime(DATE '1995-01-01' + (p_partkey * 13 % 2500)::INTEGER, '%Y-%m-%d') ELSE '' END AS day
  FROM part
), ratio AS (SELECT *, px_w / greatest(1, px_h) AS ar FROM parts),
fitted AS (
  SELECT p.*, t.x, t.y, t.w, t.h, px_w, px_h, date_trusted, day,
    least(px_w / (CASE WHEN ar >= t.w / t.h THEN t.w ELSE t.h * ar END), px_h / (CASE WHEN ar >= t.w / t.h THEN t.w / ar ELSE t.h END)) AS whole_dpi
  FROM placements p JOIN templates t ON t.template = p.template AND t.pos = p.cell JOIN ratio r USING (asset_id)
), measured AS (
  SELECT *, CASE WHEN crop_w IS NOT NULL THEN least(px_w * CASE WHEN crop_w = 0 THEN 1 ELSE crop_w END / w, px_h * CASE WHEN crop_h = 0 THEN 1 ELSE crop_h END / h) ELSE whole_dpi END AS dpi
  FROM fitted
), open_cells AS (
  SELECT * FROM measured WHERE dpi + 0.1 < 240 AND NOT coalesce(override_dpi IS NOT NULL AND coalesce(try_cast(override_dpi AS DOUBLE), 1) <> 0
    AND (try_cast(override_dpi AS DOUBLE) IS NULL OR try_cast(override_dpi AS DOUBLE) <= dpi + 0.5), false)
)"""


def placements(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    page = Window.partitionBy("l_orderkey")  # an order holds a handful of lines
    cell = F.row_number().over(page.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1
    rows = lines.withColumns({"cell": cell, "_n": F.count("*").over(page)}).join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("chapter")), "l_orderkey"
    )
    on_left = F.col("l_orderkey") % 2 == 0
    cropped = F.col("l_returnflag") == "R"
    spread = F.floor(F.col("l_orderkey") / 2)
    return rows.select(
        spread.alias("spread"),
        F.when(on_left, "left").otherwise("right").alias("side"),
        (spread * 2 + F.when(on_left, 1).otherwise(2)).alias("page_number"),
        "chapter",
        F.concat(F.lit("grid_"), F.col("_n").cast("string")).alias("template"),
        "cell",
        F.col("l_partkey").cast("string").alias("asset_id"),
        F.when(cropped, 1 - F.col("l_discount") * 5).alias("crop_w"),
        F.when(cropped, 1 - F.col("l_tax") * 5).alias("crop_h"),
        F.when(F.col("l_tax") > 0.06, "agreed")
        .when(F.col("l_tax") > 0.03, (F.col("l_quantity") * 4).cast("int").cast("string")).alias("override_dpi"),
        F.when(cropped, "cover").otherwise("contain").alias("fit"),
        (F.col("l_linestatus") == "F").alias("intentional_hero"),
        F.when(F.col("l_linestatus") == "O", "  ").otherwise(F.concat(F.lit("cap "), F.col("l_suppkey").cast("string"))).alias("caption"),
    )


def templates(spark, sf_dir):
    """A grid for every number of cells that a page has: one row per cell of each."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("n").distinct()
    across = F.ceil(F.sqrt("n"))
    down = F.ceil(F.col("n") / across)
    at = F.col("pos")
    return counts.select("n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("pos")).select(
        F.concat(F.lit("grid_"), F.col("n").cast("string")).alias("template"), "pos",
        (F.lit(0.12) + (at % across) * (F.lit(11.76) / across)).alias("x"),
        (F.lit(0.12) + F.floor(at / across) * (F.lit(11.76) / down)).alias("y"),
        (F.lit(11.76) / across - 0.05).alias("w"), (F.lit(11.76) / down - 0.05).alias("h"),
    )


def parts(spark, sf_dir):
    """Parts as assets."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("asset_id"),
        (F.lit(200) + F.col("p_size") * 60).alias("px_w"),
        (F.lit(300) + key % 50 * 70).alias("px_h"),
        (F.col("p_size") % 3 > 0).alias("date_trusted"),
        F.when(F.col("p_size") % 7 > 0, F.date_add(F.lit("1995-01-01").cast("date"), (key * 13 % 2500).cast("int")).cast("string"))
        .otherwise("").alias("day"),
    )


def measured(spark, sf_dir):
    return placement.with_geometry(placements(spark, sf_dir), templates(spark, sf_dir), parts(spark, sf_dir))


@query("j7_placement_geometry", BOOK_CTE + """
SELECT page_number, cell, asset_id, round(x, 4) AS x, round(y, 4) AS y, round(w + 1e-9, 4) AS w, round(h + 1e-9, 4) AS h, px_w::BIGINT AS px_w, px_h::BIGINT AS px_h FROM measured""")
def j7_placement_geometry(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "page_number", F.col("cell").cast("bigint").alias("cell"), "asset_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.round(F.col("w") + 1e-9, 4).alias("w"), F.round(F.col("h") + 1e-9, 4).alias("h"),
        F.col("px_w").cast("bigint").alias("px_w"), "px_h",
    )


@query("p15_effective_dpi", BOOK_CTE + " SELECT page_number, cell, asset_id, round(dpi + 1e-9, 5) AS dpi FROM measured")
def p15_effective_dpi(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "page_number", F.col("cell").cast("bigint").alias("cell"), "asset_id", F.round(F.col("dpi") + 1e-9, 5).alias("dpi")
    )


@query("p16_override_ok", BOOK_CTE + """
SELECT page_number, cell, coalesce(override_dpi IS NOT NULL AND (try_cast(override_dpi AS DOUBLE) IS NULL
  OR (try_cast(override_dpi AS DOUBLE) <> 0 AND try_cast(override_dpi AS DOUBLE) <= dpi + 0.5)), false) AS covered FROM measured""")
def p16_override_ok(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "page_number", F.col("cell").cast("bigint").alias("cell"), geometry.override_ok(F.col("override_dpi"), F.col("dpi")).alias("covered")
    )


@query("p28_shrink_to_dpi", BOOK_CTE + """, f AS (
  SELECT *, least(px_w / w, px_h / h) AS cd, CASE WHEN least(px_w / w, px_h / h) <= 0 OR least(px_w / w, px_h / h) >= 240 THEN 1.0
    ELSE greatest(0.1, least(px_w / w, px_h / h) / 240) END AS f FROM measured)
SELECT page_number, cell, round(w * f + 1e-9, 4) AS w, round(h * f + 1e-9, 4) AS h, f < 1 AS shrunk FROM f""")
def p28_shrink_to_dpi(spark, sf_dir):
    c = F.col
    small = geometry.shrink_to_dpi(c("x"), c("y"), c("w"), c("h"), c("px_w"), c("px_h"))
    return measured(spark, sf_dir).select("page_number", c("cell").cast("bigint").alias("cell"), small.alias("b"), c("w").alias("w0")).select(
        "page_number", "cell", F.round(c("b.w") + 1e-9, 4).alias("w"), F.round(c("b.h") + 1e-9, 4).alias("h"),
        (c("b.w") < c("w0") - 1e-3).alias("shrunk"),
    )


@query("a11_print_ready", BOOK_CTE + " SELECT count(*) = 0 AS print_ready, count(*) AS low_cells FROM open_cells")
def a11_print_ready(spark, sf_dir):
    return placement.print_ready(measured(spark, sf_dir))


@query("a11_low_dpi_cells", BOOK_CTE + " SELECT page_number, cell, asset_id, round(dpi + 1e-9, 1) AS dpi FROM open_cells")
def a11_low_dpi_cells(spark, sf_dir):
    return placement.low_dpi(measured(spark, sf_dir)).select(
        "page_number", F.col("cell").cast("bigint").alias("cell"), "asset_id", F.round(F.col("dpi") + 1e-9, 1).alias("dpi")
    )


@query("v4_export_gate", BOOK_CTE + """
SELECT page_number, count(*) AS open_cells FROM open_cells GROUP BY 1""")
def v4_export_gate(spark, sf_dir):
    # What the gate refuses, per page; the raising form is tested on fixtures.
    return placement.low_dpi(measured(spark, sf_dir)).groupBy("page_number").agg(F.count("*").alias("open_cells"))


COVER_CTE = BOOK_CTE + """, cover AS (
  SELECT spread, side, coalesce(sum(w * h), 0) / 144 AS coverage FROM placements p LEFT JOIN templates t ON t.template = p.template AND t.pos = p.cell GROUP BY ALL)"""


@query("a10_page_coverage", COVER_CTE + " SELECT spread, side, round(coverage + 1e-9, 6) AS coverage FROM cover")
def a10_page_coverage(spark, sf_dir):
    return placement.page_coverage(placements(spark, sf_dir), templates(spark, sf_dir)).select(
        "spread", "side", F.round(F.col("coverage") + 1e-9, 6).alias("coverage")
    )


@query("a10_dpi_distribution", BOOK_CTE + """, p AS (SELECT round(dpi + 1e-9, 6) AS d FROM measured WHERE dpi > 0),
o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM p)
SELECT max(n) AS n, min(d) AS lowest, max(d) FILTER (r = n // 10) AS p10,
  round((max(d) FILTER (r = (n - 1) // 2) + max(d) FILTER (r = n // 2)) / 2, 6) AS median, max(d) AS highest FROM o""")
def a10_dpi_distribution(spark, sf_dir):
    rounded = measured(spark, sf_dir).select(F.round(F.col("dpi") + 1e-9, 6).alias("dpi"))
    return placement.distribution(rounded, "dpi").withColumn("median", F.round("median", 6))


@query("a10_dpi_counts", BOOK_CTE + """
SELECT count(*) AS cells, count(*) FILTER (dpi < 110) AS below_soft, count(*) FILTER (dpi < 240) AS below_floor FROM measured""")
def a10_dpi_counts(spark, sf_dir):
    return placement.dpi_counts(measured(spark, sf_dir))


@query("a12_needed_pixels", BOOK_CTE + """
SELECT asset_id, round(max(300 * greatest(w / coalesce(crop_w, 1), h / coalesce(crop_h, 1))) + 1e-9, 5) AS needed FROM measured
WHERE least(coalesce(crop_w, 1) * px_w / w, coalesce(crop_h, 1) * px_h / h) < 258 GROUP BY asset_id""")
def a12_needed_pixels(spark, sf_dir):
    return placement.needed_pixels(measured(spark, sf_dir)).select("asset_id", F.round(F.col("needed") + 1e-9, 5).alias("needed"))


@query("a8_duplicates", BOOK_CTE + " SELECT asset_id, count(*) AS n_uses FROM placements GROUP BY 1 HAVING count(*) > 1")
def a8_duplicates(spark, sf_dir):
    from gleaner.operators import catalog

    return catalog.duplicates(placements(spark, sf_dir))


@query("a16_template_usage", BOOK_CTE + """
SELECT template, count(*) AS pages, count(*) > 1 AS shared FROM (SELECT DISTINCT template, spread, side FROM placements) GROUP BY 1""")
def a16_template_usage(spark, sf_dir):
    return placement.template_usage(placements(spark, sf_dir))


@query("w13_movers", COVER_CTE + """, after AS (
  SELECT spread, side, coalesce(sum(w * h), 0) / 144 AS coverage FROM placements p LEFT JOIN templates t ON t.template = p.template AND t.pos = p.cell
  WHERE fit = 'contain' GROUP BY ALL), g AS (
  SELECT spread, round(sum(a.coverage - c.coverage) + 1e-9, 6) AS gain FROM cover c JOIN after a USING (spread, side) GROUP BY spread)
SELECT spread, gain FROM g ORDER BY gain DESC, spread LIMIT 6""")
def w13_movers(spark, sf_dir):
    rows, grid = placements(spark, sf_dir), templates(spark, sf_dir)
    before = placement.page_coverage(rows, grid)
    after = placement.page_coverage(rows.where("fit = 'contain'"), grid)
    gains = before.join(after.withColumnRenamed("coverage", "after"), ["spread", "side"])
    # Rounded before the ranking, so both engines break ties alike.
    gains = gains.withColumns({"coverage": F.round("coverage", 9), "after": F.round("after", 9)})
    top = placement.movers(gains.drop("after"), gains.select("spread", "side", F.col("after").alias("coverage")), shown=6)
    return top.select("spread", F.round(F.col("gain") + 1e-9, 6).alias("gain"))


CHECKS_SQL = BOOK_CTE + """, win(chapter, ws, we) AS (VALUES ('1-URGENT', '1995-06-01', '1998-12-31'), ('2-HIGH', '1996-01-01', '1999-12-31'), ('5-LOW', '1997-01-01', '2001-12-31')),
pages AS (SELECT spread, side, page_number, template, count(*) AS n_assets, bool_or(intentional_hero) AS hero,
  substr(template, 6)::INTEGER AS n_cells FROM placements GROUP BY ALL),
checks AS (
  SELECT 'sparse' AS "check", spread, page_number, NULL::BIGINT AS cell, NULL AS asset_id, NULL AS detail FROM pages WHERE n_assets = 1 AND NOT hero
  UNION ALL SELECT 'cell_count', spread, page_number, NULL, NULL, n_cells || '/' || n_assets FROM pages WHERE n_cells <> n_assets
  UNION ALL SELECT 'implicit_crop', spread, page_number, cell, asset_id, fit FROM measured WHERE fit <> 'contain'
  UNION ALL SELECT 'low_dpi', spread, page_number, cell, asset_id, printf('%.1f', round(whole_dpi + 1e-9, 1)) FROM measured WHERE whole_dpi + 0.1 < 240
  UNION ALL SELECT 'era_outlier', spread, page_number, cell, asset_id, day FROM measured JOIN win USING (chapter) WHERE date_trusted AND day <> '' AND (day < ws OR day > we)
  UNION ALL SELECT 'duplicate', NULL, NULL, NULL, asset_id, NULL FROM measured GROUP BY asset_id HAVING count(*) > 1
  UNION ALL SELECT 'invalid_pair', spread, NULL, NULL, NULL, NULL FROM pages GROUP BY spread HAVING count(*) FILTER (n_cells > 5) = 2
)"""


def checks(spark, sf_dir):
    windows = dimension(spark, list(CHAPTER_WINDOWS), "chapter string, window_start string, window_end string")
    return placement.book_checks(placements(spark, sf_dir), templates(spark, sf_dir), parts(spark, sf_dir), windows)


@query("v2_book_checks", CHECKS_SQL + """
SELECT "check", coalesce(spread, -1) AS spread, coalesce(page_number, -1) AS page_number, coalesce(cell, -1) AS cell, asset_id, detail FROM checks""")
def v2_book_checks(spark, sf_dir):
    missing = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return checks(spark, sf_dir).select("check", missing("spread"), missing("page_number"), missing("cell"), "asset_id", "detail")


@query("v2_check_counts", CHECKS_SQL + """
SELECT "check", count(*) AS n, "check" NOT IN ('low_dpi', 'era_outlier') AS fatal FROM checks GROUP BY 1""")
def v2_check_counts(spark, sf_dir):
    return placement.check_counts(checks(spark, sf_dir))


@query("j11_era_outlier", CHECKS_SQL + """
SELECT page_number, cell, asset_id, detail AS day FROM checks WHERE "check" = 'era_outlier'""")
def j11_era_outlier(spark, sf_dir):
    return checks(spark, sf_dir).where("check = 'era_outlier'").select("page_number", "cell", "asset_id", F.col("detail").alias("day"))


@query("j14_left_facing_pair", BOOK_CTE + """, pg AS (SELECT DISTINCT spread, side, template, substr(template, 6)::INTEGER AS n FROM placements)
SELECT spread, l.template AS left_template, r.template AS right_template, NOT (l.n > 5 AND r.n > 5) AS valid
FROM pg l JOIN pg r USING (spread) WHERE l.side = 'left' AND r.side = 'right'""")
def j14_left_facing_pair(spark, sf_dir):
    return placement.facing_pairs(placements(spark, sf_dir), templates(spark, sf_dir)).select(
        "spread", "left_template", "right_template", "valid"
    )


@query("p27_imposed_pages", BOOK_CTE + """, pg AS (SELECT DISTINCT spread, side FROM placements), im AS (
  SELECT spread * 2 + CASE side WHEN 'left' THEN 2 ELSE 3 END AS page_no, spread, side FROM pg
  UNION ALL SELECT 1, -1, 'front' UNION ALL SELECT max(spread) * 2 + 4, -1, 'back' FROM pg)
SELECT *, page_no % 2 = 1 AS recto, floor((page_no - 2) / 2)::BIGINT AS spread_of FROM im""")
def p27_imposed_pages(spark, sf_dir):
    pages = placements(spark, sf_dir).select("spread", "side").distinct()
    return placement.imposed_pages(pages).withColumn("spread_of", geometry.spread_of_page(F.col("page_no")))


@query("o11_carry_captions", BOOK_CTE + """, c AS (
  SELECT asset_id, arg_max(caption, page_number * 100 + cell) AS caption FROM placements WHERE trim(caption) <> '' GROUP BY 1)
SELECT DISTINCT p.chapter, p.asset_id, c.caption FROM placements p LEFT JOIN c USING (asset_id) WHERE fit = 'contain'""")
def o11_carry_captions(spark, sf_dir):
    old = placements(spark, sf_dir)
    new = old.where("fit = 'contain'").select("chapter", "asset_id").distinct()
    return placement.carry_captions(old, new)


@query("a13_book_summary", BOOK_CTE + """, t AS (SELECT count(DISTINCT spread) AS s, count(DISTINCT chapter) AS c, count(asset_id) AS p FROM placements)
SELECT s AS spreads, s * 2 AS pages, c AS chapters, p AS placed, (SELECT count(*) FROM parts) - p AS unplaced,
  round_even(p / greatest(1, s * 2), 1) AS per_page, s * 2 <= 122 AS within_limit FROM t""")
def a13_book_summary(spark, sf_dir):
    return placement.book_summary(placements(spark, sf_dir), parts(spark, sf_dir).agg(F.count("*").alias("n")))


# --- book documents ---------------------------------------------------------------------------


def raw_documents(spark, sf_dir):
    """Spread documents with all accepted cell forms: null, id text, object with and without extras."""
    # One shuffle of the plain rows serves the pages, their spread and what groups by spread again.
    rows = placements(spark, sf_dir).withColumn("cell", F.col("cell").cast("int")).repartition("spread")
    crop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("crop_w").alias("w"), F.when(F.col("crop_h") >= 0.7, F.col("crop_h")).alias("h"))
    obj = F.to_json(
        F.struct(
            "asset_id", F.when(F.col("fit") == "cover", crop).alias("crop"),
            F.when(F.col("override_dpi").isNotNull(), F.struct(F.col("override_dpi").alias("dpi"))).alias("dpi_override"),
            "caption",
        )
    )
    text = F.when((F.col("cell") == 2) & (F.col("fit") == "contain"), F.concat(F.lit('"'), "asset_id", F.lit('"'))).when(
        F.col("cell") == 5, "null"
    ).otherwise(obj)
    entry = F.struct("cell", text.alias("j"), F.concat(F.lit('"'), "fit", F.lit('"')).alias("f"))
    page = rows.groupBy("spread", "side", "template").agg(
        F.min("chapter").alias("chapter"), F.max("intentional_hero").alias("hero"), F.array_sort(F.collect_list(entry)).alias("e")
    ).select(
        "spread", "side", "chapter",
        F.concat(
            F.lit('{"template":"'), "template", F.lit('","intentional_hero":'), F.col("hero").cast("string"),
            F.lit(',"cells":['), F.array_join("e.j", ","), F.lit('],"fits":['), F.array_join("e.f", ","), F.lit("]}"),
        ).alias("p"),
    )
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("p"))), F.lit("null"))
    return page.groupBy("spread").agg(
        F.concat(
            F.lit('{"chapter":"'), F.min("chapter"), F.lit('","left":'), side("left"), F.lit(',"right":'), side("right"), F.lit("}")
        ).alias("value")
    )


FLAT_CTE = BOOK_CTE + """, flat AS (
  SELECT spread, side, page_number, template, cell, CASE WHEN cell = 5 AND NOT (cell = 2 AND fit = 'contain') THEN NULL ELSE asset_id END AS asset_id, fit,
    CASE WHEN cell = 5 OR (cell = 2 AND fit = 'contain') THEN NULL WHEN fit = 'cover' AND crop_h >= 0.7 THEN round(crop_w, 6) END AS crop_w,
    CASE WHEN cell = 5 OR (cell = 2 AND fit = 'contain') THEN NULL WHEN override_dpi <> '0' THEN override_dpi END AS override_dpi,
    CASE WHEN cell = 5 OR (cell = 2 AND fit = 'contain') OR trim(caption) = '' THEN NULL ELSE caption END AS caption
  FROM placements)"""


def _flat(rows, *more):
    return rows.select(
        "spread", "side", "page_number", "template", F.col("cell").cast("bigint").alias("cell"), "asset_id", "fit",
        F.round("crop.w", 6).alias("crop_w"), F.col("dpi_override.dpi").alias("override_dpi"), "caption", *more,
    )


@query("s8_flatten_book", FLAT_CTE + " SELECT spread, side, page_number, template, cell, asset_id, fit FROM flat")
def s8_flatten_book(spark, sf_dir):
    rows = book.flatten_book(book.parse_spreads(raw_documents(spark, sf_dir)))
    return _flat(rows).select("spread", "side", "page_number", "template", "cell", "asset_id", "fit")


@query("s9_normalize_cell", FLAT_CTE + " SELECT page_number, cell, asset_id, crop_w, override_dpi, caption FROM flat")
def s9_normalize_cell(spark, sf_dir):
    rows = book.flatten_book(book.parse_spreads(raw_documents(spark, sf_dir)))
    return _flat(rows).select("page_number", "cell", "asset_id", "crop_w", "override_dpi", "caption")


@query("s10_migrate_book", FLAT_CTE + """
SELECT spread, side, page_number, template, cell, asset_id, fit, crop_w, override_dpi, caption,
  sha1(concat_ws('/', spread, side, cell)) AS cell_id FROM flat""")
def s10_migrate_book(spark, sf_dir):
    rows = book.flatten_book(book.parse_spreads(book.migrate_book(raw_documents(spark, sf_dir))))
    made = F.sha1(F.concat_ws("/", "spread", "side", "cell").cast("binary"))
    return _flat(rows.where(F.col("cell_id") == made), "cell_id").select(
        "spread", "side", "cell", "page_number", "template", "asset_id", "fit", "crop_w", "override_dpi", "caption", "cell_id"
    )
