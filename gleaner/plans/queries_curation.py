"""Quality gate, chapters, scores and shortlist."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import dates, flags, text
from gleaner.operators import chapters, quality, scoring
from gleaner.plans.assets import CHAPTERS, CONFIG, asset_view, signal_view, sql, table
from gleaner.plans.queries_neardup import PRIORITY_CTE, priority_dim
from gleaner.plans.registry import query
from gleaner.session import checkpoint_dir

LIMITS_CTE = """, joined AS (SELECT a.*, f.hi, f.lo, f.blur_var, f.level, f.blown, f.edge, f.saturation FROM assets a JOIN fp f USING (asset_id)),
limits AS (
  SELECT src, count(blur_var) AS samples,
    CASE WHEN count(blur_var) >= 8 THEN quantile_cont(blur_var, 0.15) ELSE 0.0 END AS threshold
  FROM joined GROUP BY src
)"""
DEVICE = """(abs(greatest(w, h) / least(w, h) - 16.0/9) / (16.0/9) < 0.06
    OR abs(greatest(w, h) / least(w, h) - 19.5/9) / (19.5/9) < 0.06
    OR abs(greatest(w, h) / least(w, h) - 4.0/3) / (4.0/3) < 0.06)"""
NAME = "regexp_extract(orig_path, '([^/]*)$', 1)"
GATE_CTE = LIMITS_CTE + f""", tested AS (
  SELECT asset_id, src, blur_var IS NOT NULL AS ok,
    lower({NAME}) LIKE 'screenshot%' OR ({DEVICE} AND lower({NAME}) LIKE '%.png') AS shot,
    edge >= 0.12 AND saturation <= 0.20 AS doc, blur_var < threshold AS blurry,
    level < 25 AS dark, blown > 0.35 AS blown
  FROM joined JOIN limits USING (src) WHERE quality_pass IS NULL
), gated AS (
  SELECT asset_id, src, ok AND shot AS is_screenshot, ok AND doc AS is_document,
    ok AND coalesce(blurry, false) AS is_blurry, ok AND dark AS is_dark, ok AND blown AS is_blown FROM tested
), passed AS (
  SELECT g.*, ok AND NOT (is_screenshot OR is_document OR is_blurry OR is_dark OR is_blown) AS quality_pass
  FROM gated g JOIN tested USING (asset_id)
)"""


@query("a2_source_percentile", sql(LIMITS_CTE + """
SELECT src, samples, round(threshold, 6) AS threshold FROM limits""", signals=True))
def a2_source_percentile(spark, sf_dir):
    q = CONFIG.quality
    found = quality.group_percentile(
        signal_view(spark, sf_dir), "src", "blur_var", q.blur_percentile, q.min_samples
    )
    return found.select("src", "samples", F.round("threshold", 6).alias("threshold"))


@query("a2_price_percentile", """
SELECT l_returnflag, count(l_extendedprice) AS samples, round(quantile_cont(l_extendedprice, 0.15), 6) AS threshold
FROM lineitem GROUP BY l_returnflag""")
def a2_price_percentile(spark, sf_dir):
    found = quality.group_percentile(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 15, 8)
    return found.select("l_returnflag", "samples", F.round("threshold", 6).alias("threshold"))


@query("a2_kept_sketches", """
SELECT l_linenumber, count(l_extendedprice) AS samples, round(quantile_cont(l_extendedprice, 0.9), 6) AS threshold
FROM lineitem GROUP BY l_linenumber""")
def a2_kept_sketches(spark, sf_dir):
    """The lines arrive by year of shipping; each run sketches its own rows, the percentile merges what all runs kept."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice", F.year("l_shipdate").alias("y"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    first, last = lines.agg(F.min("y"), F.max("y")).first()
    for year in range(first or 0, (last or 0) + 1):
        quality.keep_sketches(lines.where(F.col("y") == year), folder, str(year), "l_linenumber", "l_extendedprice")
    kept = quality.kept_sketches(spark, folder, "l_linenumber")
    found = quality.group_percentile(lines, "l_linenumber", "l_extendedprice", 90, 8, sketches=kept)
    return found.select("l_linenumber", "samples", F.round("threshold", 6).alias("threshold"))


def gated(spark, sf_dir):
    return quality.gate(signal_view(spark, sf_dir), CONFIG.quality)


@query("p10_quality_flags", sql(GATE_CTE + " SELECT * FROM passed", signals=True))
def p10_quality_flags(spark, sf_dir):
    return gated(spark, sf_dir)


@query("a13_quality_summary", sql(GATE_CTE + """
SELECT count(*) AS total, count(*) FILTER (quality_pass) AS passed, count(*) FILTER (is_screenshot) AS screenshots,
  count(*) FILTER (is_document) AS documents, count(*) FILTER (is_blurry) AS blurry,
  count(*) FILTER (is_dark OR is_blown) AS dark_or_blown FROM passed""", signals=True))
def a13_quality_summary(spark, sf_dir):
    return quality.gate_summary(gated(spark, sf_dir))


@query("p11_device_aspect", sql(f"SELECT asset_id, {DEVICE} AS device FROM assets"))
def p11_device_aspect(spark, sf_dir):
    return asset_view(spark, sf_dir).select(
        "asset_id", flags.device_aspect(F.col("w"), F.col("h"), CONFIG.quality.screenshot_ratios).alias("device")
    )


@query("f6_only_missing", sql("SELECT asset_id FROM assets WHERE quality_pass IS NULL"))
def f6_only_missing(spark, sf_dir):
    return asset_view(spark, sf_dir).where("quality_pass IS NULL").select("asset_id")


# --- chapters ---------------------------------------------------------------------------------

CLAMP = """CASE WHEN left(best_datetime, 10) < '2024-01-03' THEN 'low'
  WHEN left(best_datetime, 10) > '2024-01-28' THEN 'high' END"""


@query("j5_chapter_lookup", sql(f"SELECT asset_id, chapter, {CLAMP} AS clamped FROM assets"))
def j5_chapter_lookup(spark, sf_dir):
    rows = asset_view(spark, sf_dir).drop("chapter")
    return chapters.assign(rows, CHAPTERS).select("asset_id", "chapter", "clamped")


@query("a1_chapter_counts", sql(f""", dim(chapter) AS (VALUES ('01_early'), ('02_travel'), ('03_home'), ('04_family'))
SELECT d.chapter, count(a.asset_id) AS n, count(*) FILTER ({CLAMP} = 'low') AS clamped_low,
  count(*) FILTER ({CLAMP} = 'high') AS clamped_high
FROM dim d LEFT JOIN assets a USING (chapter) GROUP BY d.chapter"""))
def a1_chapter_counts(spark, sf_dir):
    rows = chapters.assign(asset_view(spark, sf_dir).drop("chapter"), CHAPTERS)
    return chapters.assignment_counts(rows, chapters.chapter_dim(spark, CHAPTERS))


MONTHS_CTE = """WITH dim AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS chapter, min(o_orderdate)::DATE AS s,
    max(o_orderdate)::DATE + ((count(*) % 3)::INTEGER - 1) AS e
  FROM orders GROUP BY 1
)"""


@query("v1_chapter_contiguity", MONTHS_CTE + """, seen AS (SELECT *, lag(e) OVER (ORDER BY s) AS prev FROM dim)
SELECT chapter, 'reversed' AS problem, strftime(prev + 1, '%Y-%m-%d') AS expected_start FROM seen WHERE e < s
UNION ALL
SELECT chapter, CASE WHEN s <= prev THEN 'overlap' ELSE 'gap' END, strftime(prev + 1, '%Y-%m-%d') FROM seen WHERE s <> prev + 1""")
def v1_chapter_contiguity(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    dim = (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("chapter"))
        .agg(F.min(day).alias("start"), F.max(day).alias("last"), F.count("*").alias("n"))
        .select("chapter", "start", F.date_add("last", (F.col("n") % 3 - 1).cast("int")).alias("end"))
    )
    return chapters.contiguity_problems(dim).withColumn("expected_start", F.col("expected_start").cast("string"))


# --- scores -----------------------------------------------------------------------------------

ELIGIBLE_CTE = PRIORITY_CTE + """, pool AS (
  SELECT a.*, f.hi, f.lo, f.blur_var, f.hi IS NOT NULL AS hashed, coalesce(left(a.best_datetime, 10), 'nodate') AS day
  FROM assets a JOIN fp f USING (asset_id)
  WHERE is_dup_keep AND (review_status IS NULL OR review_status = 'pending')
), bounds AS (SELECT chapter, min(blur_var) AS low, max(blur_var) AS high FROM pool GROUP BY chapter)"""
SCORED_CTE = ELIGIBLE_CTE + """, peers AS (
  SELECT chapter, hi, lo FROM pool WHERE hashed
  QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY doc_id, asset_id) <= 20
), div AS (
  SELECT p.asset_id, coalesce(avg(bit_count(xor(p.hi, q.hi)) + bit_count(xor(p.lo, q.lo)))
    FILTER (p.hi <> q.hi OR p.lo <> q.lo), 0) / 64.0 AS diversity
  FROM pool p LEFT JOIN peers q USING (chapter) GROUP BY p.asset_id
), parts AS (
  SELECT p.*, d.diversity, greatest(0, least(1, CASE WHEN blur_var IS NULL OR high <= low THEN 0.5
      ELSE (blur_var - low) / (high - low) END)) AS q0, coalesce(pr.priority, 0) AS priority
  FROM pool p JOIN div d USING (asset_id) JOIN bounds USING (chapter) LEFT JOIN prio pr USING (src)
), scored AS (
  SELECT asset_id, chapter, day, hi, lo, diversity,
    (CASE WHEN quality_pass THEN 0.5 + 0.5 * q0 ELSE q0 END) * 1.0
    + (CASE WHEN priority >= 100 THEN 1.0 ELSE 0 END + CASE WHEN day IN ('2024-01-05', '2024-01-15') THEN 1.0 ELSE 0 END) * 2.0
    + CASE WHEN favorited THEN 3.0 ELSE 0 END + CASE WHEN people_count >= 2 THEN 1.0 ELSE 0 END
    - (is_screenshot::INTEGER + is_document::INTEGER) * 3.0 + diversity AS score
  FROM parts
)"""


def pool(spark, sf_dir):
    rows = signal_view(spark, sf_dir).drop("score").withColumn("arrival", F.col("doc_id"))
    return scoring.eligible(rows)


def scored(spark, sf_dir):
    return scoring.score(pool(spark, sf_dir), CONFIG.score, priority_dim(spark))


@query("f2_eligible", sql("""SELECT asset_id FROM assets
WHERE is_dup_keep AND (review_status IS NULL OR review_status = 'pending')"""))
def f2_eligible(spark, sf_dir):
    return scoring.eligible(asset_view(spark, sf_dir)).select("asset_id")


@query("a3_chapter_bounds", sql(ELIGIBLE_CTE + """
SELECT chapter, round(low, 6) AS blur_low, round(high, 6) AS blur_high FROM bounds""", signals=True))
def a3_chapter_bounds(spark, sf_dir):
    b = scoring.chapter_bounds(pool(spark, sf_dir))
    return b.select("chapter", F.round("blur_low", 6).alias("blur_low"), F.round("blur_high", 6).alias("blur_high"))


@query("w5_peer_sample", sql(ELIGIBLE_CTE + """
SELECT chapter, asset_id, row_number() OVER (PARTITION BY chapter ORDER BY doc_id, asset_id) AS place
FROM pool WHERE hashed QUALIFY place <= 20""", signals=True))
def w5_peer_sample(spark, sf_dir):
    return scoring.peer_sample(pool(spark, sf_dir)).select("chapter", "asset_id", F.col("place").cast("bigint").alias("place"))


@query("a9_diversity", sql(SCORED_CTE + " SELECT asset_id, round(diversity * 64 + 1e-9, 6) AS mean_distance FROM scored", signals=True))
def a9_diversity(spark, sf_dir):
    return scoring.with_diversity(pool(spark, sf_dir)).select("asset_id", F.round(F.col("diversity") * 64 + 1e-9, 6).alias("mean_distance"))


@query("p21_score_components", sql(SCORED_CTE + " SELECT asset_id, chapter, round(score + 1e-9, 6) AS score FROM scored", signals=True))
def p21_score_components(spark, sf_dir):
    return scored(spark, sf_dir).select("asset_id", "chapter", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("w6_diversified_topk", sql(SCORED_CTE + """, caps(chapter, cap) AS (
  VALUES ('01_early', 62), ('02_travel', 125), ('03_home', 125), ('04_family', 125)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY round(score + 1e-9, 6) DESC, asset_id) AS rk FROM scored
), walk AS (
  SELECT chapter, cap, 0::BIGINT AS rk, []::STRUCT(id VARCHAR, day VARCHAR, hi BIGINT, lo BIGINT)[] AS picks FROM caps
  UNION ALL
  SELECT w.chapter, w.cap, w.rk + 1, CASE
    WHEN length(w.picks) >= w.cap
      OR length(list_filter(w.picks, lambda p: p.day = r.day)) >= 3
      OR length(list_filter(w.picks, lambda p: bit_count(xor(p.hi, r.hi)) + bit_count(xor(p.lo, r.lo)) <= 6)) > 0
    THEN w.picks ELSE list_append(w.picks, {'id': r.asset_id, 'day': r.day, 'hi': r.hi, 'lo': r.lo}) END
  FROM walk w JOIN ranked r ON r.chapter = w.chapter AND r.rk = w.rk + 1
), final AS (SELECT chapter, unnest(picks) AS p, generate_subscripts(picks, 1) AS pick_no FROM walk
  QUALIFY rk = max(rk) OVER (PARTITION BY chapter))
SELECT chapter, p.id AS asset_id, pick_no FROM final""", signals=True, recursive=True))
def w6_diversified_topk(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("score", F.round(F.col("score") + 1e-9, 6))
    caps = scoring.shortlist_caps(spark, [c.id for c in CHAPTERS], CONFIG.targets, CONFIG.score)
    return scoring.shortlist(rows, caps, 125, CONFIG.score).select("chapter", "asset_id", "pick_no")


# --- dates and small functions over the view --------------------------------------------------


@query("p12_date_trust", sql("""SELECT asset_id, CASE WHEN date_source = 'filename_seq' THEN 'synthetic'
  WHEN date_source = 'mtime' THEN 'fallback' WHEN date_source IN ('exif', 'sidecar', 'filename') THEN 'authoritative'
  WHEN date_confidence IN ('high', 'medium') THEN 'authoritative' ELSE 'fallback' END AS trust FROM assets"""))
def p12_date_trust(spark, sf_dir):
    return asset_view(spark, sf_dir).select(
        "asset_id", dates.date_trust(F.col("date_source"), F.col("date_confidence")).alias("trust")
    )


FILE_DATE = """coalesce(
  CASE WHEN regexp_matches(name, 'IMG-(\\d{4})(\\d{2})(\\d{2})-WA') THEN f(regexp_extract(name, 'IMG-(\\d{8})-WA', 1)) END,
  CASE WHEN regexp_matches(name, 'signal-(\\d{4})-(\\d{2})-(\\d{2})') THEN f(replace(regexp_extract(name, 'signal-(\\d{4}-\\d{2}-\\d{2})', 1), '-', '')) END,
  CASE WHEN regexp_matches(name, 'PXL_(\\d{8})') THEN f(regexp_extract(name, 'PXL_(\\d{8})', 1)) END,
  CASE WHEN regexp_matches(name, 'Screenshot_(\\d{8})') THEN f(regexp_extract(name, 'Screenshot_(\\d{8})', 1)) END,
  CASE WHEN regexp_matches(name, '20\\d{6}') THEN f(regexp_extract(name, '(20\\d{6})', 1)) END)"""


def _file_date_sql(name: str) -> str:
    import re

    def expand(m):
        digits = m.group(1)
        return (f"strftime(try_strptime({digits}, '%Y%m%d'), '%Y-%m-%dT12:00:00')")

    out, at = "", 0
    body = FILE_DATE.replace("name", name)
    # f(x) stands for the noon text of eight digits.
    while (start := body.find(" f(", at)) >= 0:
        depth, end = 0, start + 2
        while True:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            if depth == 0:
                break
            end += 1
        out += body[at : start + 1] + expand(re.match(r"(?s)(.*)", body[start + 3 : end]))
        at = end + 1
    return out + body[at:]


@query("p2_date_from_filename", sql(f"""SELECT asset_id, {_file_date_sql("n")} AS file_date
FROM (SELECT asset_id, {NAME} AS n FROM assets)"""))
def p2_date_from_filename(spark, sf_dir):
    return asset_view(spark, sf_dir).select(
        "asset_id", dates.date_from_filename(text.base_name(F.col("orig_path"))).alias("file_date")
    )


RESOLVE_BODY = f"""SELECT asset_id, CASE WHEN x IS NOT NULL THEN x WHEN sc IS NOT NULL THEN sc WHEN fd IS NOT NULL THEN fd
    WHEN mt IS NOT NULL THEN mt ELSE '1970-01-01T00:00:00+00:00' END AS best_datetime,
  CASE WHEN x IS NOT NULL THEN 'exif' WHEN sc IS NOT NULL THEN 'sidecar' WHEN fd IS NOT NULL THEN 'filename' ELSE 'mtime' END AS date_source,
  CASE WHEN x IS NOT NULL OR sc IS NOT NULL THEN 'high' WHEN fd IS NOT NULL THEN 'medium' ELSE 'low' END AS date_confidence
FROM (SELECT asset_id, {_file_date_sql("n")} AS fd, n,
    CASE WHEN date_source = 'exif' AND w % 5 > 0 THEN best_datetime END AS x,
    CASE WHEN date_source = 'sidecar' THEN best_datetime END AS sc,
    CASE WHEN date_source = 'mtime' THEN best_datetime END AS mt
  FROM (SELECT *, {NAME} AS n FROM assets))"""


def resolved(spark, sf_dir):
    rows = asset_view(spark, sf_dir)
    only = lambda s: F.when(F.col("date_source") == s, F.col("best_datetime"))
    # Some files carry the all-zero date that cameras without a clock write.
    exif = F.when(F.col("w") % 5 > 0, only("exif")).otherwise(
        F.when(F.col("date_source") == "exif", "0000-00-00T00:00:00")
    )
    best = dates.resolve_datetime(
        exif, F.lit(None).cast("string"), only("sidecar"), text.base_name(F.col("orig_path")), only("mtime")
    )
    return rows.select("asset_id", "orig_path", best.alias("r")).select("asset_id", "orig_path", "r.*")


@query("p1_resolve_datetime", sql(RESOLVE_BODY))
def p1_resolve_datetime(spark, sf_dir):
    return resolved(spark, sf_dir).drop("orig_path")


@query("p3_parse_event_date", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT12:00:00')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-15T12:00:00') WHEN 2 THEN strftime(o_orderdate, '%Y-07-01T12:00:00') END AS noon
FROM orders""")
def p3_parse_event_date(spark, sf_dir):
    form = lambda shape: F.date_format("o_orderdate", shape)
    kind = F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), form("yyyy-MM-dd"))).when(kind == 1, form("yyyy-MM"))
        .when(kind == 2, form("yyyy")).otherwise("some day")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_event_date(raw).alias("noon"))


@query("p5_day_month_keys", sql("""SELECT asset_id, coalesce(left(best_datetime, 10), 'nodate') AS day,
  left(best_datetime, 7) AS month, left(best_datetime, 4) AS year, coalesce(left(best_datetime, 10), '0000-00-00') AS prefix FROM assets"""))
def p5_day_month_keys(spark, sf_dir):
    when = F.col("best_datetime")
    return asset_view(spark, sf_dir).select(
        "asset_id", dates.day_key(when).alias("day"), dates.month_key(when).alias("month"),
        F.substring(when, 1, 4).alias("year"), dates.date_prefix(when).alias("prefix"),
    )
