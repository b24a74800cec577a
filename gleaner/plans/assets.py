"""The asset table as a view over the given tables, in Spark and in SQL.

One row per distinct document text (content key), with dates from events, review status from
labels and, on request, a fingerprint and signal metrics of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Chapter, ChapterStory, Config, DedupConfig, QualityConfig, ScoreConfig
from gleaner.functions import hashing
from gleaner.session import cut_lineage, spread_scan

CHAPTERS = (
    Chapter("01_early", "2024-01-03", "2024-01-09", "Early"),
    Chapter("02_travel", "2024-01-10", "2024-01-16", "Travel"),
    Chapter("03_home", "2024-01-17", "2024-01-23", "Home"),
    Chapter("04_family", "2024-01-24", "2024-01-28", "Family"),
)
PRIORITY = {"src0": 100, "src1": 80, "src2": 50, "src3": 50, "src4": 20}
CONFIG = Config(
    dedup=DedupConfig(),
    quality=QualityConfig(),
    score=ScoreConfig(milestone_dates=("2024-01-05", "2024-01-15")),
    chapters=CHAPTERS,
    targets={"01_early": 25},
    priority=PRIORITY,
    story={
        "02_travel": ChapterStory(
            event_aliases={"big trip": ("trip EN", "Trip-DE")},
            priority_events=("big trip",),
            priority_tags=("milestones",),
        ),
        "03_home": ChapterStory(source_order=("src3", "src1", "src2")),
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str, signals: bool = False) -> DataFrame:
    """Distinct texts, the first doc_id of each winning; signals are computed before the grouping,
    so the text itself is never shuffled."""
    docs = table(spark, sf_dir, "documents")
    if signals:
        docs = spread_scan(docs)
    narrow = docs.select(
        F.sha1(F.col("text").cast("binary")).alias("asset_id"),
        "doc_id", F.col("source").alias("src"), "lang", F.col("n_chars").alias("bytes"),
        *([hashing.token_profile(F.col("text")).alias("profile")] if signals else []),
    )
    if signals:
        level = F.transform("profile", lambda v: v * 255 / F.col("peak"))
        narrow = narrow.withColumn("peak", F.array_max("profile")).withColumn("level", level).select(
            "asset_id", "doc_id", "src", "lang", "bytes",
            hashing.fingerprint64(F.col("profile")).alias("phash"),
            hashing.second_difference_variance(F.col("profile")).alias("blur"),
            hashing.mean_level(F.col("level")).alias("level"),
            hashing.clipped_fraction(F.col("level"), 250).alias("blown"),
            hashing.edge_density(F.col("level"), 100).alias("edge"),
            (F.array_min("profile") / F.col("peak")).alias("saturation"),
        )
    rest = [c for c in narrow.columns if c not in ("asset_id", "doc_id")]
    return narrow.groupBy("asset_id").agg(F.min(F.struct("doc_id", *rest)).alias("r")).select(
        "asset_id", "r.*"
    )


def asset_view(spark: SparkSession, sf_dir: str, signals: bool = False) -> DataFrame:
    docs = documents(spark, sf_dir, signals)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    labels = table(spark, sf_dir, "labels")
    d = docs.withColumn("event_key", F.col("doc_id") * 11).join(
        events, F.col("event_key") == F.col("event_id"), "left"
    ).join(labels, "doc_id", "left")
    kind, ts, no = F.col("event_type"), F.col("ts"), F.col("doc_id").cast("string")
    noon = F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T12:00:00"))
    day = lambda shape: F.date_format(ts, shape)
    name = (
        F.when(kind == "click", F.concat(F.lit("IMG_"), F.lpad(F.floor(F.col("doc_id") / 20).cast("string"), 4, "0"), F.lit(".jpg")))
        .when(kind == "purchase", F.concat(F.lit("Market Day "), "lang", F.lit("-"), no, F.lit(".JPG")))
        .when(kind == "signup", F.concat(F.lit("PXL_"), day("yyyyMMdd"), F.lit("_"), no, F.lit(".jpg")))
        .when(kind == "view", F.concat(F.lit("signal-"), day("yyyy-MM-dd"), F.lit("-"), no, F.lit(".png")))
        .when(kind == "error", F.concat(F.lit("Screenshot_"), no, F.lit(".png")))
        .otherwise(F.concat(F.lit("notes_all_"), no, F.lit(".jpg")))
    )
    event = (
        F.when(kind == "view", F.concat(F.lit("Trip "), F.upper("lang")))
        .when(kind == "signup", F.concat(F.lit("trip_"), "lang"))
    )
    quality, toxic = F.col("quality"), F.col("toxic")
    return d.select(
        "asset_id", "doc_id", "src", "lang", "bytes",
        (F.lit(1000) + F.col("doc_id") * 37 % 3000).alias("w"),
        (F.lit(1000) + F.col("doc_id") * 53 % 3000).alias("h"),
        F.concat(F.lit("/library/"), "src", F.lit("/"), name).alias("orig_path"),
        F.when(kind.isin("click", "error"), iso(ts))
        .when(kind == "purchase", F.concat(iso(ts), F.lit("+00:00")))
        .when(kind.isin("signup", "view"), noon).alias("best_datetime"),
        F.when(kind == "click", "exif").when(kind == "purchase", "sidecar")
        .when(kind == "signup", "filename").when(kind == "view", "filename_seq")
        .when(kind == "error", "mtime").alias("date_source"),
        F.when(kind.isin("click", "purchase"), "high").when(kind.isin("signup", "view"), "medium")
        .otherwise("low").alias("date_confidence"),
        _chapter(ts).alias("chapter"),
        event.alias("event"),
        F.concat_ws(", ", "lang", F.when(quality == 1, "family"), F.when(toxic == 1, "milestones")).alias("tags"),
        F.when(toxic == 1, "  ").when((quality == 1) & (F.col("doc_id") % 5 == 0), F.concat(F.lit("About "), no)).alias("caption"),
        (F.col("doc_id") % 7 == 0).alias("favorited"),
        F.when(quality.isNotNull(), F.col("doc_id") % 4).alias("people_count"),
        F.when(quality == 1, "accept").when(quality == 0, "reject")
        .when(F.col("doc_id") % 2 == 0, "pending").alias("review_status"),
        ((quality == 1) & (F.col("doc_id") % 13 == 0)).alias("hero_flag"),
        F.concat(F.lit("B"), (F.col("doc_id") % 3).cast("string")).alias("ingest_batch"),
        (F.coalesce(toxic, F.lit(0)) == 0).alias("is_dup_keep"),
        kind.eqNullSafe("error").alias("is_screenshot"),
        (F.col("bytes") < 300).alias("is_document"),
        F.when(quality.isNotNull() | (F.col("doc_id") % 3 > 0), F.coalesce(quality, F.lit(1)) == 1).alias("quality_pass"),
        (F.col("value") / 100).alias("score"),
        *(["phash", "level", "blown", "edge", "saturation",
           F.when(F.col("bytes") >= 20, F.col("blur")).alias("blur_var")] if signals else []),
    ).withColumn("is_hero", F.coalesce("hero_flag", F.lit(False))).drop("hero_flag")


def signal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with fingerprints and metrics, computed once and stored, as the asset table keeps them.
    For queries that read it more than once."""
    return cut_lineage(asset_view(spark, sf_dir, signals=True))


def _chapter(ts: Column) -> Column:
    day = F.date_format(ts, "yyyy-MM-dd")
    first, second, third = (c.end for c in CHAPTERS[:3])
    return (
        F.when(day <= first, CHAPTERS[0].id).when(day <= second, CHAPTERS[1].id)
        .when(day <= third, CHAPTERS[2].id).otherwise(CHAPTERS[3].id)
    )


# The same view in SQL. ``fp`` is only added where a query needs fingerprints or metrics.
DOCS_CTE = """
docs AS (
  SELECT sha1(text) AS asset_id, doc_id, source AS src, lang, n_chars AS bytes, text
  FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1
)"""
FP_CTE = """
marks AS (
  SELECT asset_id, bytes, array_to_string(list_transform(regexp_split_to_array(text, '[ \\n\\r\\t]+'),
    lambda w: substr(base64(unhex(md5(w))), 1, 1)), '') AS m FROM docs
), prof AS (
  SELECT asset_id, bytes, list_transform(
    string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', ''),
    lambda c: (length(m) - length(replace(m, c, '')))::DOUBLE) AS v FROM marks
), lev AS (
  SELECT *, list_transform(v, lambda x: x * 255 / list_max(v)) AS l,
    list_sort(v) AS s FROM prof
), bits AS (
  SELECT *, list_transform(range(0, 64), lambda i: CASE WHEN v[i+1] > (s[32] + s[33]) / 2 THEN 1 ELSE 0 END) AS b,
    list_transform(range(2, 64), lambda i: v[i-1] - 2 * v[i] + v[i+1]) AS d2,
    list_transform(range(1, 64), lambda i: abs(l[i+1] - l[i])) AS d1
  FROM lev
), fp AS (
  SELECT asset_id,
    list_sum(list_transform(range(0, 32), lambda i: b[i+1]::BIGINT << (31 - i)))::BIGINT AS hi,
    list_sum(list_transform(range(0, 32), lambda i: b[i+33]::BIGINT << (31 - i)))::BIGINT AS lo,
    CASE WHEN bytes >= 20 THEN list_var_pop(d2) END AS blur_var,
    list_avg(l) AS level,
    length(list_filter(l, lambda x: x > 250)) / 64 AS blown,
    length(list_filter(d1, lambda x: x > 100)) / 64 AS edge,
    list_min(v) / list_max(v) AS saturation
  FROM bits
)"""
ASSETS_CTE = DOCS_CTE + """,
raw AS (
  SELECT d.*, e.ts, e.event_type AS kind, e.value, l.quality, l.toxic, d.doc_id::VARCHAR AS no
  FROM docs d LEFT JOIN events e ON e.event_id = d.doc_id * 11 LEFT JOIN labels l ON l.doc_id = d.doc_id
), assets AS (
  SELECT asset_id, doc_id, src, lang, bytes,
    1000 + doc_id * 37 % 3000 AS w, 1000 + doc_id * 53 % 3000 AS h,
    '/library/' || src || '/' || CASE kind
      WHEN 'click' THEN 'IMG_' || lpad((doc_id // 20)::VARCHAR, 4, '0') || '.jpg'
      WHEN 'purchase' THEN 'Market Day ' || lang || '-' || no || '.JPG'
      WHEN 'signup' THEN 'PXL_' || strftime(ts, '%Y%m%d') || '_' || no || '.jpg'
      WHEN 'view' THEN 'signal-' || strftime(ts, '%Y-%m-%d') || '-' || no || '.png'
      WHEN 'error' THEN 'Screenshot_' || no || '.png'
      ELSE 'notes_all_' || no || '.jpg' END AS orig_path,
    CASE WHEN kind IN ('click', 'error') THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      WHEN kind = 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
      WHEN kind IN ('signup', 'view') THEN strftime(ts, '%Y-%m-%dT12:00:00') END AS best_datetime,
    CASE kind WHEN 'click' THEN 'exif' WHEN 'purchase' THEN 'sidecar' WHEN 'signup' THEN 'filename'
      WHEN 'view' THEN 'filename_seq' WHEN 'error' THEN 'mtime' END AS date_source,
    CASE WHEN kind IN ('click', 'purchase') THEN 'high' WHEN kind IN ('signup', 'view') THEN 'medium'
      ELSE 'low' END AS date_confidence,
    CASE WHEN ts::DATE <= '2024-01-09' THEN '01_early' WHEN ts::DATE <= '2024-01-16' THEN '02_travel'
      WHEN ts::DATE <= '2024-01-23' THEN '03_home' ELSE '04_family' END AS chapter,
    CASE kind WHEN 'view' THEN 'Trip ' || upper(lang) WHEN 'signup' THEN 'trip_' || lang END AS event,
    concat_ws(', ', lang, CASE WHEN quality = 1 THEN 'family' END, CASE WHEN toxic = 1 THEN 'milestones' END) AS tags,
    CASE WHEN toxic = 1 THEN '  ' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'About ' || no END AS caption,
    doc_id % 7 = 0 AS favorited,
    CASE WHEN quality IS NOT NULL THEN doc_id % 4 END AS people_count,
    CASE WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'reject' WHEN doc_id % 2 = 0 THEN 'pending' END AS review_status,
    coalesce(quality = 1 AND doc_id % 13 = 0, false) AS is_hero,
    'B' || (doc_id % 3)::VARCHAR AS ingest_batch,
    coalesce(toxic, 0) = 0 AS is_dup_keep,
    coalesce(kind = 'error', false) AS is_screenshot,
    bytes < 300 AS is_document,
    CASE WHEN quality IS NOT NULL OR doc_id % 3 > 0 THEN coalesce(quality, 1) = 1 END AS quality_pass,
    value / 100 AS score
  FROM raw
)"""


def sql(body: str, signals: bool = False, recursive: bool = False) -> str:
    """Put the view's definition in front of a query on ``assets`` (and ``fp``)."""
    ctes = ASSETS_CTE + ("," + FP_CTE if signals else "")
    head = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    return f"{head} {ctes}{body if body.startswith(',') else ' ' + body}"
