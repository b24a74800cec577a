"""Fingerprints, near-duplicate edges, components and keepers over the asset view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import hashing
from gleaner.operators import moments, neardup
from gleaner.plans.assets import CONFIG, asset_view, signal_view, sql, table
from gleaner.plans.registry import query
from gleaner.session import cut_lineage, dimension

PRIORITY_CTE = """, prio(src, priority) AS (
  VALUES ('src0', 100), ('src1', 80), ('src2', 50), ('src3', 50), ('src4', 20))"""
NODES_CTE = """, hashed AS (
  SELECT a.asset_id, f.hi, f.lo, try_cast(left(a.best_datetime, 19) AS TIMESTAMP) AS at,
    coalesce(left(a.best_datetime, 10), 'nodate') AS day, a.date_confidence = 'low' AS low
  FROM assets a JOIN fp f USING (asset_id) WHERE f.hi IS NOT NULL
), nodes AS (
  SELECT hi, lo, day, min(asset_id) AS node, count(*) AS members FROM hashed GROUP BY ALL
), days AS (SELECT DISTINCT day, try_cast(day AS DATE) AS d FROM nodes)"""
NEAR = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
DAY_EDGES_CTE = f""", day_edges AS (
  SELECT least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, ({NEAR})::BIGINT AS distance
  FROM nodes a JOIN nodes b ON a.node < b.node AND {NEAR} <= 6
  WHERE (a.day = 'nodate' AND b.day = 'nodate')
    OR abs(try_cast(a.day AS DATE) - try_cast(b.day AS DATE)) <= 1
    OR (abs(try_cast(a.day AS DATE) - try_cast(b.day AS DATE)) = 2
        AND EXISTS (SELECT 1 FROM days m WHERE m.d = least(try_cast(a.day AS DATE), try_cast(b.day AS DATE)) + 1))
)"""


def window_edges_cte(days: int) -> str:
    return f""", window_edges AS (
  SELECT DISTINCT least(na.node, nb.node) AS src, greatest(na.node, nb.node) AS dst, ({NEAR})::BIGINT AS distance
  FROM hashed a JOIN hashed b ON a.low AND a.at IS NOT NULL AND b.at IS NOT NULL
    AND b.at BETWEEN a.at - INTERVAL {days} DAY AND a.at + INTERVAL {days} DAY AND {NEAR} <= 6
  JOIN nodes na ON na.hi = a.hi AND na.lo = a.lo AND na.day = a.day
  JOIN nodes nb ON nb.hi = b.hi AND nb.lo = b.lo AND nb.day = b.day
  WHERE na.node <> nb.node
)"""


COMPONENTS_CTE = """, sym AS (
  SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges
), reach(a, b) AS (
  SELECT a, a FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b
), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""
GROUPS_CTE = """, groups AS (
  SELECT h.asset_id, coalesce(c.component, n.node) AS dup_group
  FROM hashed h JOIN nodes n USING (hi, lo, day) LEFT JOIN comp c ON c.id = n.node
), ranked AS (
  SELECT g.dup_group, a.*, coalesce(p.priority, 0) AS priority,
    row_number() OVER (PARTITION BY g.dup_group
      ORDER BY coalesce(p.priority, 0) DESC, a.w * a.h DESC, a.bytes DESC, a.asset_id) AS place
  FROM groups g JOIN assets a USING (asset_id) LEFT JOIN prio p USING (src)
)"""
FULL_GROUPS = (
    PRIORITY_CTE + NODES_CTE + DAY_EDGES_CTE + window_edges_cte(30)
    + ", edges AS (SELECT src, dst FROM day_edges UNION SELECT src, dst FROM window_edges)"
    + COMPONENTS_CTE + GROUPS_CTE
)


def priority_dim(spark):
    return dimension(spark, list(CONFIG.priority.items()), "src string, priority int")


def grouped_assets(spark, sf_dir):
    assets = signal_view(spark, sf_dir)
    groups = neardup.duplicate_groups(assets, CONFIG.dedup.max_distance, CONFIG.dedup.window_days)
    facts = assets.select("asset_id", "src", "w", "h", "bytes").join(priority_dim(spark), "src", "left")
    return neardup.keepers(facts.join(groups, "asset_id"))


@query(
    "entry_keepers_by_source",
    sql(FULL_GROUPS + """
SELECT src, count(*) AS total, count(*) FILTER (place = 1) AS kept, count(*) FILTER (place > 1) AS flagged
FROM ranked GROUP BY src""", signals=True, recursive=True),
)
def entry_keepers_by_source(spark, sf_dir):
    return grouped_assets(spark, sf_dir).groupBy("src").agg(
        F.count("*").alias("total"), F.count_if("is_dup_keep").alias("kept"),
        F.count_if(~F.col("is_dup_keep")).alias("flagged"),
    )


@query(
    "p23_fingerprint64",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT *, list_sort(v) AS s FROM v),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN v[i+1] > (s[32] + s[33]) / 2 THEN 1 ELSE 0 END) AS b FROM s)
SELECT vec_id, format('{:08x}{:08x}',
  list_sum(list_transform(range(0, 32), lambda i: b[i+1]::BIGINT << (31 - i)))::BIGINT,
  list_sum(list_transform(range(0, 32), lambda i: b[i+33]::BIGINT << (31 - i)))::BIGINT) AS phash FROM b""",
)
def p23_fingerprint64(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", hashing.hex_from_bits(hashing.fingerprint64(F.col("embedding"))).alias("phash")
    )


@query(
    "p23_text_fingerprint",
    sql("SELECT asset_id, format('{:08x}{:08x}', hi, lo) AS phash FROM fp", signals=True),
)
def p23_text_fingerprint(spark, sf_dir):
    return asset_view(spark, sf_dir, signals=True).select(
        "asset_id", hashing.hex_from_bits(F.col("phash")).alias("phash")
    )


@query(
    "p22_signal_metrics",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id,
  round(list_var_pop(list_transform(range(2, 64), lambda i: v[i-1] - 2 * v[i] + v[i+1])), 6) AS curvature,
  round(list_avg(v), 6) AS level, round(list_stddev_pop(v), 6) AS spread,
  round(length(list_filter(v, lambda x: x > 0.1)) / 64, 6) AS clipped,
  round(length(list_filter(range(1, 64), lambda i: abs(v[i+1] - v[i]) > 0.2)) / 64, 6) AS edges
FROM v""",
)
def p22_signal_metrics(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(hashing.second_difference_variance(v), 6).alias("curvature"),
        F.round(hashing.mean_level(v), 6).alias("level"),
        F.round(hashing.level_stddev(v), 6).alias("spread"),
        F.round(hashing.clipped_fraction(v, 0.1), 6).alias("clipped"),
        F.round(hashing.edge_density(v, 0.2), 6).alias("edges"),
    )


@query(
    "p4_hamming64",
    sql("""SELECT a.asset_id, b.asset_id AS next_id,
  (CASE WHEN a.hi IS NULL OR b.hi IS NULL THEN 99 ELSE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) END)::BIGINT AS distance
FROM (SELECT fp.*, doc_id FROM fp JOIN docs USING (asset_id)) a
LEFT JOIN (SELECT fp.*, doc_id FROM fp JOIN docs USING (asset_id)) b ON b.doc_id = a.doc_id + 1""", signals=True),
)
def p4_hamming64(spark, sf_dir):
    a = signal_view(spark, sf_dir).select("asset_id", "doc_id", "phash")
    b = a.select(F.col("asset_id").alias("next_id"), (F.col("doc_id") - 1).alias("doc_id"), F.col("phash").alias("other"))
    return a.join(b, "doc_id", "left").select(
        "asset_id", "next_id", hashing.hamming_or_far(F.col("phash"), F.col("other")).cast("bigint").alias("distance")
    )


def _edge_columns(edges):
    return edges.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
        F.col("distance").cast("bigint").alias("distance"),
    )


@query(
    "j1_dup_edges_day",
    sql(NODES_CTE + DAY_EDGES_CTE + " SELECT * FROM day_edges", signals=True),
)
def j1_dup_edges_day(spark, sf_dir):
    nodes = cut_lineage(neardup.fingerprint_nodes(asset_view(spark, sf_dir, signals=True)))
    return _edge_columns(neardup.day_edges(nodes, CONFIG.dedup.max_distance))


@query(
    "j2_dup_edges_lowconf",
    sql(NODES_CTE + window_edges_cte(5) + " SELECT * FROM window_edges", signals=True),
)
def j2_dup_edges_lowconf(spark, sf_dir):
    nodes = cut_lineage(neardup.fingerprint_nodes(asset_view(spark, sf_dir, signals=True)))
    return _edge_columns(neardup.window_edges(nodes, CONFIG.dedup.max_distance, window_days=5))


@query(
    "j3_dup_edges_all",
    sql(f""", one AS (SELECT hi, lo, min(asset_id) AS node FROM fp GROUP BY ALL)
SELECT a.node AS src, b.node AS dst, ({NEAR})::BIGINT AS distance
FROM one a JOIN one b ON a.node < b.node AND {NEAR} <= 6""", signals=True),
)
def j3_dup_edges_all(spark, sf_dir):
    assets = signal_view(spark, sf_dir)
    return _edge_columns(neardup.all_edges(assets, CONFIG.dedup.max_distance))


@query(
    "a4_connected_components",
    sql(FULL_GROUPS + " SELECT asset_id, dup_group FROM groups", signals=True, recursive=True),
)
def a4_connected_components(spark, sf_dir):
    assets = signal_view(spark, sf_dir)
    return neardup.duplicate_groups(assets, CONFIG.dedup.max_distance, CONFIG.dedup.window_days)


@query(
    "a4_group_numbers",
    sql(FULL_GROUPS + " SELECT asset_id, dense_rank() OVER (ORDER BY dup_group) AS group_no FROM groups",
        signals=True, recursive=True),
)
def a4_group_numbers(spark, sf_dir):
    groups = a4_connected_components(spark, sf_dir)
    return groups.join(neardup.dense_group_ids(groups), "dup_group").select("asset_id", "group_no")


@query(
    "a5_keeper",
    sql(FULL_GROUPS + " SELECT asset_id, dup_group, place = 1 AS is_dup_keep FROM ranked",
        signals=True, recursive=True),
)
def a5_keeper(spark, sf_dir):
    return grouped_assets(spark, sf_dir).select("asset_id", "dup_group", "is_dup_keep")


@query(
    "a13_dedup_summary",
    sql(FULL_GROUPS + """
SELECT sum(n)::BIGINT AS total, count(*) AS kept, (sum(n) - count(*))::BIGINT AS dup_flagged,
  count(*) FILTER (n > 1) AS multi_member_groups
FROM (SELECT dup_group, count(*) AS n FROM ranked GROUP BY dup_group)""", signals=True, recursive=True),
)
def a13_dedup_summary(spark, sf_dir):
    return neardup.stage_summary(grouped_assets(spark, sf_dir))


COUNTER_CTE = """, counted AS (
  SELECT asset_id, src, upper(regexp_extract(orig_path, '(?i)/(IMG|DSC|DSCN|PICT|CIMG)_?(\\d{3,4})\\b', 1)) AS prefix,
    try_cast(nullif(regexp_extract(orig_path, '(?i)/(IMG|DSC|DSCN|PICT|CIMG)_?(\\d{3,4})\\b', 2), '') AS INTEGER) AS number
  FROM assets
), counter_edges AS (
  SELECT * FROM (
    SELECT lag(asset_id) OVER w AS src, asset_id AS dst, number - lag(number) OVER w AS gap FROM counted
    WHERE number IS NOT NULL WINDOW w AS (PARTITION BY src, prefix ORDER BY number, asset_id)) WHERE gap BETWEEN 1 AND 2
)"""
BURST_CTE = """, burst_edges AS (
  SELECT * FROM (
    SELECT lag(asset_id) OVER w AS src, asset_id AS dst, epoch_us(ts_at) - lag(epoch_us(ts_at)) OVER w AS gap
    FROM (SELECT *, left(best_datetime, 19)::TIMESTAMP AS ts_at FROM assets WHERE date_source IN ('exif', 'sidecar', 'filename'))
    WINDOW w AS (PARTITION BY src ORDER BY ts_at, asset_id)) WHERE gap BETWEEN 0 AND 120000000
)"""


@query("p6_filename_counter", sql(COUNTER_CTE + """
SELECT asset_id, prefix, number::BIGINT AS number FROM counted WHERE number IS NOT NULL"""))
def p6_filename_counter(spark, sf_dir):
    from gleaner.functions.text import filename_counter

    return (
        asset_view(spark, sf_dir)
        .select("asset_id", filename_counter(F.col("orig_path")).alias("c"))
        .where("c IS NOT NULL")
        .select("asset_id", "c.prefix", F.col("c.number").cast("bigint").alias("number"))
    )


@query("w1_counter_adjacency", sql(COUNTER_CTE + " SELECT src, dst FROM counter_edges"))
def w1_counter_adjacency(spark, sf_dir):
    return moments.counter_edges(asset_view(spark, sf_dir)).select("src", "dst")


@query("w2_burst", sql(BURST_CTE + " SELECT src, dst FROM burst_edges"))
def w2_burst(spark, sf_dir):
    return moments.burst_edges(asset_view(spark, sf_dir)).select("src", "dst")


@query(
    "w2_event_bursts",
    """
WITH t AS (SELECT event_type, ts, event_id,
  CASE WHEN ts - lag(ts) OVER w <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM t)
SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
FROM s GROUP BY event_type, session HAVING count(*) > 1""",
)
def w2_event_bursts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts")
    kind = dict(events.dtypes)["ts"]
    found = moments.bursts(events, "event_type", "ts").where("n > 1")
    return found.select("event_type", F.col("first_ts").cast(kind).alias("first_ts"), F.col("last_ts").cast(kind).alias("last_ts"), "n")


@query(
    "a4_moment_clusters",
    sql(COUNTER_CTE + BURST_CTE + f""", one AS (SELECT hi, lo, min(asset_id) AS node FROM fp GROUP BY ALL),
edges AS (
  SELECT a.node AS src, b.node AS dst FROM one a JOIN one b ON a.node < b.node AND {NEAR} <= 6
  UNION SELECT o.node, f.asset_id FROM fp f JOIN one o USING (hi, lo) WHERE o.node <> f.asset_id
  UNION SELECT src, dst FROM counter_edges UNION SELECT src, dst FROM burst_edges)"""
        + COMPONENTS_CTE + " SELECT id AS asset_id, component AS cluster FROM comp", signals=True, recursive=True),
)
def a4_moment_clusters(spark, sf_dir):
    return moments.moment_clusters(signal_view(spark, sf_dir), CONFIG.dedup.max_distance)


DAY_NODES = """, dated AS (
  SELECT left(a.best_datetime, 10) AS day, f.hi, f.lo, min(a.asset_id) AS node, count(*) AS members
  FROM assets a JOIN fp f USING (asset_id) WHERE f.hi IS NOT NULL AND left(a.best_datetime, 10) <> '' GROUP BY ALL
)"""


@query(
    "j4_day_pairs",
    sql(DAY_NODES + f"""
SELECT a.day, a.node AS asset_a, b.node AS asset_b, ({NEAR})::BIGINT AS distance, a.members AS members_a, b.members AS members_b
FROM dated a JOIN dated b ON a.day = b.day AND a.node < b.node AND {NEAR} <= 14""", signals=True),
)
def j4_day_pairs(spark, sf_dir):
    return moments.day_pairs(signal_view(spark, sf_dir))


@query(
    "j4_day_probes",
    sql(DAY_NODES + f"""
SELECT a.day, count(DISTINCT a.node) AS fingerprints, count(DISTINCT a.node) * (count(DISTINCT a.node) - 1) // 2 AS pairs,
  count(*) FILTER (a.node < b.node AND {NEAR} <= 14) AS found
FROM dated a JOIN dated b ON a.day = b.day GROUP BY a.day""", signals=True),
)
def j4_day_probes(spark, sf_dir):
    return moments.day_probe_report(signal_view(spark, sf_dir)).drop("candidates")
