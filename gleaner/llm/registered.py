"""The dealt operators as named queries over whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    decontaminate, fim, html_text, jaccard_join, labelled, language_id, packing, prefix_hash, quality_knn, quality_rules, reversed_search,
    sharding, substring_dedup, toxicity,
)
from gleaner.llm.reach import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_substring_dedup", f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM t GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM t JOIN least USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '') AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op6_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_jaccard_components", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hit >= 80 * (x.n + y.n - hit)
),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op10_jaccard_components(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}'))) AS capital
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words
    OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR 2 * capital > n_words) AS kept
FROM f
""")
def op2_quality_rules(spark, sf_dir):
    docs = quality_rules.with_base(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = quality_rules.cascade(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.col("failed").isNull().alias("kept"),
    )


@query("op4_balanced_labels")
def op4_balanced_labels(spark, sf_dir):
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op5_decontaminate")
def op5_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = labelled.remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_quality_knn")
def op8_quality_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = labelled.remainder(F.col("doc_id"), 5) == 0
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality_knn.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = labelled.remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op7_html_text")
def op7_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = html_text.extract(pages, html_text.train(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op11_fim_fenwick", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
draw AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain,
    ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm
  FROM d
),
cut AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS s
  FROM draw
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
""")
def op11_fim_fenwick(spark, sf_dir):
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


@query("op12_prefix_hashes")
def op12_prefix_hashes(spark, sf_dir):
    return prefix_hash.edited(table(spark, sf_dir, "documents"))


@query("op13_reversed_search", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
),
i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
),
wanted AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, r, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, r, t, unnest(t) AS term FROM d) WHERE term IN (FROM (SELECT term FROM wanted)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (
  SELECT item_id, doc_id, r, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term), total GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM part WHERE score > 0
) WHERE rank <= 10
""")
def op13_reversed_search(spark, sf_dir):
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
