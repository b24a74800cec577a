import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import exchange, jaccard_join, kernel, substring_dedup
from llm_cases import SCHEMA, awkward, docs, sentence, words

LOW = -(1 << 63)


def test_words_and_hashes_match_python():
    texts = [t for _, t, *_ in awkward()]
    found = kernel.find_words(pa.array(texts))
    assert list(found.counts) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    by_hash = dict(zip(found.hashes().tolist(), flat))
    assert len(by_hash) == len(set(flat))
    assert [by_hash[h] for h in found.hashes().tolist()] == flat


def test_long_words_cross_segments(monkeypatch):
    text = " ".join(["ab" * 50, "c", "ab" * 50, "d" * 300])
    want = kernel.find_words(pa.array([text])).hashes()
    monkeypatch.setattr(kernel, "SEGMENT", 64)
    assert (kernel.find_words(pa.array([text])).hashes() == want).all()


def test_fragments_round_trip():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    back = np.concatenate([exchange.decode(b)[0] for _, _, b in exchange.fragments(np.zeros(5000, int), values, 7, 64)])
    assert (back == np.unique(values)).all()


def test_rows_of_many_chunks_are_sent_in_one_fragment_a_hash_range():
    """The pipeline's rows come to the substring stage in hash order, so that a block holds rows of every chunk."""
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    values[1000:1500] = values[:500]
    chunks = rng.integers(0, 700, 4000).astype(np.int32)
    sent = list(exchange.fragments(chunks, values, 9, 64))
    assert len(sent) <= 9
    back = collections.Counter()
    for _, least, blob in sent:
        v, n, c = exchange.decode(blob)
        back.update({(int(a), int(b) + least): int(k) for a, b, k in zip(v, c, n)})
    assert back == collections.Counter(zip(values.tolist(), chunks.tolist()))
    assert list(exchange.fragments(chunks[:0], values[:0], 9, 64)) == []


def brute_removals(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        out.append((None if i == LOW else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 2000])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk_bytes)
    rows = [(LOW if i is None else i, t) for i, t, *_ in awkward()]
    got = substring_dedup.remove_repeats(docs(spark)).select("doc_id", "n_words", "n_removed", "kept", "spans").collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute_removals(rows)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_substring_dedup_keeps_columns_and_takes_empty_tables(spark):
    clash = docs(spark).withColumn("kept", F.lit("k")).withColumn("row", F.lit(1)).withColumn("spans", F.lit(None).cast("string"))
    out = substring_dedup.cut_repeats(clash)
    assert out.columns == clash.columns
    assert out.where("text LIKE '%\n%'").count() > 0
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            hit = len(sets[a] & sets[b])
            if hit and 100 * hit >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def random_families(seed):
    """Families of edited copies around the threshold, short texts and a passage in many rows."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 25, 50)
    for _ in range(12):
        base = sentence(rng, rng.choice([4, 5, 6, 9, 20, 60, 200]), 3000).split()
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 20))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(9999)}"
            rows.append(" ".join(own[rng.randrange(2) : len(own) - rng.randrange(2)]))
    rows += [f"{passage} {sentence(rng, 6, 5000)}" for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,frequent", [(2, 1), (3, 2)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = random_families(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_awkward_rows(spark):
    table = docs(spark).withColumn("component_id", F.lit(9)).withColumn("n", F.lit("x"))
    got = jaccard_join.jaccard_components(table).collect()
    want = brute_components([(i, t) for i, t, *_ in awkward() if i is not None])
    assert len(got) == len(awkward())
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def brute_rows(rows):
    """Components by row: (doc_id, text, component_id, number of its component)."""
    found = brute_components(list(enumerate(t for _, t in rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        root = found[k][1]
        least[root] = min(least.get(root, i), i)
    return [(i, t, least[found[k][1]], found[k][1]) for k, (i, t) in enumerate(rows)]


def repeated_ids(seed):
    """Families whose rows share few doc_ids, with texts found once under an id that copies have too."""
    rng = random.Random(seed)
    texts = [t for _, t in random_families(seed)]
    rows = [(rng.randrange(len(texts) // 3), t) for t in texts]
    a, b = sentence(rng, 40, 9000), sentence(rng, 40, 9000)
    rows += [(9003, a), (9005, a), (9005, b), (9009, "short"), (9005, ""), (9010, a), (9010, a)]
    rng.shuffle(rows)
    return rows


def test_one_doc_id_with_several_texts(spark):
    rows = repeated_ids(4)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.jaccard_components(table).select("doc_id", "component_id").collect()
    want = brute_rows(rows)
    assert sorted(tuple(r) for r in got) == sorted((i, c) for i, _, c, _ in want)

    extra = table.withColumn("_row", F.lit(1)).withColumn("_out", F.lit("x")).withColumn("component_id", F.lit(2))
    kept = jaccard_join.one_of_each_group(extra)
    assert kept.columns == extra.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    component = {(i, t): (g, c) for i, t, c, g in want}
    groups = [component[r] for r in left if words(r[1])]
    assert len(groups) == len(set(groups)) == len({(g, c) for _, t, c, g in want if words(t)})
    assert all(r[0] == component[r][1] for r in left)
    assert (9005, "") in left and (9005, rows[[r[0] for r in rows].index(9003)][1]) not in left
    assert sum(r[0] == 9005 for r in left) == 2


def test_one_of_each_group_awkward_rows(spark):
    table = docs(spark)
    left = jaccard_join.one_of_each_group(table).collect()
    assert sum(r["doc_id"] is None for r in left) == 2
    rows = [(i, t) for i, t, *_ in awkward() if i is not None]
    want = brute_rows(rows)
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None and words(r["text"])) == sorted(c for _, c in {(g, c) for _, t, c, g in want if words(t)})
    assert sum(r["doc_id"] is not None and not words(r["text"]) for r in left) == sum(not words(t) for _, t in rows)
    assert jaccard_join.one_of_each_group(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n,other", [(1, 1), (4, 5), (16, 20), (60, 75), (300, 260), (540, 540)])
def test_prefix_keys_of_linked_sets_meet(n, other):
    rng = np.random.default_rng(n)
    for _ in range(30):
        union = rng.integers(0, 1 << 62, n + other, dtype=np.uint64)
        hit = -(-80 * (n + other) // 180)
        if hit > min(n, other):
            return
        a, b = union[:n], np.concatenate([union[:hit], union[n : n + other - hit]])
        kind = collections.defaultdict(lambda: int(rng.integers(1, 9)))
        keys = [set(jaccard_join.prefix_keys(np.sort(s), np.array([kind[int(x)] for x in np.sort(s)], np.uint8), len(s), 0).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def test_schema_is_that_of_the_tables(spark):
    assert docs(spark).schema.simpleString() == f"struct<{SCHEMA.replace(', ', ',').replace(' ', ':')}>"
