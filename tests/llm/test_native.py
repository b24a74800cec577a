import collections
import hashlib
import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SCHEMA, awkward, docs, sentence, words
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_removals

from gleaner.llm import decontaminate, packing, quality_rules, sharding

# --- quality rules -----------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    w = words(text)
    windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {j + d for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for d in range(5)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def brute_kept(text):
    n, chars, signs, lines, repeats = brute_base(text)
    t = text or ""
    capital = sum(any(c.isupper() for c in w) and not any(c.islower() for c in w) for w in words(t))
    many_lines = lines >= 3 and 2 * lines > t.count("\n") + 1
    return not (n < 10 or 5 * repeats > n or 10 * signs > 3 * n or chars > 25 * n or chars < 2 * n or many_lines or 2 * capital > n)


def test_quality_matches_brute_force(spark):
    texts = [r[1] for r in awkward()] + ["l\nl\nl\nm\n" * 9, "ABC DEF " * 6 + sentence(random.Random(1), 4), "a# b## c$ " * 9, "x" * 400 + " y" * 11]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    base = quality_rules.with_base(table)
    got = {r["doc_id"]: r for r in quality_rules.cascade(base).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t), t
        assert (r["failed"] is None) == brute_kept(t), t


def test_quality_order_follows_rejections_and_never_changes_the_verdict(spark):
    base = quality_rules.with_base(docs(spark)).cache()
    rules = {"never": F.col("n_words") < 0, "often": F.col("n_words") < 1000, **quality_rules.default_rules()}
    order = quality_rules.order_rules(base, rules)
    assert order.index("often") < order.index("never")
    kept = [quality_rules.cascade(base, rules, o).where("failed IS NULL").count() for o in (order, order[::-1])]
    assert kept[0] == kept[1]
    base.unpersist()


def test_quality_keeps_clashing_columns_and_takes_empty_tables(spark):
    clash = docs(spark).withColumn("n_words", F.lit("x")).withColumn("failed", F.lit(None).cast("string")).withColumn("_words", F.lit(1))
    out = quality_rules.keep_good(clash)
    assert out.schema.names == clash.columns
    assert out.count() == sum(brute_kept(r[1]) for r in awkward())
    assert quality_rules.keep_good(docs(spark, [])).count() == 0


# --- sharding ----------------------------------------------------------------------------------


def check_shards(spark, rows, shards=24):
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), shards).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return got


def test_shards_are_even_and_groups_together(spark):
    rng, copies = random.Random(6), 400
    texts = [f"t{rng.randrange(700)}" for _ in range(600)] + ["hot"] * copies
    rows = list(enumerate(texts))
    got = check_shards(spark, rows)
    text, shards = dict(rows), collections.defaultdict(set)
    size = collections.Counter(texts)
    for r in got:
        shards[text[r["doc_id"]]].add(r["shard"])
    small = [t for t, n in size.items() if 1 < n < 10]
    assert sum(len(shards[t]) for t in small) <= 1.1 * len(small)
    # ten shards would hold the group if no other linked rows were in them
    assert len(shards["hot"]) <= 18


def test_shards_of_awkward_rows(spark):
    check_shards(spark, [(k, "all the same") for k in range(7)] + [(7, None), (7, None), (8, "")], 4)
    clash = docs(spark).withColumn("shard", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("slot", F.lit(1))
    sizes = [r["count"] for r in sharding.shard_rows(clash).groupBy("shard").count().collect()]
    assert sum(sizes) == len(awkward()) and max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(docs(spark, [])).count() == 0


# --- decontamination ---------------------------------------------------------------------------


def test_every_stretch_with_two_substitutions_is_found():
    rng = np.random.default_rng(0)
    item = " ".join(f"q{k}" for k in range(13))
    block = decontaminate.Block(pa.table({"item_id": [7], "text": [item]}))
    for a in range(13):
        for b in range(a, 13):
            own = item.split()
            own[a], own[b] = "sub1", "sub2"
            text = " ".join([*map(str, rng.integers(0, 99, 20)), *own, *map(str, rng.integers(0, 99, 20))])
            found = decontaminate._overlaps(pa.RecordBatch.from_pydict({"_plain": [text]}), block)
            # substitutions at an end shorten the stretch below the item
            inner = {a, b} <= set(range(1, 12))
            assert bool(found) == inner, (a, b)


def brute_overlaps(texts, items):
    out = {}
    for d, t in texts:
        for i, x in items:
            a, b = (re.findall(r"[^\W_]+", (s or "").lower()) for s in (t, x))
            best = 0
            for shift in range(-len(b) + 1, len(a)):
                eq = [a[shift + k] == b[k] for k in range(max(0, -shift), min(len(b), len(a) - shift))]
                for s in range(len(eq)):
                    for e in range(s + 1, len(eq) + 1):
                        if eq[s] and eq[e - 1] and sum(eq[s:e]) * 5 >= 4 * (e - s):
                            best = max(best, e - s)
            if len(b) >= 5 and best >= min(13, len(b)):
                out[d, i] = best
    return out


def test_overlaps_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, sentence(rng, rng.choice([4, 6, 14, 20, 30]))) for k in range(12)] + [(12, None), (13, "")]
    texts = []
    for k in range(30):
        own = (items[k % 12][1]).split()
        for _ in range(k % 4 if len(own) > 13 else 0):
            own[rng.randrange(len(own))] = "changed"
        if k % 5 == 0:
            own = own[: len(own) // 2]
        texts.append((k, f"{sentence(rng, 15)}. {' '.join(own).title()}, {sentence(rng, 15)}"))
    texts += [(None, items[3][1]), (31, None), (32, "")]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_overlaps(texts, items)
    for words_ in (1_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words_)
        got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.overlaps(table, bench).collect()}
        assert got == want
    clean = decontaminate.decontaminate(table, bench)
    hit = [d for d, _ in want]
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(d) for d, _ in texts if d not in hit)


def test_a_refused_stretch_hides_no_other_of_its_alignment(spark):
    # 12 equal words, 12 different, then 13 of which 11 agree: the first stretch is longer with its mismatches, but 12 without
    equal = [True] * 12 + [False] * 12 + [True] * 4 + [False] + [True] * 4 + [False] + [True] * 3
    item = [f"q{k}" for k in range(len(equal))]
    texts = [(0, " ".join(w if e else f"other{k}" for k, (w, e) in enumerate(zip(item, equal))))]
    rng = random.Random(9)
    for k in range(1, 60):
        texts.append((k, " ".join(w if rng.random() < 0.78 else f"other{j}" for j, w in enumerate(item))))
    items = [(7, " ".join(item))]
    want = brute_overlaps(texts, items)
    assert want[0, 7] == 13
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.overlaps(table, bench).collect()}
    assert got == want
    clean = decontaminate.decontaminate(table, bench).collect()
    assert {r["doc_id"] for r in clean} == {d for d, _ in texts} - {d for d, _ in want}


def test_decontamination_of_awkward_rows(spark):
    clash = docs(spark).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([(1, "a b"), (None, None)], "item_id bigint, text string")
    assert decontaminate.decontaminate(clash, bench).columns == clash.columns
    assert decontaminate.decontaminate(clash, bench).count() == len(awkward())
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0
    assert decontaminate.overlaps(clash, bench.where("1 = 0")).count() == 0


# --- packing -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_tokenizers(reference):
    codec = packing.encoder(packing.default_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(codec="utf-8"), max_size=60))
    def same(text):
        assert codec.encode_ordinary(text) == reference.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|> a", "a  b\n\n c\t\td ", "I'm it's WE'LL 123abc", "é  x", "日本語 テスト"):
        assert codec.encode_ordinary(text) == reference.encode(text, add_special_tokens=False).ids


def test_ids_of_long_white_space_are_those_of_tokenizers(spark, reference, monkeypatch):
    codec = packing.encoder(packing.default_vocabulary())
    blank = " " * 2_000_000
    for text in (f"a b{blank}c d", blank, "\n" * 1_200_000 + "x", f"a{blank}\u00a0b\n"):
        assert packing.token_ids(codec, text) == reference.encode(text, add_special_tokens=False).ids
    rows = [(1, f"a b{blank}c d"), (2, "e f")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_packing(rows, got, reference)
    monkeypatch.setattr(packing, "LONG_RUN", 2)

    @settings(max_examples=500, deadline=None)
    @given(st.text(st.sampled_from(" \t\n\r\x1c\x1f\x85\u00a0\u2003\u3000\u200bab's1."), max_size=40))
    def same(text):
        assert packing.token_ids(codec, text) == reference.encode(text, add_special_tokens=False).ids

    same()


def check_packing(rows, got, reference, length=2048):
    want = collections.Counter()
    ids = {}
    for i, t in rows:
        own = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(own)] += 1
        ids.setdefault((i, len(own)), own)
    seen = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == struct.pack(f"<{len(own)}I", *own) and len(own) == r["length"] > 0
        seen[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(seen[k] == k[1] * n for k, n in want.items()) and len(seen) == len(want)
    waste = 0
    for parts in sequences.values():
        upto = 0
        for offset, size in sorted(parts):
            assert offset == upto
            upto += size
        assert upto <= length
        waste += length - upto
    return waste, len(sequences)


def test_packing_round_trip_with_little_padding(spark, reference):
    rng = random.Random(8)
    rows = [(k, sentence(rng, int(rng.paretovariate(1.1) * 30) % 4000)) for k in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    waste, sequences = check_packing(rows, got, reference)
    assert waste <= 0.02 * sequences * 2048 + 2048


def test_packing_of_awkward_rows(spark, reference):
    rows = [(i, t) for i, t, *_ in awkward()]
    clash = docs(spark).withColumn("row", F.lit("x")).withColumn("ids", F.lit(1))
    check_packing(rows, packing.pack(clash).collect(), reference)
    assert packing.pack(docs(spark, [])).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert [r["length"] for r in packing.pack(one).collect()] == [1]


def test_least_squares_and_plan():
    rng = np.random.default_rng(5)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.non_negative_least_squares(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6
    counts = np.concatenate([[0], rng.integers(0, 50, 32)])
    used, fill = np.zeros(33, int), collections.Counter()
    for unit, start, stop, first, _ in packing.plan(counts, 32):
        assert used[unit] == start
        used[unit] = stop
        for k in range(stop - start):
            fill[first + k] += unit
    assert (used <= counts).all() and set(fill.values()) <= {32}


# --- pipeline ----------------------------------------------------------------------------------


def plain_pipeline(rows, bench):
    """The stages in plain Python up to packing."""
    kept = [(i, t) for i, t in rows if brute_kept(t)]
    group = brute_components(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    cut = {i: (n, gone, text) for i, n, gone, text in brute_removals(kept)}
    kept = [(i, cut[i][2] if cut[i][1] else t) for i, t in kept if cut[i][1] < cut[i][0]]
    leaks = {d for d, _ in brute_overlaps_fast(kept, bench)}
    return [(i, t) for i, t in kept if i not in leaks]


def brute_overlaps_fast(texts, items):
    index = collections.defaultdict(set)
    plain = {i: re.findall(r"[^\W_]+", x.lower()) for i, x in items}
    for i, w in plain.items():
        for j in range(len(w) - 4):
            index[tuple(w[j : j + 5])].add(i)
    out = {}
    for d, t in texts:
        w = re.findall(r"[^\W_]+", t.lower())
        near = set().union(*(index.get(tuple(w[j : j + 5]), ()) for j in range(len(w) - 4))) if len(w) > 4 else ()
        if near:
            out |= brute_overlaps([(d, t)], [(i, dict(items)[i]) for i in near])
    return out


def test_pipeline_matches_plain_python(spark, reference):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, bench)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in want}
    check_packing(want, got, reference)


def test_pipeline_stages_return_the_columns_of_documents(spark):
    table = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "/root/testdata/sf0.001")
        assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [tuple(c.split()) for c in SCHEMA.split(", ")]
    assert hashlib.sha256(b"").hexdigest()
