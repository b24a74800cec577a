"""Fill-in-the-middle, fingerprints and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, docs, sentence

from gleaner.llm import fim, prefix_hash, reversed_search
from gleaner.llm.reach import reachable

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES = st.lists(st.sampled_from(["a", "bc", " ", "\n\t", " ", "é", "漢字", "😀", "  x", "<", "P>"]), max_size=60).map("".join)


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    reachable(spark)


def sharp(rows):
    """Rows with all columns of the same names as the results, which must not be looked at."""
    return rows.selectExpr("*", "'x' AS form", "1 AS n", "'y' AS output", "2 AS hash", "3 AS part", "4 AS score", "5 AS id", "true AS guest", "6 AS term")


# --- fill in the middle ---------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_cutter_finds_every_unit_end(text, block):
    data = np.frombuffer(text.encode(), np.uint8)
    units = UNIT.findall(text)
    cutter = fim.Cutter(data, block)
    assert cutter.n == len(units)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert cutter.cut(k) == (len(head.encode()), len(head))


def test_cutter_over_several_segments():
    text = " ".join("é" * (1 + i % 7) for i in range(400_000)) + "  "
    units = UNIT.findall(text)
    cutter = fim.Cutter(np.frombuffer(text.encode(), np.uint8))
    assert cutter.n == len(units)
    for k in (1, 2, 1000, 199_999, len(units) - 1, len(units)):
        head = "".join(units[:k])
        assert cutter.cut(k) == (len(head.encode()), len(head))


def plain_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_and_back(spark):
    rows = awkward()
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(
        ["a <P> b", "<S>", "x <M>", "<<<P <S M>", "ends with <", " ", "  \n ", "漢字 é 😀 " * 9, "word " * 50_000] * 6)]
    out = fim.fill_in_middle(sharp(docs(spark, rows))).withColumn("text", fim.restored()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([tuple(r)[:6] for r in out], key=key) == sorted([plain_fim(r[0], r[1]) for r in rows], key=key)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1] or "") for r in rows)
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert fim.fill_in_middle(docs(spark, [])).collect() == []


# --- fingerprints ---------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.data())
def test_spans_and_extensions(one, two, data):
    a, b = (prefix_hash.Prefixes(prefix_hash._code_points(t)) for t in (one, two))
    i, j = data.draw(st.integers(0, len(one))), data.draw(st.integers(0, len(two)))
    naive = 0
    while i + naive < len(one) and j + naive < len(two) and one[i + naive] == two[j + naive]:
        naive += 1
    assert a.extension(i, b, j) == naive
    k = data.draw(st.integers(0, min(len(one) - i, len(two) - j)))
    assert (a.span(i, i + k) == b.span(j, j + k)) == (one[i : i + k] == two[j : j + k])
    assert a.spans(np.array([i]), np.array([i + k]))[0] == a.span(i, i + k)


def test_hashes_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(3)
    text = " ".join(sentence(rng, 40) + " é漢" for _ in range(30))
    whole = prefix_hash.Fingerprint.of(text).text()
    monkeypatch.setattr(prefix_hash, "SEGMENT", 97)
    assert prefix_hash.Fingerprint.of(text).text() == whole


def test_thue_morse_words_differ():
    """Two texts that collide under any polynomial hash modulo a power of two."""
    bits = "0"
    for _ in range(12):
        bits += bits.translate(str.maketrans("01", "10"))
    other = bits.translate(str.maketrans("01", "10"))
    assert prefix_hash.Fingerprint.of(bits).text() != prefix_hash.Fingerprint.of(other).text()


def like(a, b):
    one, two = (prefix_hash.Fingerprint.read(prefix_hash.Fingerprint.of(t).text()) for t in (a, b))
    assert prefix_hash.likeness(one, two) == prefix_hash.likeness(two, one)
    return prefix_hash.likeness(one, two)


@pytest.mark.parametrize("n", [4, 10, 60, 64, 65, 66, 300, 3000, 60_000])
def test_likeness_follows_the_shared_share(n):
    rng = random.Random(n)
    text, other = sentence(rng, n, 10**6), sentence(rng, n, 10**6)
    half = text[: len(text) // 2] + other[: len(text) // 2]
    assert like(text, text) == 1 and like(text, other) == 0
    assert abs(like(text, half) - 0.5) < (0.3 if n == 4 else 0.12)
    if n >= 60:
        words = text.split()
        words[n // 3 : n // 3] = ["new", "words"]
        assert like(text, " ".join(words)) > 0.75
        moved = text.split()
        assert like(text, " ".join(moved[n // 2 :] + moved[: n // 2])) > 0.75


def test_repeated_and_empty_texts():
    assert like("", "") == 1 and like("", "a") == 0 and like("a", "b") == 0
    text = "same words again " * 5000
    half = text[: len(text) // 2] + "x" * (len(text) // 2)
    assert 0.4 < like(text, half) < 0.55
    assert like("z" * 600_000, "z" * 600_000) == 1 and like("z" * 600_000, "z" * 600_001) < 1


@pytest.mark.parametrize("ranges", [1, 2000])
def test_edited_against_plain(spark, monkeypatch, ranges):
    monkeypatch.setattr(prefix_hash, "RANGE_BYTES", 1 << 30 if ranges == 1 else 3000)
    rows = [r for r in awkward() if r[0] is not None] + [(10_000 + i, f"text {i} " * (i % 9), None, None, None) for i in range(200)]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "the last one of all", None, None, None)]
    out = {r["doc_id"]: r for r in prefix_hash.edited(sharp(docs(spark, rows))).collect()}
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for row, nxt in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = row[1] or "", nxt[1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        got = out[row[0]]
        prints = [prefix_hash.Fingerprint.of(t) for t in (text, changed, after)]
        assert (got["n_chars"], got["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (got["fingerprint"], got["edited_fingerprint"]) == (prints[0].text(), prints[1].text())
        assert (got["near_edited"], got["near_next"]) == (prefix_hash.likeness(*prints[:2]), prefix_hash.likeness(prints[0], prints[2]))
    plain = {r["doc_id"]: r["fingerprint"] for r in prefix_hash.fingerprints(docs(spark, rows)).collect()}
    assert plain == {k: r["fingerprint"] for k, r in out.items()}


def test_edited_with_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_hash, "RANGE_BYTES", 1500)
    rng = random.Random(8)
    rows = [(7 if i % 2 else i, sentence(rng, 20), None, None, None) for i in range(200)]
    rows += rows[:20]
    keyed = docs(spark, rows).selectExpr("doc_id", "text", "doc_id AS id", "xxhash64(text) AS hash")
    ranges = prefix_hash._Ranges(keyed)
    sizes = keyed.withColumn("part", ranges.column("own")).groupBy("part").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 60
    out = prefix_hash.edited(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)


def test_edited_of_one_row_and_none(spark):
    assert prefix_hash.edited(docs(spark, [])).collect() == []
    lone = prefix_hash.edited(docs(spark, [(3, "ab cd", None, None, None)])).collect()[0]
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


# --- ranked search --------------------------------------------------------------------------------


def plain_search(rows, items, top=10):
    texts = [(d, TERM.findall((t or "").translate(FOLD))) for d, t, *_ in rows]
    held = [(d, Counter(t), len(t)) for d, t in texts if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    grouped = {}
    for i, t in items:
        grouped.setdefault(i, set()).add(t)
    out = []
    for i, own in grouped.items():
        wanted = Counter(w for t in own if t for w in TERM.findall(t.translate(FOLD)))
        scored = []
        for d, tf, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            total = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                for w, k in wanted.items() if w in tf
            )
            if total > 0:
                scored.append((-total, d is None, d or 0, d))
        out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [
    (1, "w1 w2 w3 W2 w2"), (2, None), (3, ""), (4, "!!! ..."), (5, "w5"), (5, "w6 w6"), (5, "w5"), (6, "nowhere found"),
    (7, "ünï cödé w9"), (8, " ".join(f"w{i}" for i in range(400))), (None, "w11 w12"), (9, "same aaa"),
]


@pytest.mark.parametrize("block", [200_000, 6])
def test_search_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(reversed_search, "ITEM_TERMS", block)
    monkeypatch.setattr(reversed_search, "CELLS", 40)
    rows = awkward() + [(500 + i, "w1 w2 tie", None, None, None) for i in range(30)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS item")
    got = reversed_search.search(sharp(docs(spark, rows)).repartition(7), items).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(rows, ITEMS), key=key)


def test_heaps_take_ties_in_any_order():
    rng = random.Random(2)
    pairs = [(rng.randrange(5), d) for d in range(300)]
    rng.shuffle(pairs)
    heaps = reversed_search.Heaps(1, 10)
    for a in range(0, 300, 7):
        part = pairs[a : a + 7]
        heaps.offer(np.array([[s] for s, _ in part]), np.array([d for _, d in part]))
    best = sorted((p for p in pairs if p[0]), key=lambda p: (-p[0], p[1]))[:10]
    assert sorted((-s, -d) for s, d in heaps.rows[0]) == [(-s, d) for s, d in best]


def test_search_in_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert reversed_search.search(docs(spark, []), items).collect() == []
    assert reversed_search.search(docs(spark), items.limit(0)).collect() == []
    assert reversed_search.search(docs(spark, [(1, None, None, None, None), (2, "", None, None, None)]), items).collect() == []


def test_scores_of_an_empty_block():
    index = reversed_search.Index.of(["a b", "b"])
    stats = reversed_search.Statistics(0, 0, np.zeros(2, np.int64))
    assert reversed_search.scores(index, stats, pa.array(["", "c"], pa.string())).tolist() == [[0, 0], [0, 0]]
