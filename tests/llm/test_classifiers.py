import random

import numpy as np
import pyarrow as pa
from llm_cases import SCHEMA, awkward, docs, sentence
from pyspark.sql import functions as F

from gleaner.llm import html_text, labelled, language_id, quality_knn, registered, toxicity

SF = "/root/testdata/sf0.01"


def test_language_is_right_on_held_out_rows(spark):
    got = registered.QUERIES["op1_language_id"](spark, SF)
    true = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(true, "doc_id").where("held_out AND lang IS NOT NULL").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert len(rows) > 150
    assert np.mean([r["ok"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_language(counts, text):
    """Word first, then the longest n-grams that are known, written out for one text."""
    import math

    languages = sorted(counts)
    known = {w for c in counts.values() for w, n in c.items() if n >= language_id.LEAST_COUNT}
    grams = {k: {} for k in languages}
    for k in languages:
        for w, n in counts[k].items():
            for size in range(1, 6):
                for g in language_id.grams(w, size):
                    grams[k][size, g] = grams[k].get((size, g), 0) + n
    total = {k: 0.0 for k in languages}
    kept = {k: {w: n for w, n in counts[k].items() if n >= language_id.LEAST_COUNT} for k in languages}

    def log(table, key, k, vocabulary):
        own = {x: n for x, n in table[k].items() if vocabulary(x)}
        size = len({x for t in table.values() for x in t if vocabulary(x)})
        return math.log((own.get(key, 0) + 0.5) / (sum(own.values()) + 0.5 * size + 1))

    for w in language_id.words(text):
        if w in known:
            for k in languages:
                total[k] += log(kept, w, k, lambda x: True)
            continue
        for size in range(min(5, len(w) + 2), 0, -1):
            hits = [g for g in language_id.grams(w, size) if any((size, g) in grams[k] for k in languages)]
            if hits:
                for k in languages:
                    total[k] += sum(log(grams, (size, g), k, lambda x: x[0] == size) for g in hits) / len(hits)
                break
    return total


def test_language_back_off_matches_brute_force():
    from collections import Counter

    counts = {"a": Counter("aba aba aba cac dad eab".split()), "b": Counter("zoz zoz zoz yoy xox".split())}
    model = language_id.Model(counts)
    for text in ("aba zoz", "abba", "zozo qq", "yox cad zoz zoz"):
        want = brute_language(counts, text)
        best = max(sorted(want), key=lambda k: want[k])
        assert model.predict(text)[0] == best
        assert abs(sum(float(model.of_word(w)[0] - model.of_word(w)[1]) for w in language_id.words(text)) - (want["a"] - want["b"])) < 1e-9


def test_language_awkward_rows(spark):
    table = docs(spark).withColumn("score", F.lit("x"))
    model = language_id.train(table)
    got = language_id.identify(table, model).collect()
    assert len(got) == len(awkward())
    blank = [r for r in got if r["doc_id"] in (0, 1, 2)]
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in blank)
    assert model.predict("123 ... 456_")[0] == "und"
    empty = language_id.train(docs(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(table, empty).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), model).count() == 0


def balanced(got, label):
    rows = got.join(label, "doc_id").where("held_out").select("y", "predicted", "score").collect()
    y, p = np.array([r["y"] for r in rows]), np.array([r["predicted"] for r in rows])
    return (p[y == 1].mean() + (1 - p[y == 0]).mean()) / 2


def test_quality_beats_chance_by_far_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    label = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    assert balanced(registered.QUERIES["op8_quality_knn"](spark, folder), label) >= 0.85


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    label = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    assert balanced(registered.QUERIES["op9_toxicity"](spark, folder), label) >= 0.9


def test_toxic_words_in_few_of_many_rows_vote(spark):
    rng = np.random.default_rng(4)
    plain, common, rare = ([f"{k}{j}" for j in range(n)] for k, n in (("p", 300), ("c", 450), ("r", 30)))
    rows, labels = [], []
    for i in range(6000):
        bad = i % 6 == 0
        own = rng.choice(plain, 12).tolist()
        if bad:  # 120 rows have nothing but a rare word, each of which is in four rows
            own[3] = rare[i // 6 % 30] if i < 720 else ""
            own[5:8] = own[5:8] if i < 720 else rng.choice(common, 3).tolist()
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "toxic", F.lit(True), rows=1500)
    asked = [" ".join([*rng.choice(plain, 11), w]) for w in rare] + [" ".join(rng.choice(plain, 12)) for _ in range(100)]
    got = model.score(pa.array(asked))
    assert (got[:30] >= 0.3).all() and (got[30:] < 0.3).all()


def test_cosine_votes_match_brute_force():
    rng = np.random.default_rng(0)
    x, y = np.abs(rng.standard_normal((60, quality_knn.WIDTH))).astype(np.float32), (rng.random(60) < 0.5).astype(float)
    model = quality_knn.Model(x, y)
    for row in np.abs(rng.standard_normal((5, quality_knn.WIDTH))).astype(np.float32):
        z = (row * model.weight) @ model.axes
        cos = [(float(v @ z / np.linalg.norm(z)), k) for k, v in enumerate(model.vectors)]
        near = sorted(cos, reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(c, 0) ** quality_knn.SHARPNESS for c, _ in near]
        want = sum(a * y[k] for a, (_, k) in zip(w, near)) / sum(w)
        assert abs(model.score(row[None])[0] - want) < 1e-3


def test_label_model_finds_classes_and_shares_weight():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(6)], 1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])
    post, weight = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == truth).mean() > 0.98
    assert weight[0] < 0.8 and weight[-1] < 0.8 and weight[3] > 0.8
    assert (((np.hstack([votes, np.ones((4000, 1))]) @ toxicity.linear(votes, post)) > 0) == truth).mean() > 0.97


def test_classifiers_take_awkward_rows(spark):
    table = docs(spark).withColumn("y", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, int(i < 4)) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (5, None, None), (9999, 0, 0)], "doc_id bigint, quality int, toxic int")
    for module, label in ((quality_knn, "quality"), (toxicity, "toxic")):
        for own in (labels, labels.where("1 = 0")):
            model = module.fit(table, own, label, labelled.remainder(F.col("doc_id"), 5) != 0)
            got = module.score(table, model).collect()
            assert len(got) == len(awkward())
            assert all(0 <= r["score"] <= 1 for r in got)
            assert module.score(docs(spark, []), model).count() == 0


def test_blocks_of_broken_pages():
    read = lambda p: [b.text for b in html_text.read_blocks(p)]
    assert read(None) == read("") == read("<p></p><br>") == []
    assert read("a &amp; b<br>c<p>d<p>e<b>f</b>g<script>x<p>y</script>h<!-- z -->i") == ["a & b c", "d", "efghi"]
    assert read("<div>1<div>2</div>3</div>4&nbsp; 5 &copy &#x41;") == ["1", "2", "3", "4 5 © A"]
    assert read("x < y and 3<4 <p class='a > b' id=q>t</p><a hre") == ["x < y and 3<4", "t"]
    assert read("<p>open <script>never ends") == ["open"]
    assert read("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]


def test_every_word_of_a_long_block_is_in_its_vector():
    words = [f"w{k:03d}" for k in range(200)]
    plain = html_text.vectors([html_text.Block(" ".join(words))])[0]
    for place in range(200):
        other = html_text.vectors([html_text.Block(" ".join(words[:place] + ["zzzz"] + words[place + 1 :]))])[0]
        if html_text._slot("zzzz", html_text.WORDS) != html_text._slot(words[place], html_text.WORDS):
            assert (other != plain).any(), place


def test_labeller_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = html_text.Labeller()
    x, mask = html_text.padded([rng.standard_normal((n, html_text.WIDTH)).astype(np.float32) for n in (3, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss():
        s = np.clip(net.scores(x.astype(np.float64), mask)[0], 1e-9, 1 - 1e-9)
        return float(-((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum())

    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = net.step(x, y, mask)
    for name in net.p:
        at = tuple(int(rng.integers(n)) for n in net.p[name].shape)
        old, d = net.p[name][at], 1e-4
        net.p[name][at] = old + d
        up = loss()
        net.p[name][at] = old - d
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * d) - grads[name][at]) < 1e-3


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id bigint, url string, html string")
    labeller = html_text.train(pages)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, labeller).collect()}
    want = {r["page_id"]: "\n".join(b.text for b in html_text.read_blocks(r["html"]) if html_text.tag_label(b)) for r in pages.collect()}
    assert np.mean([got[k] == want[k] for k in want]) >= 0.99
    assert [r["text"] for r in html_text.extract(odd.withColumn("text", F.lit(1)), labeller).collect()] == ["", "", ""]
    rng, texts = np.random.default_rng(77), [sentence(random.Random(i), 200) for i in range(20)]
    right = total = 0
    for _ in range(120):
        page, truth = html_text.compose(texts, rng)
        blocks = html_text.read_blocks(page)
        assert len(blocks) == len(truth)
        score = labeller.scores(*html_text.padded([html_text.vectors(blocks)]))[0][:, 0]
        right, total = right + int(((score >= 0.5) == truth).sum()), total + len(truth)
    assert right / total >= 0.98


def test_profiles_ignore_row_order():
    texts = [t for _, t, *_ in awkward()]
    whole = quality_knn.profiles(pa.array(texts))
    assert all(np.allclose(quality_knn.profiles(pa.array([t]))[0], whole[k]) for k, t in enumerate(texts))
    assert SCHEMA.startswith("doc_id")
