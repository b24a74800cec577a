"""Small rows with the awkward cases that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=5):
    """Nulls in every column, empty, blank, short and long texts, exact and near copies, shared passages."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 300), sentence(rng, 40)
    texts = [None, "", "   \n\t", "one", "one two three", base, base, base.upper().lower() + " ", passage]
    for k in range(12):
        near = base.split()
        near[rng.randrange(300)] = f"x{k}"
        texts.append(" ".join(near))
    texts += [f"{sentence(rng, 30)} {passage}\n{sentence(rng, 30)}" for _ in range(12)]
    texts += ["same " * 60, "a\x0bb\x0cc d   e\u0085f", sentence(rng, 6000), "Ünï cödé " * 20, "AAA BBB CCC DDD EEE FFF"]
    texts += [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", len(t) if t and i % 7 else None) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[20], (None, base, "en", "s", 3), (None, None, None, None, None)]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
