"""Small corpora with the awkward cases: nulls, empty, very long and repeated texts, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    vocabulary = ["the", "of", "And", "río", "straße", "hill", "stone", "water", "a", "über", "x1", "moon", "river,", "ÉTÉ", "bread.", "42", "lamp", "oak", "fern", "salt"]
    return " ".join(rng.choice(vocabulary) + (str(rng.randrange(400)) if rng.random() < 0.6 else "") for _ in range(n))


def corpus(seed=1, size=60):
    rng = random.Random(seed)
    texts = [sentences(rng, rng.choice([3, 18, 40, 90, 200])) for _ in range(size)]
    passage = sentences(rng, 60)
    for i in range(0, size, 6):
        texts[i] = texts[i] + "\n" + passage + " " + texts[i][:40]
    for i in range(1, 12):  # near copies of one text
        words = texts[0].split(" ")
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [texts[3]] * 9
    texts += [None, "", " \t\n ", "one", "ONE", "same same", "a " * 3000, "*** ### $$$ |||", sentences(rng, 20000), "line\nline\n \nline", "tab\tnew\x0bvt\x0cff\rcr", "<|endoftext|> special", "  two  spaces ", "nbsp word  em", "\x00\x1f control"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, schema=DOCS, partitions=3):
    return spark.createDataFrame(rows, schema).repartition(partitions)


def odd(spark):
    """Rows with null and repeated ids, nulls in every column, and extra columns whose names internals might use."""
    schema = DOCS + ", score double, z binary, n_words string, label string, `_rid` string, kept string"
    rng = random.Random(5)
    text = sentences(rng, 80)
    rows = [(None, text, None, None, None), (7, text, "en", None, 3), (7, text, "en", None, 3), (7, "another text", None, "s", None), (None, None, None, None, None), (8, "", None, None, None), (9, None, None, None, None)]
    return spark.createDataFrame([(*r, 1.0, b"z", None, "L", "r", "k") for r in rows], schema)
