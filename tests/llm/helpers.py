"""Small document tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Every input that operators must take: null and empty texts, one word, ties, repeated rows, null keys, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, "é" * 300), (7, "a" * 1000), (8, "a" * 1000), (None, "no key"),
        (None, None),
    (9, "x\ny\n"), (10, "\n"), (11, "漢字かな 😀 ﬁ Straße İ"), (12, "Ünïcode, words. And more!"), (13, "nul\0byte"), (14, "<|endoftext|> text"),
        (15, "tab\tand\r\nlines"),
]


def table(spark, rows):
    """With columns beside doc_id and text, some of which have names that operators use themselves."""
    full = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    d = spark.createDataFrame(full, SCHEMA)
    return d.selectExpr("*", "'own' AS shard", "1 AS kept", "'x' AS h", "2 AS row", "3 AS n", "0 AS t", "5 AS k")


def prose(n, seed=0, words=300, vocabulary=2000):
    rng = random.Random(seed)
    names = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, words)):
            text.append(names[int(vocabulary * rng.random() ** 3)] + rng.choice(["", "", "", "", ",", ".", ".\n"]))
        out.append(" ".join(text))
    return out


def edited(text, seed, every=25):
    """A near copy: some words changed."""
    rng = random.Random(seed)
    return " ".join(w if rng.randrange(every) else w + "x" for w in text.split(" "))
