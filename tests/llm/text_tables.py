"""Small tables with what goes wrong: nulls, empty and long texts, ties, repeated rows, extra columns with any name."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row_id", "fp", "h", "size", "block", "group", "spans", "score", "features", "label", "part", "taken", "kept", "n", "h_", "words")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def hard_rows(seed=1):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = [
        (1, passage, "en", "a/x", 5), (2, passage, "en", "b", None), (2, passage, "en", "b", None), (3, None, None, None, None),
        (4, "", "de", "a/x", 0), (5, " \t\n\x0b\x0c\r ", "de", "c", 7), (6, "one", "en", "a/y", 3), (7, "Ünë dœux trois", "fr", "b", 9),
        (None, passage + " tail", "en", None, 1), (None, passage + " tail", "en", None, 1), (8, "x " * 3000, "en", "b", 6000),
        (9, prose(rng, 40) + "\n" + passage + "\t" + prose(rng, 40), "en", "c", 1), (10, prose(rng, 30_000, 5000), "en", "a/x", 1),
        (11, "a b a b a b a b a b a b a b a b a b a b a b a b a b a b", "en", "c", 1),
        (12, "b a b a b a b a b a b a b a b a b a b a b a b a b a b a", "en", "c", 1), (13, "x " * 20 + "y", "en", "c", 1),
    ]
    for i in range(20, 90):
        w = prose(rng, rng.randrange(1, 120)).split()
        if i % 3 == 0:
            w = passage.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
        if i % 5 == 0:
            k = rng.randrange(20)
            w[3:3] = passage.split()[k : k + rng.randrange(8, 30)]
        rows.append((i, " ".join(w), "en", f"s{i % 4}", len(w)))
    return rows


def hard_docs(spark, rows=None):
    df = spark.createDataFrame(hard_rows() if rows is None else rows, DOCS)
    return df.withColumns({name: F.lit(name) for name in EXTRA})


def same(rows, expected):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expected, key=key)
