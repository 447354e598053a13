"""Rows that operators must bear: nulls anywhere, empty and long texts, repeated
rows, and extra columns named like the operators' own."""

import random

EXTRA = {k: "x" for k in ("n", "stays", "node", "root", "row", "bucket", "block", "hash", "hashes", "k", "size", "levels", "text_hash", "code", "start", "end", "keep", "host", "host_rate", "hard_fails", "__rules", "__host", "__bad", "__own", "__id", "shard", "ids", "decoded", "span", "label", "words", "item_id", "a.b")}


def words(seed, n, size=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(size)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


LONG = words(5, 60_000, 4000)
ROWS = [
    (1, words(1, 120), "en", "a"),
    (2, words(1, 120), "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (None, words(2, 50), None, "b"),
    (None, None, None, None),
    (5, words(3, 80), "fr", "c"),
    (5, words(3, 80), "fr", "c"),
    (6, LONG, "fr", None),
    (7, "  \n\t ", "en", "a"),
    (8, "…!?", "en", "a"),
    (9, "Ünïcödé 😀 \U0001f1e9 á ﬁ 0", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=ROWS):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def key(r):
    return tuple((v is not None, str(v)) for v in r)
