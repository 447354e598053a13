import random
import re

import numpy as np
import pytest

from marginalia.llm import decontaminate as D
from tests.llm.odd import EXTRA, LONG, ROWS, SCHEMA, frame, words


def grams(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(docs, items):
    out = []
    for i, t in items:
        k = min(D.SHINGLE, grams(t, 1)[1])
        if k:
            own = grams(t, k)[0]
            for d, text in docs:
                n = len(own & grams(text, k)[0])
                if n >= D.THRESHOLD * len(own):
                    out.append((d, i, n, len(own)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    items = [(i, words(500 + i, rng.randint(1, 60), 3000)) for i in range(40)]
    items += [(90, None), (91, ""), (92, "…"), (0, items[1][1]), (1, items[1][1])]
    docs = []
    for d in range(120):
        w = words(d, int(10 ** rng.uniform(1, 3.6)), 3000).split()
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:40])[1].split()
            if rng.random() < 0.5:
                part = part[: max(1, int(len(part) * rng.uniform(0.4, 1)))]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((d, (" ".join(w)).upper() if d % 7 == 0 else " ".join(w)))
    return docs, items


def found(df):
    return sorted(((r["doc_id"], r["item_id"], r["shared"], r["size"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("share", [4_000_000, 300])
def test_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(D, "FILTER_KEYS", share)
    docs, items = corpus()
    got = found(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert len(set(want)) > 60 and set(got) <= set(want) and len(set(got)) >= 0.99 * len(set(want)) and len(got) == len(set(got))


def test_signatures_are_minima():
    r = np.random.default_rng(0)
    h, owner = np.sort(r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)), np.zeros(500, int)
    for bits in (0, 1, 4, 9):
        least = D._least_of_bin(h, owner, np.full(500, bits))
        bins = h >> np.uint64(64 - bits) if bits else np.zeros(500, np.uint64)
        assert [h[bins == b].min() for b in np.unique(bins)] == h[least].tolist()


def test_common_phrases_make_no_pairs(spark, monkeypatch):
    """Texts and items that share only a phrase: no candidate comes of it, and what
    is a candidate is compared along the shorter list."""
    phrase = "which of the following is true"
    items = [(i, f"{phrase} {words(700 + i, 40, 3000)}") for i in range(300)]
    docs = [(d, f"{phrase} {words(5000 + d, 45, 3000)}") for d in range(300)]
    docs += [(1000 + i, f"{words(9000 + i, 50, 3000)} {items[i][1]}") for i in range(0, 300, 10)]
    pairs = []
    real = D.candidates

    def counted(found, shingles):
        out = real(found, shingles)
        pairs.extend(r["doc_id"] for r in out.collect())
        return out

    monkeypatch.setattr(D, "candidates", counted)
    got = found(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) == 30
    assert min(pairs) >= 1000 and len(pairs) <= 30 * 300  # none of a document that holds no item


def test_many_items_in_one_document(spark):
    items = [(i, words(700 + i, 5 + i % 60, 3000)) for i in range(200)]
    docs = [(1, " ".join(t for _, t in items)), (2, items[7][1]), (3, "nothing of it " * 40)]
    assert found(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_odd_rows(spark):
    item = " ".join(LONG.split()[59_000:59_030])
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (None, words(1, 120), "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    df = frame(spark)
    assert found(D.contaminated(df, items)) == sorted([(6, 1, 28, 28), *[(d, None, n, n) for d in (1, 2) for n in [len(grams(words(1, 120), 3)[0])]]], key=str)
    clean = D.clean(df, items)
    assert clean.columns == df.columns
    rows = clean.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS if r[0] not in (1, 2, 6))
    assert all(r[k] == v for r in rows for k, v in EXTRA.items())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(docs, one).collect() == [] and D.contaminated(frame(spark), items).collect() == []
    assert D.clean(docs, one).collect() == [] and D.clean(frame(spark), items).count() == len(ROWS)
