import itertools
import random
import re

import numpy as np

from marginalia.llm import simhash as S
from marginalia.llm import arrow_text
from marginalia.llm.arrow_text import hash_words
from tests.llm.odd import EXTRA, ROWS, SCHEMA, frame, words


def test_golay_code():
    table, n = S.near_codewords()
    assert sorted(set(n.tolist())) == [1, 6] and (n == 6).sum() == 1771
    weights = np.bitwise_count(table[:, 0])
    assert weights.max() <= 4
    errors = np.array([sum(1 << k for k in bits) for w in (1, 2) for bits in itertools.combinations(range(23), w)], np.uint32)
    for s in range(2048):  # any two segments within two bits share an index
        x = table[s, 0]
        own = S.indices(np.array([x]))[1]
        who, index = S.indices(errors ^ x)
        assert set(who[np.isin(index, own)]) == set(range(len(errors)))


def test_votes_are_majorities():
    r = np.random.default_rng(1)
    h, doc = r.integers(0, 1 << 63, 3000).astype(np.uint64), np.sort(r.integers(0, 7, 3000))
    bits = np.unpackbits(S.mix(h ^ S._SEEDS[0]).view(np.uint8)).reshape(-1, 64).astype(int)
    want = np.packbits(np.stack([(2 * bits[doc == d] - 1).sum(0) > 0 for d in range(8)]), axis=1).view(np.uint64)[:, 0]
    assert (S._vote(h, doc, 8, S._SEEDS[0]) == want).all()


def test_word_hashes_tell_the_same_words_apart(monkeypatch):
    texts = ["Alpha beta, ALPHA", None, "", "βeta Beta 12", "x" * 5000 + " alpha", "y" * 99 + "\0" + "y" * 99, "ab " * 90]
    want = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    flat = [w for ws in want for w in ws]
    (a, offs, lens), same = hash_words(texts), np.array([[v == w for v in flat] for w in flat])
    assert np.diff(offs).tolist() == list(map(len, want)) and lens.tolist() == list(map(len, flat))
    assert ((a[:, None] == a) == same).all()
    for window in (2, 3, 10, 64, 257, 5001):  # windows that cut texts and words change nothing
        monkeypatch.setattr(arrow_text, "WINDOW", window)
        b, offs_b, lens_b = hash_words(texts)
        assert (a == b).all() and (offs == offs_b).all() and (lens == lens_b).all()


def near(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = "other" + str(rng.randint(0, 999))
    return " ".join(w)


def corpus():
    rng = random.Random(3)
    rows = [(i, words(i, 150, 3000)) for i in range(150)]
    for i in range(0, 60, 2):
        rows += [(1000 + 10 * i + k, near(rng, rows[i][1], rng.randint(0, 6))) for k in range(rng.randint(1, 4))]
    return rows


def brute(texts):
    fp, some = S.fingerprints(texts)
    pairs = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if some[i] and some[j] and S.alike(fp[i][None], fp[j][None])[0]]
    a, b = (np.array(x, int) for x in zip(*pairs))
    return pairs, S._labels(len(fp), a, b)


def test_groups_against_brute_force(spark):
    rows = corpus()
    pairs, label = brute([t for _, t in rows])
    got = {r["doc_id"]: r for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = sum(rows[i][0] in got and rows[j][0] in got and got[rows[i][0]]["group_id"] == got[rows[j][0]]["group_id"] for i, j in pairs)
    assert len(pairs) > 60 and same >= 0.99 * len(pairs)
    ids = np.array([i for i, _ in rows])
    for d, r in got.items():  # nothing beyond brute force, and the smallest id names the group
        mine = label[np.flatnonzero(ids == d)[0]]
        assert r["group_id"] in ids[label == mine] and r["group_size"] <= (label == mine).sum()
    planted = [d for d, _ in rows if d >= 1000]
    assert sum(d in got for d in planted) >= 0.95 * len(planted)
    assert not any(d % 2 == 1 and d < 150 and d in got for d in ids.tolist())


def test_many_copies_in_one_group(spark):
    rng = random.Random(4)
    base = words(9, 200, 2000)
    rows = [(i, near(rng, base, rng.randint(0, 3))) for i in range(700)] + [(1000 + i, words(100 + i, 100, 3000)) for i in range(50)]
    got = S.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["group_id"], r["group_size"]) for r in got} == {(0, 700)} and len(got) == 700


def test_split_rows_give_the_same(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, S.groups(df).collect()))
    monkeypatch.setattr(S, "ROWS_PER_TASK", 1)
    real = S.links
    monkeypatch.setattr(S, "links", lambda nodes, n: real(nodes, 4096 * 2))
    monkeypatch.setattr(S, "ROWS_PER_TASK", 4)
    assert sorted(map(tuple, S.groups(df).collect())) == want


def test_groups_do_not_depend_on_how_edges_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(map(tuple, S.groups(df).collect()))
    monkeypatch.setattr(S, "EDGES_PER_TASK", 0)
    assert sorted(map(tuple, S.groups(df).collect())) == want and len(want) > 60
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)]
    joined = []
    for most in (0, 10**6):
        monkeypatch.setattr(S, "EDGES_PER_TASK", most)
        joined.append(sorted(map(tuple, S.components(spark.createDataFrame(edges, "a long, b long")).collect())))
    assert joined[0] == joined[1] and (1050, 1000) in joined[0]


def test_odd_rows(spark):
    df = frame(spark)
    got = sorted((r["doc_id"], r["group_id"], r["group_size"]) for r in S.groups(df).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (5, 5, 2), (5, 5, 2)]
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for k, r in enumerate(ROWS) if k not in (1, 7))
    assert all(r[k] == v for r in rows for k, v in EXTRA.items())


def test_null_ids_and_empty_table(spark):
    same = words(8, 60)
    df = spark.createDataFrame([(None, same, None, None), (None, same, None, None), (3, same + " plus", None, None)], SCHEMA)
    assert sorted(r["group_id"] for r in S.groups(df).collect()) == [3, 3, 3]
    assert [r["doc_id"] for r in S.keep_one(df).collect()] == [3]
    none = spark.createDataFrame([], SCHEMA)
    assert S.groups(none).collect() == [] and S.keep_one(none).collect() == []
