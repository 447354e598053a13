import math
import re
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import lm
from tests.llm.odd import LONG, ROWS, SCHEMA, frame, words


def brute(rows, order, alpha=lm.ALPHA, least=lm.MIN_COUNT):
    docs = [(i, re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows]
    counts = [Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total = sum(counts[0].values())
    out = []
    for i, w in docs:
        s = 0.0
        for at in range(len(w)):
            for k in range(min(order, at + 1), 1, -1):
                gram = tuple(w[at - k + 1 : at + 1])
                if counts[k - 1][gram] >= least:
                    s += math.log(counts[k - 1][gram] / counts[k - 2][gram[:-1]])
                    break
                s += math.log(alpha)
            else:
                s += math.log(counts[0][w[at],] / total)
        out.append((str(i), len(w), round(s, 4)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rows = [(i, words(i % 90, 30 + i % 50, 120)) for i in range(100)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_bytes=3000).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 4)) for r in got) == brute(rows, order)


def test_odd_rows(spark):
    rows = [r[:2] for r in ROWS if r[0] != 9]
    df = frame(spark, [r for r in ROWS if r[0] != 9])
    got = lm.score(df).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 4)) for r in got) == brute(rows, lm.ORDER)
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(LONG.split()) == 60_000


def test_repeated_rows_are_collapsed_and_come_back(spark, monkeypatch):
    rows = [(i, words(i % 90, 30, 120)) for i in range(60)] + [(7, words(3, 40, 120))] * 50 + [(None, words(4, 20, 120))] * 30 + [(8, None), (None, None), (9, "")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []
    real = lm.grams
    for repeats in (10**6, 5):
        monkeypatch.setattr(lm, "REPEATS", repeats)
        got = lm.score(df, order=3, block_bytes=1000).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 4)) for r in got) == brute(rows, 3)
        dealt.append(len(got))
    assert dealt == [len(rows)] * 2 and real is lm.grams


def test_packing():
    r = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        assert (lm._unpack(lm._pack(h)) == h).all()
        for buckets in (1, 3, 64, 100_003):
            b, at = lm._runs_of(h, buckets)
            want = [(int(x) >> 32) * buckets >> 32 for x in h]
            assert np.repeat(b, np.diff(at)).tolist() == want and len(set(b.tolist())) == len(b)


def test_no_words_at_all(spark):
    got = lm.score(spark.createDataFrame([(1, ""), (2, None), (3, "!?")], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["log_score"], r["mean_log_score"]) for r in got} == {(0, 0.0, None)}


def test_trigram_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from marginalia.llm import queries

    rows = [(i, words(i % 90, 30 + i % 50, 120) if i else None) for i in range(200)] + [(7, ""), (8, "one"), (8, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "op4_stupid_backoff_trigram_scores"
    got = [(r["doc_id"], r["n_tokens"], r["log_score"]) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    want = [r[:3] for r in con.sql(queries.oracle_sql()[name]).fetchall()]
    assert len(got) == len(want) == 203
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4
    assert sorted((str(a), b, c) for a, b, c in got) == brute(rows, 3)
