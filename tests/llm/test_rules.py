import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from marginalia.llm import arrow_text, rules
from tests.llm.odd import EXTRA, ROWS, SCHEMA, frame, words


def rows():
    good = [(i, words(i, 80), "en", f"h{i % 5}") for i in range(60)]
    bad = [(100 + i, words(i, 40).upper().replace(" ", "!! "), "en", "h9") for i in range(6)]
    piped = [(200 + i, words(i, 40).replace(" ", " | "), "en", "h8") for i in range(6)]
    same = [(300 + i, "spam " * 50, "en", None) for i in range(3)]
    return [*good, *bad, *piped, *same, *ROWS]


def test_equals_sql(spark):
    out = rules.judge(spark.createDataFrame(rows(), SCHEMA))
    names = ["doc_id", "source", "hard_fails", "soft_fails", "host_docs", "host_fails", "host_rate", "keep"]
    got = sorted(str([None if r[c] is None else round(r[c], 9) if c == "host_rate" else r[c] for c in names]) for r in out.collect())
    documents = pd.DataFrame(rows(), columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    documents["n_chars"] = 0
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({rules.SQL})").fetchall()
    assert got == sorted(str([None if v is None else round(v, 9) if c == "host_rate" else v for c, v in zip(names, r)]) for r in want)


def test_bad_hosts_and_clean_documents(spark):
    """Some ids occur twice, with other texts."""
    kept = {(r["doc_id"], r["text"]): r["keep"] for r in rules.judge(spark.createDataFrame(rows(), SCHEMA)).collect()}
    text = {r[0]: r[1] for r in rows()}  # the later of equal ids
    assert all(kept[i, text[i]] for i in [*range(10, 60), 1, 2, 5, 6])
    assert not any(kept[i, text[i]] for i in (100, 101, 300, 301, 4, 7))


def test_measures_in_windows(monkeypatch):
    texts = ["one one | two\tTWO  three", None, "", " ", "\0x x\0", "A" * 90 + " " + "A" * 90, "d\u00e9 \n d\u00e9 d\u00e9 \U0001f600!!", "same " * 40]
    want = rules.measures(texts)
    assert want[:, 2].tolist() == [len(re.findall("[^ \t\n\r]+", t or "")) for t in texts] and want[:, 0].tolist() == [len(t or "") for t in texts]
    assert want[:, 7].tolist() == [sum(a == b for a, b in zip(w, w[1:])) for w in (re.findall("[^ \t\n\r]+", t or "") for t in texts)]
    for window in (2, 3, 7, 41, 91):
        monkeypatch.setattr(arrow_text, "WINDOW", window)
        assert (rules.measures(texts) == want).all()


def test_rules_run_once(spark, tmp_path, monkeypatch):
    """One pass of Python over the texts, then what was written is read."""
    seen = tmp_path / "seen"
    monkeypatch.setattr(rules, "counts", _logged(rules.counts, str(seen)))
    df = spark.createDataFrame(rows(), SCHEMA)
    got = rules.stage(spark, df, "").count()
    assert 60 < got < len(rows()) and len(seen.read_text().splitlines()) == len(rows())


def _logged(counts, path):
    def wrapped(text):
        @F.udf("string")
        def log(t):
            with open(path, "a") as f:
                f.write("x\n")
            return t

        return counts(log(text))

    return wrapped


def test_prior_by_hand(spark):
    flags = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 1), ("b", 0), (None, 0), (None, 0)], "host string, soft_fails int")
    got = {r["host"]: r["host_rate"] for r in rules.host_rates(flags).collect()}
    m, v = 1 / 3, ((0.25 - 1 / 3) ** 2 + (0.75 - 1 / 3) ** 2 + (1 / 3) ** 2) / 2
    s = m * (1 - m) / v - 1
    want = {"a": (1 + m * s) / (4 + s), "b": (3 + m * s) / (4 + s), None: m * s / (2 + s)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    single = rules.host_rates(flags.where("host = 'a'")).first()
    assert abs(single["host_rate"] - 2 / 6) < 1e-9


def test_odd_rows(spark):
    df = frame(spark)
    kept = rules.stage(spark, df, "")
    assert kept.columns == df.columns
    got = kept.collect()
    assert all(r[k] == v for r in got for k, v in EXTRA.items())
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5", "5", "6", "8", "9", "None"]
    none = spark.createDataFrame([], SCHEMA)
    assert rules.judge(none).collect() == [] and rules.stage(spark, none, "").collect() == []
