import os

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from marginalia.llm import decontaminate, pii, rules, simhash, spm
from tests.llm.odd import SCHEMA, frame
from tests.llm.test_decontaminate import brute as contained


SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(spm.MODEL), reason="no tables here")


def test_against_brute_force(spark):
    """Each stage worked out plainly, on the rows that the one before it left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {i for (i,) in con.sql(f"SELECT doc_id FROM ({rules.SQL}) WHERE keep").fetchall()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    fp, some = simhash.fingerprints([t for _, t in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if some[i] and some[j] and simhash.alike(fp[i][None], fp[j][None])[0]]
    label = simhash._labels(len(rows), *(np.array(x, int) for x in zip(*pairs))) if pairs else np.arange(len(rows))
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in contained(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    masked = dict(rows)
    for r in sorted(pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: -r["start"]):
        t = masked[r["doc_id"]]  # from the last span to the first
        masked[r["doc_id"]] = f"{t[: r['start']]}[{r['kind'].upper()}]{t[r['end'] :]}"
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(r["decoded"] == masked[i] and r["ids"] == library.encode(masked[i]) and len(r["ids"]) == r["n_tokens"] for i, r in got.items())
    assert not any("@mail" in r["decoded"] for r in got.values()) and any(masked[i] != t for i, t in rows)


def test_intermediate_tables_go(spark):
    from marginalia.llm import shared

    before = shared.cut(spark.range(3))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + f"/marginalia-{spark.sparkContext.applicationId}"
    there = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(folder)) - there) == 1  # the last stage's input
    assert out.count() > 50 and before.count() == 3


def test_stages_bear_odd_rows(spark):
    df = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df2 = stage(spark, df, SF)
        assert df2.columns == df.columns
        df = df2
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()) == ["1", "5", "6", "8", "9", "None"]
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []
    assert len(corpus_pipeline.STAGES) == 5 and decontaminate.THRESHOLD == 0.6
