import os

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import queries as library

SF = "/root/testdata/sf0.001"


def text(v):
    return "~" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        files = f"{folder}/{t}.parquet" + "/*.parquet" * os.path.isdir(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    df = library.QUERIES[name](spark, folder)
    want = con.sql(library.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(text, r)) for r in df.collect()) == sorted(tuple(text(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name, SF)


@pytest.fixture(scope="module")
def with_nulls(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, and odd letters."""
    out = tmp_path_factory.mktemp("tables")
    turns = [(c, t, r, x) for c in range(5) for t, r, x in [(0, "user", "first é & <b> \"q\""), (1, None, None), (2, "assistant", ""), (3, "user", "long " * 200)]]
    turns += [(None, 0, "user", "lost"), (7, None, "user", "lost"), (8, 0, None, None), (None, None, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{out}/conversations.parquet")
    spark.createDataFrame([(0, "anchor " * 60, "en", "s", 1), (1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (3, "日本" * 99, "ja", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, None, None), (1, "http://a/?b=1&c", "<p>é&amp;</p>"), (2, "", "x" * 3000), (3, "u", ""), (None, "lost", "lost"), (5, "v", "y" * 3000)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["anchor_text", "author_stats", "batch_errors", "comments_every_field", "corpus_stats", "duplicate_ids_last_wins", "entity_roundtrip", "open_files", "thread_expand", "zip_has_entry", "zip_read_entry", "zip_read_into", "zip_read_prefix"])
def test_nulls_equal_sql(spark, with_nulls, name):
    compare(spark, name, with_nulls)


def test_registration():
    assert set(library.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
