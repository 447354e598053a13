import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import truncate_utf8
from marginalia.operators import comments as ops
from marginalia.operators import relational
from marginalia.sources import archives, container, document
from tests.make import archive, f0

P = "P{}".format
FILES = {
    "f0": f0(),
    "f1": archive([(i, P(i), f"t{i}") for i in range(4)], [(P(0), "", 0), (P(1), P(0), 0), (P(2), P(1), 0), (P(3), P(0), 0)]),
    "f3": archive([(0, P(0), "x"), (1, P(1), "y")], [(P(1), "NONE", 0)]),
    "f4": archive([(0, P(0), "x"), (1, P(1), "y")], [(P(0), P(1), 0), (P(1), P(0), 0)]),
    "f5": archive([(0, P(0), "x")], [(P(0), P(0), 0)]),
    "f6": archive([(5, P(0), "a"), (5, P(1), "b")]),
    "f7": archive([(5, P(0), "a"), (5, P(1), "b")], [(P(1), P(0), 0)]),
    "f8": archive([(0, P(0), "x"), (1, "", "y"), (2, P(2), "z")], [(P(1), P(0), 1), (P(2), P(1), 0)], [(1, P(1))]),
    "f9": archive([(0, P(0), "x"), (1, P(1), "y")], [(P(1), P(0), 1), (P(1), "", 0)]),
    "ids": archive([(1, "", "a"), (1, "", "b"), (2, "", "c")], ids=[(1, "X"), (2, "Z"), (1, "Y"), (9, "W")]),
    "negative": archive([(-3, P(0), "x"), (4, P(1), "y")], [(P(1), P(0), 0)]),
    "deep": archive([(i, P(i), "t") for i in range(300)], [(P(i), P(i - 1) if i else "", 0) for i in range(300)]),
    "none": container.pack([("a", b"b")]),
    "dates": archive([], raw_comments='<c><comment id="0" author="bob" date=""/><comment id="1" author="" date="2024-02"/><comment id="2" author="Ann" date="2024-01"/></c>'),
    "long": archive([(0, P(0), "x"), (1, P(1), "a" * 121), (2, P(2), "a" * 120)], [(P(1), P(0), 0), (P(2), P(0), 0)], body=f'<commentRangeStart id="0"/><r>{"a" * 239}é</r><commentRangeEnd id="0"/>'),
    "bad": b"",
}


@pytest.fixture(scope="module")
def binary(spark):
    return spark.createDataFrame([*FILES.items(), ("missing", None)], "file_path string, content binary").persist()


@pytest.fixture(scope="module")
def files(binary):
    return archives.parse(binary, fields=archives.ALL_FIELDS).persist()


@pytest.fixture(scope="module", params=["in rows", "as relations"])
def table(request, binary, files):
    both = {"in rows": lambda: ops.full(files), "as relations": lambda: relational.comments(archives.parse(binary).persist())}
    rows = both[request.param]().orderBy("file_path", "ordinal").collect()
    return {k: [r for r in rows if r["file_path"] == k] for k in FILES}


def test_canonical(table):
    a, b, c = table["f0"]
    assert (a["is_reply"], a["parent_id"], a["done"], a["thread_ids"], a["para_id_parent"]) == (False, -1, False, [0, 1, 2], "")
    assert (b["is_reply"], b["parent_id"], b["done"], b["thread_ids"], b["para_id_parent"]) == (True, 0, False, [], "7C31E5B1")
    assert (c["is_reply"], c["parent_id"], c["done"]) == (True, 0, True)
    assert a["referenced_text"] == "Loads above forty are carried by two frames." and b["referenced_text"] == ""
    assert [tuple(r) for r in a["replies"]] == [(1, "Ivo Brandt", "2023-11-06T17:40:00Z", "It is in kilograms, I add it."), (2, "Nora Quill", "2023-11-09T07:05:00Z", "Now the table agrees with it.")]
    assert b["replies"] == [] and (a["paragraph_index"], a["run_index"], a["range_start_para_id"], a["range_end_para_id"]) == (-1, -1, "", "")
    assert len(a.asDict()) == 20


def test_threads(table):
    f1 = table["f1"]
    assert [[x["id"] for x in r["replies"]] for r in f1] == [[1, 3], [2], [], []] and f1[0]["thread_ids"] == [0, 1, 3, 2]
    f3 = table["f3"][1]
    assert (f3["is_reply"], f3["parent_id"], f3["para_id_parent"]) == (False, -1, "NONE")
    assert all(r["is_reply"] and r["thread_ids"] == [] for r in table["f4"])
    (f5,) = table["f5"]
    assert f5["is_reply"] and f5["parent_id"] == 0 and [x["id"] for x in f5["replies"]] == [0]
    assert table["f7"][0]["thread_ids"] == [5]
    assert table["deep"][0]["thread_ids"] == list(range(300))
    assert table["negative"][1]["is_reply"] and table["negative"][0]["replies"] == [] and table["negative"][0]["thread_ids"] == [-3]


def test_late_ids(table):
    _, c1, c2 = table["f8"]
    assert (c1["para_id"], c1["is_reply"], c1["done"]) == ("P1", False, False)
    assert (c2["is_reply"], c2["parent_id"]) == (True, 1)
    assert [r["para_id"] for r in table["ids"]] == ["X", "Y", "Z"]
    f9 = table["f9"][1]
    assert (f9["is_reply"], f9["done"], f9["para_id_parent"]) == (False, False, "")


def test_truncated(table):
    root = table["long"][0]
    assert [x["text_snippet"] for x in root["replies"]] == ["a" * 120 + "…", "a" * 120]
    assert root["referenced_text"] == "a" * 239 + "…"


def test_lookups(files):
    f0 = files.where("file_path = 'f0'")
    assert [r["text"] for r in ops.find_by_id(files.where("file_path = 'f6'"), 5).collect()] == ["b"]
    assert ops.find_by_id(f0, 77).count() == 0
    assert [ops.by_author(f0, x).count() for x in ("Nora Quill", "Ivo Brandt", "Nobody")] == [2, 1, 0]
    assert [r["id"] for r in ops.root_comments(f0).collect()] == [0]
    assert [(r["position"], r["id"]) for r in ops.thread(f0, 0).orderBy("position").collect()] == [(0, 0), (1, 1), (2, 2)]
    assert ops.thread(f0, 1).count() == 0 and ops.thread(f0, 99).count() == 0 and ops.thread(f0).count() == 3
    assert [r["text"] for r in ops.thread(files.where("file_path = 'f7'"), 5).collect()] == []  # the last comment of that id is a reply
    assert [r["text"] for r in ops.thread(files.where("file_path = 'f7'")).collect()] == ["b"]
    assert '"id":0' in ops.as_json(f0).where("ordinal = 0").first()["json"]
    assert {r["id"]: len(r["replies"]) for r in ops.replies(f0).collect()} == {0: 2}


def test_statistics(files):
    s = {r["file_path"]: r for r in ops.document_stats(files).collect()}
    f0 = s["f0"]
    assert (f0["total_comments"], f0["total_replies"], f0["total_root_comments"], f0["total_resolved"]) == (3, 2, 1, 1)
    assert (f0["unique_authors"], f0["earliest_date"], f0["latest_date"]) == (["Ivo Brandt", "Nora Quill"], "2023-11-05T08:15:00Z", "2023-11-09T07:05:00Z")
    assert (s["none"]["total_comments"], s["none"]["total_root_comments"], s["none"]["unique_authors"], s["none"]["earliest_date"]) == (0, 0, [], "")
    assert (s["dates"]["earliest_date"], s["dates"]["latest_date"], s["dates"]["unique_authors"]) == ("2024-01", "2024-02", ["", "Ann", "bob"])
    assert s["f4"]["total_replies"] == 2 and "bad" not in s
    assert {r["file_path"]: r["message"] for r in ops.errors(files).collect()} == {"bad": "mmap failed: bad", "missing": "Cannot open file: missing"}
    assert ops.corpus_stats(files).first()["total_comments"] == ops.comments(files).count()
    assert {(r["author"], r["n_comments"]) for r in ops.author_stats(files.where("file_path = 'f0'")).collect()} == {("Nora Quill", 2), ("Ivo Brandt", 1)}


def test_no_shuffle_within_files(files):
    for df in (ops.full(files), ops.document_stats(files), ops.thread(files), ops.find_by_id(files, 1)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_the_fields_asked_for(binary):
    few = archives.parse(binary, fields=("id", "done"))
    assert ops.comments(few).columns == ["file_path", "id", "done"]
    with pytest.raises(ValueError):
        archives.parse(binary, fields=("id", "nothing"))


def test_nothing(spark):
    none = spark.createDataFrame([], "file_path string, content binary")
    files, parts = archives.parse(none, fields=archives.ALL_FIELDS), archives.parse(none)
    assert ops.full(files).collect() == [] and ops.document_stats(files).collect() == [] and ops.errors(files).collect() == [] and relational.comments(parts).collect() == []
    assert ops.corpus_stats(files).first()["total_comments"] == 0


def test_truncation_against_bytes(spark):
    texts = ["", "abc", "é" * 10, "a€b€c", "😀😀😀", "x" * 8, "é€😀" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (0, 1, 2, 3, 5, 7, 8):
        want = [t if len(t.encode()) <= n else t.encode()[:n].decode(errors="ignore") + "…" for t in texts]
        assert [r[0] for r in df.select(truncate_utf8(F.col("t"), n)).collect()] == want


def test_ranges_as_relations(spark):
    rows = [("f", 0, "start", 1, None), ("f", 1, "text", None, "A"), ("f", 2, "start", 2, None), ("f", 3, "text", None, "B"), ("f", 4, "end", 1, None), ("f", 5, "text", None, "C"), ("f", 6, "end", 2, None)]
    got = ops.overlaps(spark.createDataFrame(rows, "file_path string, seq int, what string, id int, text string"))
    assert {r["id"]: r["anchor_text"] for r in got.collect()} == {1: "AB", 2: "BC"}


def test_only_the_parts_asked_for(spark):
    files = spark.createDataFrame([("f0", f0())], "file_path string, content binary")
    row = archives.parse(files, (document.COMMENTS,)).first()
    assert len(row["comments"]) == 3 and row["anchors"] == [] and row["comments_ex"] == [] and len(row["entries"]) == 4


def test_threads_of_many_files_share_a_batch(spark, monkeypatch):
    """Files go to Python together, not in a stream each, and are handed on before all are read."""
    rows = [{"ordinal": k, "id": k, "parent_id": k - 1, "is_reply": k > 0} for k in range(3)]
    type_ = pa.list_(pa.struct([("ordinal", pa.int32()), ("id", pa.int32()), ("parent_id", pa.int32()), ("is_reply", pa.bool_())]))
    batch = pa.record_batch([pa.array([f"f{k}" for k in range(25)]), pa.array([rows[::-1]] * 25, type_)], ["file_path", "rows"])
    monkeypatch.setattr(relational, "FLUSH_ROWS", 10)
    got = list(relational._thread_batches(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in got] == [10, 10, 5] and got[2].to_pylist()[4] == {"file_path": "f24", "ordinal": 0, "thread_ids": [0, 1, 2]}
    monkeypatch.setattr(relational, "FLUSH_IDS", 6)
    assert [b.num_rows for b in relational._thread_batches(iter([batch]))] == [2] * 12 + [1]

    c = spark.createDataFrame([(f"f{f}", k, k, k - 1, k > 0) for f in range(25) for k in range(3)], "file_path string, ordinal int, id int, parent_id int, is_reply boolean")
    threads = relational.thread_ids(c)
    assert "FlatMapGroups" not in threads._jdf.queryExecution().executedPlan().toString()
    assert sorted((r[0], r[1], r[2]) for r in threads.collect()) == sorted((f"f{f}", 0, [0, 1, 2]) for f in range(25))
