import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import comments as ops
from marginalia.operators import entries
from marginalia.plans import corpus
from marginalia.sources import archives, container, document
from tests.make import archive, f0

FILES = [("a/one", b"first"), ("a/two", b"x" * 5000), ("b", b""), ("a/one", b"last")]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"{name}{int(wide)}", container.pack(FILES, method, wide=wide)) for name, method in (("stored", 0), ("deflated", 8), ("odd", 12)) for wide in (False, True)]
    return spark.createDataFrame([*rows, ("gone", None), ("void", b""), ("junk", b"x" * 100)], "file_path string, content binary").cache()


def rows(df, *names):
    return {r["file_path"]: tuple(r[n] if n != "data" or r[n] is None else bytes(r[n]) for n in names) for r in df.collect()}


def test_one_entry(files):
    got = rows(entries.read_entry(files, "a/one"), "ordinal", "data", "error_kind", "message")
    for wide in "01":
        assert got[f"stored{wide}"] == got[f"deflated{wide}"] == (3, b"last", None, None)
        assert got[f"odd{wide}"] == (3, None, "container", "Unsupported compression method 12 in: a/one")
    assert got["gone"] == (None, None, "file", "Cannot open file: gone") and got["void"][3] == "mmap failed: void" and got["junk"][2] == "file"
    assert {v[:2] for k, v in rows(entries.read_entry(files, "none"), "error_kind", "message").items() if k[-1] in "01"} == {("container", "Entry not found: none")}


def test_size_limit(files):
    for limit, fits in ((4999, False), (5000, True), (6000, True)):
        got = rows(entries.read_entry(files, "a/two", limit), "data", "message")
        for wide in "01":
            assert got[f"stored{wide}"] == ((b"x" * 5000, None) if fits else (None, "Buffer too small for stored entry: a/two"))
            assert got[f"deflated{wide}"] == ((b"x" * 5000, None) if fits else (None, "inflate failed (-5) for: a/two"))


def test_prefix(files):
    got = entries.read_prefix(files, "a/").where("file_path = 'deflated1'").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], r["size"], bytes(r["data"])) for r in got] == [(0, "a/one", 4, b"last"), (1, "a/two", 5000, b"x" * 5000), (3, "a/one", 4, b"last")]
    assert entries.read_prefix(files, "").where("file_path = 'stored0'").count() == 4
    assert [r["message"] for r in entries.read_prefix(files, "zzz").collect()] and entries.read_prefix(files, "zzz").where("error_kind IS NULL").count() == 0


def test_has_entry_and_padding(files):
    parts = archives.parse(files, ())
    assert rows(entries.has_entry(parts, "b"), "found") == {f"{n}{w}": (True,) for n in ("stored", "deflated", "odd") for w in "01"}
    assert {v for v, in rows(entries.has_entry(parts, "c"), "found").values()} == {False}
    short = container.Entry("s", 0, 0, 3, 6, 0)
    data = container.pack([("s", b"abc")])
    assert container.content(data, short) == b"abc\0\0\0" and container.content(data, short, 10) == b"abc"


def test_last_of_equal_ids_and_corpus_stats(spark):
    some = archive([(1, "P1", "a"), (2, "P2", "b"), (1, "P3", "c"), (3, "", "d"), (2, "P4", "e"), (1, "P5", "f")])
    files = archives.parse(spark.createDataFrame([("x", some), ("y", f0()), ("z", archive([]))], "file_path string, content binary"), fields=archives.ALL_FIELDS)
    got = {(r["file_path"], r["id"]): r["text"] for r in ops.last_of_equal_ids(files, "text").collect()}
    assert {k: v for k, v in got.items() if k[0] == "x"} == {("x", 1): "f", ("x", 2): "e", ("x", 3): "d"} and len(got) == 6
    one = ops.corpus_stats(files).first()
    each = ops.document_stats(files).collect()
    for k in ("total_comments", "total_resolved", "total_replies", "total_root_comments"):
        assert one[k] == sum(r[k] for r in each)
    assert one["unique_authors"] == sorted({a for r in each for a in r["unique_authors"]}) and one["latest_date"] == max(r["latest_date"] for r in each)
    none = ops.corpus_stats(files.where(F.lit(False))).first()
    assert none["total_comments"] == 0 and none["unique_authors"] == [] and none["earliest_date"] == ""


def test_written_files_are_read(spark, tmp_path):
    found = corpus.written(spark.createDataFrame([("p", f0(8)), ("q", b"junk")], "file_path string, content binary"), f"file://{tmp_path}/out")
    got = archives.read_paths(spark, found, fields=("id",))
    assert {r["file_path"].rpartition("/")[2]: r["error_kind"] for r in got.collect()} == {"p.docx": None, "q.docx": "file"}


def test_paths_are_dealt_to_all_tasks(spark, tmp_path):
    """Paths are few bytes, so by their size they'd all go to one task."""
    (tmp_path / "a.docx").write_bytes(f0(8))
    names = spark.createDataFrame([(f"{tmp_path}/a.docx",), *[(f"{tmp_path}/none_{k % 400}.docx",) for k in range(800)]], "file_path string")
    got = archives.read_paths(spark, names, fields=("id",)).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 401 and sum(r["error_kind"] is None for r in got) == 1
    assert len({r["task"] for r in got}) == 4


def test_opened_files_are_handed_on_together(tmp_path):
    names = pa.record_batch([pa.array([f"{tmp_path}/none_{k}.docx" for k in range(1500)])], ["file_path"])
    assert [b.num_rows for b in archives._Decoder((), ("id",)).paths(iter([names]))] == [1000, 500]


def test_decoded_rows_are_handed_on_by_their_inflated_size():
    text = archive([(0, "", "x" * 1_500_000)])
    small = container.pack([(n.name, container.content(text, n)) for n in container.directory(text)], 8)
    batch = pa.record_batch([pa.array([f"f{k}" for k in range(8)]), pa.array([small] * 8, pa.binary())], ["file_path", "content"])
    got = list(archives._Decoder((document.COMMENTS,), ("text",)).files(iter([batch])))
    assert len(small) < 10_000 and [b.num_rows for b in got] == [3, 3, 2]


def test_archives_are_written_before_the_batch_is_read_through():
    """A batch has as many rows as Spark likes; few of them are held as objects."""
    done = []
    batch = pa.record_batch([pa.array(range(5000))], ["k"])
    out = archives.packed(iter([batch]), lambda k: done.append(k) or (f"f{k}", b"x" * 10_000))
    first = next(out)
    assert first.num_rows == len(done) == archives.FLUSH_BYTES // 10_000 + 1
    assert sum(b.num_rows for b in out) + first.num_rows == 5000 and done == list(range(5000))


class _Sizes(archives._Decoder):
    def files(self, batches):
        return (self.batch([{"file_path": str(b.nbytes), "comments": []}]) for b in batches)


def test_batches_are_counted_by_bytes(spark, monkeypatch):
    """A task's rows go to Python a few megabytes at a time, however many it has."""
    monkeypatch.setattr(archives, "_Decoder", _Sizes)
    files = spark.range(0, 300, 1, 1).selectExpr("'f' AS file_path", "CAST(repeat('x', 100000) AS BINARY) AS content")
    sizes = [int(r[0]) for r in archives.parse(files, (), ("id",)).select("file_path").collect()]
    assert sum(sizes) >= 30_000_000 and max(sizes) < 9_000_000


def test_a_session_keeps_its_own_size_of_batches(spark):
    own, other = spark.newSession(), spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    for s, size in ((own, "1m"), (other, str(archives.BATCH_BYTES))):
        archives.bounded(s.range(1))
        assert s.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size
