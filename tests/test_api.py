import pytest

from marginalia.api import BatchParser, DocxParser, to_dict, to_json
from marginalia.errors import DocxFileError, DocxFormatError, DocxParserError
from marginalia.operators import comments as ops
from marginalia.sources import archives, container, document
from marginalia.streaming import ingest
from tests.make import archive, f0


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.docx").write_bytes(f0(8))
    (tmp_path / "b.docx").write_bytes(b"no archive at all, but long enough")
    (tmp_path / "c.docx").write_bytes(container.pack([(document.COMMENTS, b"")]))
    (tmp_path / "d.txt").write_bytes(f0())
    return tmp_path


def test_one_document(spark, folder):
    p = DocxParser(spark)
    with pytest.raises(DocxParserError):
        p.comments()
    p.parse(str(folder / "a.docx"))
    assert [r["id"] for r in p.comments()] == [0, 1, 2] and p.find_by_id(9) is None and p.find_by_id(1)["author"] == "Ivo Brandt"
    assert [r["id"] for r in p.thread(0)] == [0, 1, 2] and len(p.by_author("Nora Quill")) == 2 and len(p.root_comments()) == 1
    assert p.stats()["total_comments"] == 3
    d = to_dict(p.comments()[0])
    assert len(d) == 18 and d["replies"][0]["id"] == 1 and "Ivo" in to_json(p.comments()[0])
    with pytest.raises(DocxFileError, match="Cannot open file"):
        p.parse("/nonexistent/path/file.docx")
    with pytest.raises(DocxFormatError) as caught:
        p.parse(str(folder / "c.docx"))
    assert isinstance(caught.value, ValueError) and issubclass(DocxFileError, OSError)


def test_many_documents(spark, folder):
    a, b = str(folder / "a.docx"), str(folder / "b.docx")
    p = BatchParser(2, spark).parse_all([a, a, b, "/missing.docx"])
    assert len(p.comments(a)) == 3 and p.stats(a)["total_replies"] == 2 and p.df.count() == 3
    assert set(p.errors()) == {b, "/missing.docx"}
    with pytest.raises(DocxParserError, match="File not parsed"):
        p.comments(b)
    p.release(a)
    with pytest.raises(DocxParserError):
        p.stats(a)
    assert len(p.errors()) == 2
    p.release_all()


def test_files_parsed_again(spark, folder):
    a, c = str(folder / "a.docx"), str(folder / "d.txt")
    p = BatchParser(spark=spark).parse_all([a, c])
    assert p.df.count() == 6 and p.errors() == {}
    (folder / "a.docx").write_bytes(archive([(7, "P", "new")]))
    p.parse_all([a, "/missing.docx"])
    assert [r["text"] for r in p.comments(a)] == ["new"] and p.df.count() == 4 and p.stats(a)["total_comments"] == 1
    assert p.errors_df.count() == 1 and p.errors() == {"/missing.docx": "Cannot open file: /missing.docx"}
    p.release(a)
    assert p.df.count() == 3 and len(p.comments(c)) == 3
    with pytest.raises(DocxParserError, match="File not parsed"):
        p.stats(a)
    p.release(c)
    with pytest.raises(DocxParserError, match="No document"):
        p.df  # noqa: B018
    p.parse_all([a])
    assert len(p.comments(a)) == 1
    p.release_all()


def test_glob_and_stream(spark, folder, tmp_path_factory):
    files = archives.read_glob(spark, str(folder), fields=("id",))
    assert files.count() == 3 and ops.comments(files).count() == 3
    out = str(tmp_path_factory.mktemp("out"))
    decoded = ingest.stream(spark, str(folder))
    for name in ("first", "again"):  # a second run finds nothing new
        q = ingest.write_comments(decoded, out, f"{out}/checkpoint")
        assert q.awaitTermination(120), name
        assert spark.read.parquet(f"{out}/comments").count() == 3
    assert spark.read.parquet(f"{out}/errors").count() == 2
