"""Documents as a distributed source: one row per file, decoded exactly once.

A file is opened by the task that decodes it, a damaged one becomes a row with
its error, and the parts asked for are the only ones inflated: leave out
``word/document.xml``, usually the largest, if no anchor text is wanted."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import container, document, markup

_COMMENT = [("ordinal", pa.int32()), ("id", pa.int32()), *((k, pa.string()) for k in ("author", "date", "initials", "text", "paragraph_style", "para_id"))]
ARROW = pa.schema(
    [
        ("file_path", pa.string()),
        ("error_kind", pa.string()),
        ("message", pa.string()),
        ("comments", pa.list_(pa.struct(_COMMENT))),
        ("comments_ex", pa.list_(pa.struct([("ordinal", pa.int32()), ("para_id", pa.string()), ("para_id_parent", pa.string()), ("done", pa.bool_())]))),
        ("comment_ids", pa.list_(pa.struct([("ordinal", pa.int32()), ("id", pa.int32()), ("para_id", pa.string())]))),
        ("anchors", pa.list_(pa.struct([("id", pa.int32()), ("anchor_text", pa.string())]))),
        ("entries", pa.list_(pa.struct([("ordinal", pa.int32()), ("name", pa.string()), ("method", pa.int32()), ("compressed_size", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64())]))),
    ]
)
SCHEMA = (
    "file_path string, error_kind string, message string, "
    "comments array<struct<ordinal:int,id:int,author:string,date:string,initials:string,text:string,paragraph_style:string,para_id:string>>, "
    "comments_ex array<struct<ordinal:int,para_id:string,para_id_parent:string,done:boolean>>, comment_ids array<struct<ordinal:int,id:int,para_id:string>>, "
    "anchors array<struct<id:int,anchor_text:string>>, entries array<struct<ordinal:int,name:string,method:int,compressed_size:bigint,size:bigint,crc32:bigint>>"
)
_REPLY = pa.struct([("id", pa.int32()), ("author", pa.string()), ("date", pa.string()), ("text_snippet", pa.string())])
#: Fields of a resolved comment: name, Arrow type and Spark type.
FIELDS = (
    *((k, t, "int" if t == pa.int32() else "string") for k, t in _COMMENT),
    ("referenced_text", pa.string(), "string"),
    ("is_reply", pa.bool_(), "boolean"),
    ("parent_id", pa.int32(), "int"),
    ("replies", pa.list_(_REPLY), "array<struct<id:int,author:string,date:string,text_snippet:string>>"),
    ("para_id_parent", pa.string(), "string"),
    ("done", pa.bool_(), "boolean"),
    ("thread_ids", pa.list_(pa.int32()), "array<int>"),
    ("thread_ordinals", pa.list_(pa.int32()), "array<int>"),
)
#: Rows are handed on after so many bytes, inflated parts included, or so many
#: rows: what a task holds depends neither on its size nor on that of Spark's batches.
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 1000
#: Bytes of an Arrow batch that goes to Python, in a session that doesn't say how many.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Files of a list that one task opens.
PATHS_PER_TASK = 500


class _Decoder:
    """Turns (path, bytes) into batches: the parts as they are, or, given the names
    of fields, comments with those fields."""

    def __init__(self, parts: tuple[str, ...], fields: tuple[str, ...] | None):
        self.parts, self.fields = parts, fields
        if fields is None:
            self.arrow, self.spark = ARROW, SCHEMA
        else:
            own = [f for f in FIELDS if f[0] in fields]
            if len(own) != len(set(fields)):
                raise ValueError(f"unknown fields: {set(fields) - {f[0] for f in FIELDS}}")
            self.arrow = pa.schema([*[ARROW.field(k) for k in ("file_path", "error_kind", "message")], ("comments", pa.list_(pa.struct([(n, t) for n, t, _ in own])))])
            self.spark = "file_path string, error_kind string, message string, comments array<struct<" + ",".join(f"{n}:{t}" for n, _, t in own) + ">>"

    def row(self, path: str, data: bytes | None) -> tuple[dict, int]:
        """A file's row, and the bytes that were read and inflated for it."""
        out = document.rows(path, data, self.parts)
        size = len(data or b"") + sum(e["size"] for e in out["entries"] if e["name"] in self.parts)
        if self.fields is not None:
            out["comments"] = [{k: c[k] for k in self.fields} for c in document.resolve(out)]
            for k in ("comments_ex", "comment_ids", "anchors", "entries"):
                del out[k]
        return out, size

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=self.arrow)

    def _batches(self, found: Iterator[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, data in found:
            row, n = self.row(path, data)
            held.append(row)
            size += n
            if size > FLUSH_BYTES or len(held) >= FLUSH_ROWS:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self._batches((path.as_py(), content.as_py()) for b in batches for path, content in zip(b.column(0), b.column(1), strict=True))

    def paths(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self._batches((path, _load(path)) for b in batches for path in b.column(0).to_pylist())


ALL_FIELDS = tuple(f[0] for f in FIELDS)


def parse(files: DataFrame, parts: tuple[str, ...] = document.PARTS, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Decodes ``files`` (file_path, content); one row per row.  Null content
    stands for a file that can't be opened.

    Without ``fields`` the rows hold the parts as they are (SCHEMA).  With names of
    FIELDS, they hold the comments, put together from all parts, in an array
    ``comments`` of just those fields: no plan above a Python function can tell it
    what isn't needed."""
    d = _Decoder(parts, fields)
    return bounded(files).select("file_path", "content").mapInArrow(d.files, d.spark)


def read_paths(spark: SparkSession, paths: list[str] | DataFrame, parts: tuple[str, ...] = document.PARTS, partitions: int | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Decodes the files of a list, or of a DataFrame with a column file_path;
    equal paths are read once.  Paths are kept as given and may be missing.

    A list is dealt to ``partitions``, or to as many as give each task up to
    PATHS_PER_TASK files; a DataFrame to ``partitions``, or to as many as a shuffle
    has, of a number that is set: by their bytes a million paths would go to a
    few tasks.  Sizes aren't asked for beforehand: that would open every
    file once more, on the driver; for folders, ``read_glob`` lists them with sizes."""
    if not isinstance(paths, DataFrame):
        distinct = list(dict.fromkeys(paths))
        paths = spark.createDataFrame([(p,) for p in distinct], "file_path string")
        partitions = partitions or max(spark.sparkContext.defaultParallelism, -(-len(distinct) // PATHS_PER_TASK))
    todo = paths.select("file_path")
    if partitions:
        todo = todo.dropDuplicates().repartition(partitions)
    else:
        todo = todo.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "file_path").dropDuplicates()

    d = _Decoder(parts, fields)
    return todo.mapInArrow(d.paths, d.spark)


def filesystem(path: str) -> tuple:
    """The filesystem of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _load(path: str | None) -> bytes | None:
    """A file's bytes by path or URI; None if it can't be opened."""
    try:
        if re.match(r"\w+:/", path or ""):
            system, name = filesystem(path)
            with system.open_input_file(name) as f:
                return f.read()
        if not path or os.path.isdir(path):
            return None
        with open(path, "rb") as f:
            return f.read()
    except (OSError, ValueError, pa.ArrowInvalid):
        return None


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session sends rows to Python in batches of BATCH_BYTES, or one
    larger row.  Spark's own 64 MB are held whole by each of an executor's workers,
    of which a chain of two steps has two a core.  A session that was given a
    value keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def packed(batches: Iterator[pa.RecordBatch], one: Callable[..., tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """What ``one`` makes of each row, as batches of file_path and content.  Rows
    become Python's one at a time; a batch of thousands never does at once."""
    held, size = [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            held.append(one(*(x.as_py() for x in row)))
            size += len(held[-1][1])
            if size > FLUSH_BYTES or len(held) >= FLUSH_ROWS:
                yield _contents(held)
                held, size = [], 0
    if held:
        yield _contents(held)


def _contents(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], ["file_path", "content"])


def read_glob(spark: SparkSession, path: str, parts: tuple[str, ...] = document.PARTS, pattern: str = "*.docx", fields: tuple[str, ...] | None = None) -> DataFrame:
    """Decodes all files below ``path`` that match; Spark lists and splits them by size."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse(found.select(F.col("path").alias("file_path"), "content"), parts, fields)


def _comments_part(turns: list[dict]) -> bytes:
    rows = []
    for t in turns:
        half = len(t["text"]) // 2
        para = f' w14:paraId="{t["para_id"]}"' if t["para_id"] else ""
        style = f'<w:pPr><w:pStyle w:val="{t["style"]}"/></w:pPr>' if t["style"] else ""
        runs = "".join(f'<w:r><w:t xml:space="preserve">{markup.escape(x)}</w:t></w:r>' for x in (t["text"][:half], t["text"][half:]))
        rows.append(f'<w:comment w:id="{t["id"]}" w:author="{markup.escape(t["author"])}" w:date="{t["date"]}" w:initials="{markup.escape(t["initials"])}"><w:p{para}>{style}{runs}</w:p></w:comment>')
    return ('<?xml version="1.0" encoding="UTF-8"?><w:comments>' + "".join(rows) + "</w:comments>").encode("utf-8", "surrogatepass")


def build(turns: list[dict], anchors: list[tuple[str, object]], method: int) -> bytes:
    """A document archive.  ``turns`` hold id, author, date, initials, text, style,
    para_id, parent, done and ids_para_id; ``anchors`` are ("start", id), ("text",
    text) and ("end", id) in the order of the body."""
    ex = "".join(f'<w15:commentEx w15:paraId="{t["para_id"]}"' + (f' w15:paraIdParent="{t["parent"]}"' if t["parent"] else "") + f' w15:done="{int(t["done"])}"/>' for t in turns if t["para_id"])
    ids = "".join(f'<w16cid:commentId w16cid:id="{t["id"]}" w16cid:paraId="{t["ids_para_id"]}"/>' for t in turns if t["ids_para_id"])
    body = []
    for what, value in anchors:
        if what == "text":
            body.append(f"<w:r><w:t>{markup.escape(value)}</w:t></w:r>")
        else:
            body.append(f'<w:commentRange{"Start" if what == "start" else "End"} w:id="{value}"/>')
    files = [("[Content_Types].xml", b"<Types/>"), (document.COMMENTS, _comments_part(turns)), (document.EXTENDED, f"<w15:commentsEx>{ex}</w15:commentsEx>".encode())]
    if ids:
        files.append((document.IDS, f"<w16cid:commentsIds>{ids}</w16cid:commentsIds>".encode()))
    files.append((document.BODY, ("<w:document><w:body><w:p>" + "".join(body) + "</w:p></w:body></w:document>").encode("utf-8", "surrogatepass")))
    return container.pack(files, method)
