"""Comments and their threads where the parts of files come as separate tables.

The joins of ``marginalia.sources.document.resolve``, as relations: for parts that
were decoded earlier or elsewhere, and as its independent check.  Every join is
within a file, so every key starts with ``file_path``.  Where files are decoded
here, ``marginalia.operators.comments`` needs none of these shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import truncate_utf8
from marginalia.sources import archives, document
from marginalia.sources.document import ANCHOR_BYTES, SNIPPET_BYTES

_THREADS = pa.schema([("file_path", pa.string()), ("ordinal", pa.int32()), ("thread_ids", pa.list_(pa.int32()))])
REPLY = "array<struct<id:int,author:string,date:string,text_snippet:string>>"


def raw(parts: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array column of readable files."""
    return parts.where("error_kind IS NULL").select("file_path", F.inline(column))


def errors(parts: DataFrame) -> DataFrame:
    """file_path, error_kind, message: one row per file that couldn't be read."""
    return parts.where("error_kind IS NOT NULL").select("file_path", "error_kind", "message")


def zip_entries(parts: DataFrame) -> DataFrame:
    """The directory of every file whose container is readable."""
    return parts.select("file_path", F.inline("entries"))


def _is_last(*keys: str):
    return F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("file_path", *keys))


def flags(parts: DataFrame) -> DataFrame:
    """Comments with their own attributes, paragraph ids, done flags and parents:
    everything but lists."""
    # a key is null where the row has nothing to look up
    c = raw(parts, "comments").withColumn("last_id", _is_last("id")).withColumn("ex_key", F.when((F.col("para_id") != "") & _is_last("para_id"), F.col("para_id")))
    # resolution state: the last entry per paragraph id, for the last comment with it
    ex = raw(parts, "comments_ex").groupBy("file_path", F.col("para_id").alias("ex_key")).agg(F.max_by(F.struct("para_id_parent", "done"), "ordinal").alias("ex"))
    c = c.join(ex, ["file_path", "ex_key"], "left").withColumns({"para_id_parent": F.coalesce("ex.para_id_parent", F.lit("")), "done": F.coalesce("ex.done", F.lit(False))}).drop("ex_key", "ex")
    # only now the fallback ids: the k-th entry of an id fills the k-th comment without one
    empty = F.col("para_id") == ""
    nth = F.row_number().over(Window.partitionBy("file_path", "id", empty).orderBy("ordinal"))
    c = c.withColumn("slot", F.when(empty, nth))
    ids = raw(parts, "comment_ids").where("para_id <> ''").withColumn("slot", F.row_number().over(Window.partitionBy("file_path", "id").orderBy("ordinal")))
    ids = ids.select("file_path", "id", "slot", F.col("para_id").alias("given"))
    c = c.join(ids, ["file_path", "id", "slot"], "left").withColumn("para_id", F.coalesce("given", "para_id")).drop("slot", "given")
    # parents, by paragraph ids as they are now
    c = c.withColumn("parent_key", F.nullif("para_id_parent", F.lit("")))
    target = c.where("para_id <> ''").groupBy("file_path", F.col("para_id").alias("parent_key")).agg(F.max_by("id", "ordinal").alias("parent_id"))
    c = c.join(target, ["file_path", "parent_key"], "left").drop("parent_key")
    return c.withColumns({"is_reply": F.col("parent_id").isNotNull(), "parent_id": F.coalesce("parent_id", F.lit(-1))})


def replies(c: DataFrame) -> DataFrame:
    """file_path, id, replies: the direct replies of a comment, in file order."""
    ref = F.struct("ordinal", "id", "author", "date", truncate_utf8(F.col("text"), SNIPPET_BYTES).alias("text_snippet"))
    grouped = c.where("is_reply AND parent_id >= 0").groupBy("file_path", F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(ref)).alias("refs"))
    return grouped.select("file_path", "id", F.transform("refs", lambda r: F.struct(r.id.alias("id"), r.author.alias("author"), r.date.alias("date"), r.text_snippet.alias("text_snippet"))).alias("replies"))


#: Rows and ids of threads after which they are handed on.
FLUSH_ROWS, FLUSH_IDS = 10_000, 1_000_000


def _threads(rows: list[dict]) -> list[tuple[int, list[int]]]:
    """ordinal and thread_ids of the roots among a file's comments."""
    rows = sorted((r["ordinal"], r["id"], r["parent_id"], r["is_reply"]) for r in rows)
    below: dict[int, list[int]] = {}
    for _, ident, parent, reply in rows:
        if reply and parent >= 0:
            below.setdefault(parent, []).append(ident)
    unique = len({r[1] for r in rows}) == len(rows)
    return [(ordinal, document.closure(ident, below, unique)) for ordinal, ident, _, reply in rows if not reply]


def _thread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Threads of files that come as rows of file_path and its comments; a file's
    comments become Python's one file at a time."""

    def batch() -> pa.RecordBatch:
        columns = zip(held, _THREADS, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in columns], schema=_THREADS)

    held, ids = ([], [], []), 0
    for b in batches:
        for path, rows in zip(*b.columns, strict=True):
            for ordinal, thread in _threads(rows.as_py()):
                for x, v in zip(held, (path.as_py(), ordinal, thread), strict=True):
                    x.append(v)
                ids += len(thread)
                if ids >= FLUSH_IDS or len(held[0]) >= FLUSH_ROWS:
                    yield batch()
                    held, ids = ([], [], []), 0
    if held[0]:
        yield batch()


def thread_ids(c: DataFrame) -> DataFrame:
    """file_path, ordinal, thread_ids for every root: the whole closure of its
    replies, level by level, whatever its depth."""
    files = c.groupBy("file_path").agg(F.collect_list(F.struct("ordinal", "id", "parent_id", "is_reply")).alias("rows"))
    return archives.bounded(files).mapInArrow(_thread_batches, "file_path string, ordinal int, thread_ids array<int>")


def anchors(parts: DataFrame) -> DataFrame:
    return raw(parts, "anchors").select("file_path", "id", truncate_utf8(F.col("anchor_text"), ANCHOR_BYTES).alias("referenced_text"))


def comments(parts: DataFrame) -> DataFrame:
    """One row per comment with all its fields.  What is missing is '', -1, false
    or an empty list, never null.  What is looked up by id goes to the last
    comment of that id in its file."""
    c = flags(parts)
    looked_up = c.withColumn("id_key", F.when(F.col("last_id"), F.col("id")))
    lists = replies(c).withColumnRenamed("id", "id_key")
    texts = anchors(parts).withColumnRenamed("id", "id_key")
    out = looked_up.join(lists, ["file_path", "id_key"], "left").join(texts, ["file_path", "id_key"], "left").join(thread_ids(c), ["file_path", "ordinal"], "left")
    none = F.lit("")
    return out.select(
        "file_path", "ordinal", "id", "author", "date", "initials", "text", "paragraph_style",
        none.alias("range_start_para_id"), none.alias("range_end_para_id"), F.coalesce("referenced_text", none).alias("referenced_text"),
        "is_reply", "parent_id", F.coalesce("replies", F.array().cast(REPLY)).alias("replies"), "para_id", "para_id_parent", "done",
        F.lit(-1).alias("paragraph_index"), F.lit(-1).alias("run_index"), F.coalesce("thread_ids", F.array().cast("array<int>")).alias("thread_ids"),
    )


def overlaps(events: DataFrame) -> DataFrame:
    """The relational form of range accumulation over rows of (file_path, seq,
    what, id, text): each range gets the text of the runs that end inside it."""
    start = events.where("what = 'start'").select("file_path", "id", F.col("seq").alias("s"))
    end = events.where("what = 'end'").select("file_path", "id", F.col("seq").alias("e"))
    run = events.where("what = 'text'").select("file_path", "seq", "text")
    ranges = start.join(end, ["file_path", "id"]).where("s < e")
    inside = ranges.join(run, ["file_path"]).where("seq BETWEEN s AND e")
    return inside.groupBy("file_path", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("anchor_text"))
