"""Comments, threads and statistics of decoded files, one row per file.

A file's comments are an array in its row, so whatever concerns one file is an
expression on that row: no join and no shuffle.  ``files`` below is the result of
``archives.parse`` with ``fields``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import errors, overlaps, zip_entries

__all__ = ["as_json", "author_stats", "by_author", "comments", "corpus_stats", "document_stats", "errors", "find_by_id", "last_of_equal_ids", "overlaps", "replies", "root_comments", "thread", "zip_entries"]
#: The fields that each of these asks of ``archives.parse``.
STATS_FIELDS = ("ordinal", "author", "date", "is_reply", "done")
#: A comment's 18 fields, in their order; four are never filled.
COLUMNS = ("id", "author", "date", "initials", "text", "paragraph_style", "range_start_para_id", "range_end_para_id", "referenced_text", "is_reply", "parent_id", "replies", "para_id", "para_id_parent", "done", "paragraph_index", "run_index", "thread_ids")


def comments(files: DataFrame) -> DataFrame:
    """One row per comment of readable files, with file_path and the fields that
    were asked for.  What is missing in a file is '', -1, false or an empty list."""
    return files.where("error_kind IS NULL").select("file_path", F.inline("comments"))


def full(files: DataFrame) -> DataFrame:
    """comments() of files decoded with all fields: file_path, ordinal, COLUMNS."""
    empty, none = F.lit(""), F.lit(-1)
    fixed = {"range_start_para_id": empty, "range_end_para_id": empty, "paragraph_index": none, "run_index": none}
    return comments(files).withColumns(fixed).select("file_path", "ordinal", *COLUMNS)


def _extreme(pick, dates: Column) -> Column:
    return F.coalesce(pick(F.filter(dates, lambda d: d != "")), F.lit(""))


def document_stats(files: DataFrame) -> DataFrame:
    """One row per readable file, those without comments included (all zero)."""
    c = F.col("comments")
    return files.where("error_kind IS NULL").select(
        "file_path",
        F.size(c).cast("bigint").alias("total_comments"),
        F.size(F.filter(c, lambda x: x.done)).cast("bigint").alias("total_resolved"),
        F.size(F.filter(c, lambda x: x.is_reply)).cast("bigint").alias("total_replies"),
        F.size(F.filter(c, lambda x: ~x.is_reply)).cast("bigint").alias("total_root_comments"),
        F.array_sort(F.array_distinct(c.author)).alias("unique_authors"),
        _extreme(F.array_min, c.date).alias("earliest_date"),
        _extreme(F.array_max, c.date).alias("latest_date"),
    )


def author_stats(files: DataFrame) -> DataFrame:
    """file_path, author, n_comments, n_resolved; one shuffle, of partial sums."""
    return comments(files).groupBy("file_path", "author").agg(F.count(F.lit(1)).alias("n_comments"), F.count_if("done").alias("n_resolved"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """The statistics of all files together, in one row.  Sums are taken per author
    first, in a shuffle of partial sums, so that what meets in the last task is a
    row per author and no set grows beside it; the sorted list of authors, which
    is part of the result, is made of those."""
    date = F.nullif(F.col("date"), F.lit(""))
    per = comments(files).groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("done"), F.count_if("is_reply").alias("replies"), F.min(date).alias("first"), F.max(date).alias("last"))
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), zero).alias("total_comments"), F.coalesce(F.sum("done"), zero).alias("total_resolved"), F.coalesce(F.sum("replies"), zero).alias("total_replies"), F.coalesce(F.sum(F.col("n") - F.col("replies")), zero).alias("total_root_comments"),
        F.array_sort(F.collect_list("author")).alias("unique_authors"), F.coalesce(F.min("first"), F.lit("")).alias("earliest_date"), F.coalesce(F.max("last"), F.lit("")).alias("latest_date"),
    )


def last_of_equal_ids(files: DataFrame, *fields: str) -> DataFrame:
    """file_path, id and ``fields`` of the comment that counts for each id: the
    last of its file.  Within a file's row."""
    placed = F.array_sort(F.transform("comments", lambda c, i: F.struct(c.id.alias("id"), i.alias("at"), c.alias("c"))))
    found = files.where("error_kind IS NULL").select("file_path", placed.alias("placed"))
    last = F.filter("placed", lambda x, i: (i == F.size("placed") - 1) | (F.try_element_at("placed", i + 2)["id"] != x.id))
    return found.select("file_path", F.inline(F.transform(last, lambda x: x.c))).select("file_path", "id", *fields)


def find_by_id(files: DataFrame, ident: int) -> DataFrame:
    """In each file the last comment with that id."""
    hit = F.try_element_at(F.filter("comments", lambda c: c.id == ident), F.lit(-1))
    return files.where("error_kind IS NULL").select("file_path", hit.alias("c")).where("c IS NOT NULL").select("file_path", "c.*")


def by_author(files: DataFrame, author: str) -> DataFrame:
    return comments(files).where(F.col("author") == author)


def root_comments(files: DataFrame) -> DataFrame:
    return comments(files).where(~F.col("is_reply"))


def replies(files: DataFrame) -> DataFrame:
    """file_path, id and replies of every comment that has direct replies."""
    return comments(files).where(F.size("replies") > 0).select("file_path", "id", "replies")


def thread(files: DataFrame, root: int | None = None) -> DataFrame:
    """Comments of a thread (or of all) in its order: root_id, position and the
    comment's columns.  Unknown ids and those of replies have no thread.  Asks for
    the field thread_ordinals, which are places in the file's array."""
    found = files.where("error_kind IS NULL").select("file_path", "comments")
    if root is None:
        roots = found.select("file_path", F.explode(F.filter("comments", lambda c: F.size(c.thread_ordinals) > 0)).alias("r"), "comments")
    else:
        hit = F.try_element_at(F.filter("comments", lambda c: c.id == root), F.lit(-1))
        roots = found.select("file_path", hit.alias("r"), "comments").where("size(r.thread_ordinals) > 0")
    members = F.transform(F.col("r.thread_ordinals"), lambda i: F.col("comments")[i])
    return roots.select("file_path", F.col("r.id").alias("root_id"), F.posexplode(members).alias("position", "c")).select("file_path", "root_id", "position", "c.*")


def as_json(files: DataFrame) -> DataFrame:
    """file_path, ordinal and the comment as a JSON object of its 18 fields."""
    return full(files).select("file_path", "ordinal", F.to_json(F.struct(*COLUMNS)).alias("json"))
