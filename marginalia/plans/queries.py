"""The library's queries over the driver's tables, and their SQL.

Each makes archives from the tables, decodes them by the ordinary path and asks
something of the result; the SQL asks the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.api import BatchParser
from marginalia.operators import comments as ops
from marginalia.operators import entries, relational
from marginalia.sources import archives, document
from marginalia.sources.staging import shared_path, stage

from . import corpus

NO_BODY = (document.COMMENTS, document.EXTENDED, document.IDS)
ONLY_COMMENTS = (document.COMMENTS,)
SIZE_LIMIT = 1000


def _files(spark: SparkSession, sf_dir: str, *fields: str, parts: tuple[str, ...] = NO_BODY) -> DataFrame:
    return archives.parse(corpus.conversations(spark, sf_dir, document.BODY in parts), parts, fields)


def _list(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def comments_all(spark, sf_dir):
    files = _files(spark, sf_dir, "id", "author", "date", "initials", "text", "paragraph_style", "para_id", parts=ONLY_COMMENTS)
    return ops.comments(files)


def comments_full(spark, sf_dir):
    c = ops.full(_files(spark, sf_dir, *archives.ALL_FIELDS, parts=document.PARTS))
    return c.withColumns({"n_replies": F.size("replies"), "n_thread": F.size("thread_ids")}).drop("replies", "thread_ids")


def comments_relational(spark, sf_dir):
    """The same by relations over the parts as separate tables, decoded once."""
    parts = stage(archives.parse(corpus.conversations(spark, sf_dir)))
    c = relational.comments(parts)
    return c.withColumns({"n_replies": F.size("replies"), "n_thread": F.size("thread_ids")}).drop("replies", "thread_ids")


def comments_by_author(spark, sf_dir):
    return ops.by_author(_files(spark, sf_dir, "id", "author", "text"), "user").select("file_path", "id", "text")


def comment_by_id(spark, sf_dir):
    return ops.find_by_id(_files(spark, sf_dir, "id", "author", "text"), 0)


def root_comments(spark, sf_dir):
    return ops.root_comments(_files(spark, sf_dir, "id", "author", "date", "is_reply")).select("file_path", "id", "author", "date")


def replies_with_parent(spark, sf_dir):
    c = ops.comments(_files(spark, sf_dir, "id", "author", "replies", "para_id"))
    return c.select("file_path", F.col("id").alias("parent_id"), F.col("author").alias("parent_author"), F.col("para_id").alias("para_id_parent"), F.inline("replies")).select("file_path", "id", "parent_id", "author", "parent_author", "para_id_parent")


def reply_refs(spark, sf_dir):
    r = ops.replies(_files(spark, sf_dir, "id", "replies"))
    return r.select("file_path", "id", F.array_join(F.transform("replies", lambda x: F.concat_ws("|", x.id.cast("string"), x.author, x.date, x.text_snippet)), "~").alias("replies"))


def thread_ids(spark, sf_dir):
    c = ops.comments(_files(spark, sf_dir, "id", "thread_ids"))
    return c.where("size(thread_ids) > 0").select("file_path", "id", _list("thread_ids"))


def thread_expand(spark, sf_dir):
    return ops.thread(_files(spark, sf_dir, "id", "author", "thread_ordinals")).select("file_path", "root_id", "position", "id", "author")


def resolved_comments(spark, sf_dir):
    return ops.comments(_files(spark, sf_dir, "id", "para_id", "done")).where("done").select("file_path", "id", "para_id")


def document_stats(spark, sf_dir):
    s = ops.document_stats(_files(spark, sf_dir, *ops.STATS_FIELDS))
    return s.withColumn("unique_authors", F.array_join("unique_authors", ","))


def author_stats(spark, sf_dir):
    return ops.author_stats(_files(spark, sf_dir, "author", "done"))


def corpus_stats(spark, sf_dir):
    return ops.corpus_stats(_files(spark, sf_dir, *ops.STATS_FIELDS)).withColumn("unique_authors", F.array_join("unique_authors", ","))


def anchor_text(spark, sf_dir):
    c = ops.comments(_files(spark, sf_dir, "id", "referenced_text", parts=document.PARTS))
    return c.where("referenced_text <> ''")


def anchor_text_relational(spark, sf_dir):
    """Anchors cut by the built-in expression."""
    return relational.anchors(archives.parse(corpus.conversations(spark, sf_dir), (document.COMMENTS, document.BODY)))


def ids_fallback(spark, sf_dir):
    fields = ("id", "para_id", "is_reply", "parent_id", "done")
    return ops.comments(archives.parse(corpus.without_paragraph_ids(spark, sf_dir), NO_BODY, fields))


def duplicate_ids_last_wins(spark, sf_dir):
    """Of equal ids the one that lookups find."""
    files = archives.parse(corpus.equal_ids(spark, sf_dir), NO_BODY, ("id", "author", "text"))
    return ops.last_of_equal_ids(files, "author", "text")


def overlapping_ranges(spark, sf_dir):
    parts = archives.parse(corpus.overlapping(spark, sf_dir), (document.COMMENTS, document.BODY))
    return relational.raw(parts, "anchors").select("file_path", "id", "anchor_text")


def entity_roundtrip(spark, sf_dir):
    c = ops.comments(archives.parse(corpus.pages(spark, sf_dir), ONLY_COMMENTS, ("author", "text")))
    return c.select(F.substring("file_path", 6, 40).cast("bigint").alias("page_id"), F.col("author").alias("url"), F.col("text").alias("html"))


def zip_entries(spark, sf_dir):
    return ops.zip_entries(archives.parse(corpus.conversations(spark, sf_dir, False), ())).select("file_path", "ordinal", "name", "method")


def zip_prefix_scan(spark, sf_dir):
    files = archives.parse(corpus.conversations(spark, sf_dir, False), ())
    return files.select("file_path", F.size(F.filter("entries", lambda e: e["name"].startswith("word/"))).cast("bigint").alias("n_parts"))


def zip_has_entry(spark, sf_dir):
    """Which archives have a part that only some do."""
    return entries.has_entry(archives.parse(corpus.without_paragraph_ids(spark, sf_dir), ()), document.IDS)


def zip_read_entry(spark, sf_dir):
    """Stored and deflated entries, of ZIP and ZIP64 containers; the last of equal names."""
    files = corpus.bundles(spark, sf_dir)
    found = entries.read_entry(files, "page/url").unionByName(entries.read_entry(files, "page/none"))
    return found.select("file_path", "ordinal", "name", "method", F.decode("data", "UTF-8").alias("text"), "message")


def zip_read_into(spark, sf_dir):
    """Entries of up to SIZE_LIMIT bytes; larger ones are errors."""
    found = entries.read_entry(corpus.bundles(spark, sf_dir), "page/html", SIZE_LIMIT)
    return found.select("file_path", F.decode("data", "UTF-8").alias("html"), "error_kind", "message")


def zip_read_prefix(spark, sf_dir):
    """All entries below a name, inflated."""
    found = entries.read_prefix(corpus.bundles(spark, sf_dir), "page/")
    return found.select("file_path", "ordinal", "name", "size", F.decode("data", "UTF-8").alias("text"))


def _name(path: str = "file_path") -> F.Column:
    return F.regexp_extract(path, r"([^/]+)\.docx$", 1)


def _on_disk(spark, sf_dir: str) -> DataFrame:
    """Paths of files that are there, and of as many that aren't."""
    folder = shared_path(spark)
    there = stage(corpus.written(corpus.conversations(spark, sf_dir, False), folder))
    return there.unionByName(there.select(F.regexp_replace("file_path", r"\.docx$", "_gone.docx").alias("file_path")))


def open_files(spark, sf_dir):
    """Files opened by their paths; those that can't be opened leave an error."""
    files = archives.read_paths(spark, _on_disk(spark, sf_dir), NO_BODY, fields=("id", "is_reply"))
    n = F.when(F.col("error_kind").isNull(), F.size("comments")).cast("bigint")
    return files.select(_name().alias("file_name"), "error_kind", F.regexp_replace("message", r": .*/([^/]+)\.docx$", ": $1").alias("message"), n.alias("n_comments"))


def batch_parser(spark, sf_dir):
    """The facade for many files, as DataFrames of comments and errors."""
    paths = [r["file_path"] for r in _on_disk(spark, sf_dir).collect()]  # the facade takes a list
    batch = BatchParser(spark=spark).parse_all(paths)
    rows = batch.df.select(_name().alias("file_name"), "id", "author", "text")
    return rows.unionByName(batch.errors_df.select(_name().alias("file_name"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("author"), "error_kind").withColumnRenamed("error_kind", "text"))


def unreadable_ids(spark, sf_dir):
    """Comments whose ids are no numbers are left out."""
    return ops.comments(archives.parse(corpus.unreadable_ids(spark, sf_dir), ONLY_COMMENTS, ("ordinal", "id", "author", "text")))


def batch_errors(spark, sf_dir):
    return ops.errors(archives.parse(corpus.damaged(spark, sf_dir), NO_BODY, ops.STATS_FIELDS))


def batch_results(spark, sf_dir):
    files = archives.parse(corpus.damaged(spark, sf_dir), NO_BODY, ops.STATS_FIELDS)
    return ops.document_stats(files).select("file_path", "total_comments", "total_replies", "total_resolved")


def comments_json(spark, sf_dir):
    j = ops.as_json(_files(spark, sf_dir, *archives.ALL_FIELDS))
    fields = ("id", "author", "date", "text", "is_reply", "parent_id", "done")
    return j.select("file_path", *[F.get_json_object("json", f"$.{k}").alias(k) for k in fields])


def comments_every_field(spark, sf_dir):
    """All 18 fields of a comment as its JSON object has them, lists included."""
    j = ops.as_json(_files(spark, sf_dir, *archives.ALL_FIELDS, parts=document.PARTS))
    return j.select("file_path", "ordinal", *[F.get_json_object("json", f"$.{k}").alias(k) for k in ops.COLUMNS])


# without an id there is no archive, and without a turn no comment
_CONVERSATIONS = "(SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"
_PAGES = "(SELECT * FROM pages WHERE page_id IS NOT NULL)"
_T = "(SELECT *, 'conv_' || conv_id AS file_path, CAST(turn AS INTEGER) AS id, coalesce(role, '') AS author, '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z' AS date, coalesce(text, '') AS body, lpad(upper(format('{:x}', turn + 1)), 8, '0') AS para FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) t"
_PARENT = "CAST((turn - 1) // 2 AS INTEGER)"


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN strlen({text}) <= {n} THEN {text} ELSE left({text}, list_max(list_filter(range(0, {n} + 1), lambda i: strlen(left({text}, i)) <= {n}))) || '…' END"


_STATS = "count(*) AS total_comments, count(*) FILTER (WHERE turn % 3 = 2) AS total_resolved, count(*) FILTER (WHERE turn > 0) AS total_replies, count(*) FILTER (WHERE turn = 0) AS total_root_comments, array_to_string(list_sort(list_distinct(list(author))), ',') AS unique_authors, min(date) AS earliest_date, max(date) AS latest_date"
_WALK = f"""WITH RECURSIVE t AS (SELECT * FROM {_T}),
  walk AS (SELECT file_path, id, 0 AS depth, [id] AS path, author FROM t WHERE turn = 0
    UNION ALL SELECT t.file_path, t.id, depth + 1, list_append(path, t.id), t.author FROM walk JOIN t ON t.file_path = walk.file_path AND t.turn > 0 AND (t.turn - 1) // 2 = walk.id)"""
_ANCHOR = f"SELECT 'conv_' || doc_id AS file_path, 0 AS id, {_cut('body', 240)} AS referenced_text FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WHERE doc_id IN (SELECT conv_id FROM {_CONVERSATIONS})"

SQL = {
    "comments_all": f"SELECT file_path, id, author, date, upper(left(author, 2)) AS initials, body AS text, CASE WHEN turn % 2 = 0 THEN 'CommentText' ELSE '' END AS paragraph_style, para AS para_id FROM {_T}",
    "comments_full": f"""WITH a AS ({_ANCHOR}), t AS (SELECT * FROM {_T}) SELECT file_path, id AS ordinal, id, author, date, upper(left(author, 2)) AS initials, body AS text, CASE WHEN turn % 2 = 0 THEN 'CommentText' ELSE '' END AS paragraph_style,
      '' AS range_start_para_id, '' AS range_end_para_id, coalesce((SELECT referenced_text FROM a WHERE a.file_path = t.file_path AND a.id = t.id), '') AS referenced_text, turn > 0 AS is_reply, CASE WHEN turn > 0 THEN {_PARENT} ELSE -1 END AS parent_id,
      CAST((SELECT count(*) FROM t r WHERE r.file_path = t.file_path AND r.turn > 0 AND (r.turn - 1) // 2 = t.turn) AS INTEGER) AS n_replies, para AS para_id, CASE WHEN turn > 0 THEN lpad(upper(format('{{:x}}', (turn - 1) // 2 + 1)), 8, '0') ELSE '' END AS para_id_parent, turn % 3 = 2 AS done, -1 AS paragraph_index, -1 AS run_index,
      CAST(CASE WHEN turn = 0 THEN (SELECT count(*) FROM t r WHERE r.file_path = t.file_path) ELSE 0 END AS INTEGER) AS n_thread FROM t""",
    "comments_by_author": f"SELECT file_path, id, body AS text FROM {_T} WHERE author = 'user'",
    "comment_by_id": f"SELECT file_path, id, author, body AS text FROM {_T} WHERE turn = 0",
    "root_comments": f"SELECT file_path, id, author, date FROM {_T} WHERE turn = 0",
    "replies_with_parent": f"WITH t AS (SELECT * FROM {_T}) SELECT t.file_path, t.id, p.id AS parent_id, t.author, p.author AS parent_author, p.para AS para_id_parent FROM t JOIN t p ON p.file_path = t.file_path AND t.turn > 0 AND p.turn = (t.turn - 1) // 2",
    "reply_refs": f"SELECT file_path, {_PARENT} AS id, string_agg(id || '|' || author || '|' || date || '|' || {_cut('body', 120)}, '~' ORDER BY turn) AS replies FROM {_T} WHERE turn > 0 GROUP BY ALL",
    "thread_ids": f"{_WALK} SELECT file_path, 0 AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY depth, path) AS thread_ids FROM walk GROUP BY file_path",
    "thread_expand": f"{_WALK} SELECT file_path, 0 AS root_id, CAST(row_number() OVER (PARTITION BY file_path ORDER BY depth, path) - 1 AS INTEGER) AS position, id, author FROM walk",
    "resolved_comments": f"SELECT file_path, id, para AS para_id FROM {_T} WHERE turn % 3 = 2",
    "document_stats": f"SELECT file_path, {_STATS} FROM {_T} GROUP BY file_path",
    "author_stats": f"SELECT file_path, author, count(*) AS n_comments, count(*) FILTER (WHERE turn % 3 = 2) AS n_resolved FROM {_T} GROUP BY file_path, author",
    "corpus_stats": f"SELECT {_STATS} FROM {_T}",
    "anchor_text": f"SELECT * FROM ({_ANCHOR}) WHERE referenced_text <> ''",
    "anchor_text_relational": _ANCHOR,
    "ids_fallback": f"SELECT file_path, id, para AS para_id, turn > 0 AND turn % 2 = 0 AS is_reply, CASE WHEN turn > 0 AND turn % 2 = 0 THEN {_PARENT} ELSE -1 END AS parent_id, turn % 2 = 0 AND turn % 3 = 2 AS done FROM {_T}",
    "duplicate_ids_last_wins": f"SELECT file_path, CAST(turn // 2 AS INTEGER) AS id, author, body AS text FROM {_T} QUALIFY row_number() OVER (PARTITION BY file_path, turn // 2 ORDER BY turn DESC) = 1",
    "overlapping_ranges": f"SELECT file_path, id, body || coalesce(lead(body) OVER (PARTITION BY file_path ORDER BY turn), '') AS anchor_text FROM {_T}",
    "entity_roundtrip": f"SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM {_PAGES}",
    "zip_entries": f"SELECT 'conv_' || conv_id AS file_path, ordinal, name, CAST(8 AS INTEGER) AS method FROM (SELECT DISTINCT conv_id FROM {_CONVERSATIONS}), (VALUES (0, '[Content_Types].xml'), (1, 'word/comments.xml'), (2, 'word/commentsExtended.xml'), (3, 'word/document.xml')) v(ordinal, name)",
    "zip_prefix_scan": f"SELECT 'conv_' || conv_id AS file_path, CAST(3 AS BIGINT) AS n_parts FROM (SELECT DISTINCT conv_id FROM {_CONVERSATIONS})",
    "zip_has_entry": f"SELECT 'conv_' || conv_id AS file_path, bool_or(turn % 2 = 1) AS found FROM {_CONVERSATIONS} GROUP BY conv_id",
    "zip_read_entry": f"""SELECT 'page_' || page_id AS file_path, CAST(3 AS INTEGER) AS ordinal, 'page/url' AS name, CAST(page_id % 2 * 8 AS INTEGER) AS method, coalesce(url, '') AS text, CAST(NULL AS VARCHAR) AS message FROM {_PAGES}
      UNION ALL SELECT 'page_' || page_id, NULL, 'page/none', NULL, NULL, 'Entry not found: page/none' FROM {_PAGES}""",
    "zip_read_into": f"""SELECT 'page_' || page_id AS file_path, CASE WHEN n <= {SIZE_LIMIT} THEN body END AS html, CASE WHEN n > {SIZE_LIMIT} THEN 'container' END AS error_kind,
      CASE WHEN n <= {SIZE_LIMIT} THEN NULL WHEN page_id % 2 = 0 THEN 'Buffer too small for stored entry: page/html' ELSE 'inflate failed (-5) for: page/html' END AS message
      FROM (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM {_PAGES})""",
    "zip_read_prefix": f"""SELECT 'page_' || page_id AS file_path, CAST(o AS INTEGER) AS ordinal, CASE o WHEN 2 THEN 'page/html' ELSE 'page/url' END AS name,
      CAST(strlen(CASE o WHEN 2 THEN coalesce(html, '') ELSE coalesce(url, '') END) AS BIGINT) AS size, CASE o WHEN 2 THEN coalesce(html, '') ELSE coalesce(url, '') END AS text FROM {_PAGES}, (VALUES (0), (2), (3)) v(o)""",
    "open_files": f"""WITH f AS (SELECT conv_id, count(*) AS n FROM {_CONVERSATIONS} GROUP BY conv_id)
      SELECT 'conv_' || conv_id AS file_name, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS message, n AS n_comments FROM f
      UNION ALL SELECT 'conv_' || conv_id || '_gone', 'file', 'Cannot open file: conv_' || conv_id || '_gone', NULL FROM f""",
    "batch_parser": f"SELECT file_path AS file_name, id, author, body AS text FROM {_T} UNION ALL SELECT DISTINCT 'conv_' || conv_id || '_gone', NULL::INTEGER, NULL::VARCHAR, 'file' FROM {_CONVERSATIONS}",
    "unreadable_ids": f"SELECT file_path, CAST(turn // 2 AS INTEGER) AS ordinal, id, author, body AS text FROM {_T} WHERE turn % 2 = 0",
    "batch_errors": f"""SELECT file_path, CASE WHEN k <= 3 THEN 'file' WHEN k = 4 THEN 'format' ELSE 'container' END AS error_kind,
      CASE k WHEN 1 THEN 'mmap failed: ' || file_path WHEN 2 THEN 'File too small to be a ZIP archive' WHEN 3 THEN 'EOCD signature not found — not a valid ZIP' WHEN 4 THEN 'Failed to parse word/comments.xml' ELSE 'Unsupported compression method 12 in: word/comments.xml' END AS message
      FROM (SELECT DISTINCT 'conv_' || conv_id AS file_path, conv_id % 6 AS k FROM {_CONVERSATIONS}) WHERE k > 0""",
    "batch_results": f"SELECT file_path, count(*) AS total_comments, count(*) FILTER (WHERE turn > 0) AS total_replies, count(*) FILTER (WHERE turn % 3 = 2) AS total_resolved FROM {_T} WHERE conv_id % 6 = 0 GROUP BY file_path",
    "comments_json": f"SELECT file_path, CAST(id AS VARCHAR) AS id, author, date, body AS text, CAST(turn > 0 AS VARCHAR) AS is_reply, CASE WHEN turn > 0 THEN CAST((turn - 1) // 2 AS VARCHAR) ELSE '-1' END AS parent_id, CAST(turn % 3 = 2 AS VARCHAR) AS done FROM {_T}",
}

SQL["comments_relational"] = SQL["comments_full"]
SQL["comments_every_field"] = f"""{_WALK}, a AS ({_ANCHOR}),
  threads AS (SELECT file_path, '[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY depth, path) || ']' AS thread_ids FROM walk GROUP BY file_path),
  refs AS (SELECT file_path, {_PARENT} AS id, '[' || string_agg(CAST(to_json({{'id': id, 'author': author, 'date': date, 'text_snippet': {_cut('body', 120)}}}) AS VARCHAR), ',' ORDER BY turn) || ']' AS replies FROM t WHERE turn > 0 GROUP BY ALL)
  SELECT t.file_path, t.id AS ordinal, CAST(t.id AS VARCHAR) AS id, author, date, upper(left(author, 2)) AS initials, body AS text, CASE WHEN turn % 2 = 0 THEN 'CommentText' ELSE '' END AS paragraph_style, '' AS range_start_para_id, '' AS range_end_para_id,
    coalesce(referenced_text, '') AS referenced_text, CAST(turn > 0 AS VARCHAR) AS is_reply, CASE WHEN turn > 0 THEN CAST({_PARENT} AS VARCHAR) ELSE '-1' END AS parent_id, coalesce(replies, '[]') AS replies, para AS para_id,
    CASE WHEN turn > 0 THEN lpad(upper(format('{{:x}}', (turn - 1) // 2 + 1)), 8, '0') ELSE '' END AS para_id_parent, CAST(turn % 3 = 2 AS VARCHAR) AS done, '-1' AS paragraph_index, '-1' AS run_index, CASE WHEN turn = 0 THEN thread_ids ELSE '[]' END AS thread_ids
  FROM t LEFT JOIN a ON a.file_path = t.file_path AND a.id = t.id LEFT JOIN refs ON refs.file_path = t.file_path AND refs.id = t.id LEFT JOIN threads ON threads.file_path = t.file_path"""

QUERIES = {name: globals()[name] for name in SQL}
