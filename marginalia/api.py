"""Two facades over the DataFrames: one document, or many."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import DocxParserError, raised
from .operators import comments as ops
from .sources import archives, document
from .sources.staging import stage

_ORDER = ("id", "ordinal")


class _Tables:
    """Decoded files, kept in memory or on disk."""

    def __init__(self, files: DataFrame):
        self.files = files.persist()
        self.stats = ops.document_stats(self.files)

    @property
    def comments(self) -> DataFrame:
        return ops.full(self.files)

    def release(self) -> None:
        self.files.unpersist()


class DocxParser:
    """Comments of one document.

    ``parse`` replaces what was there before.  A document without comments is no
    error: it has no rows, and statistics with its path and zeros."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._tables: _Tables | None = None

    def parse(self, path: str) -> DocxParser:
        if self._tables:
            self._tables.release()
            self._tables = None
        tables = _Tables(archives.read_paths(self.spark, [path], fields=archives.ALL_FIELDS))
        failed = ops.errors(tables.files).first()
        if failed:
            tables.release()
            raise raised(failed["error_kind"], failed["message"])
        self._tables = tables
        return self

    @property
    def df(self) -> DataFrame:
        if self._tables is None:
            raise DocxParserError("No document was parsed")
        return self._tables.comments

    def comments(self) -> list[Row]:
        return self.df.orderBy(*_ORDER).collect()

    def stats(self) -> Row:
        self.df  # noqa: B018 - raises if nothing was parsed
        return self._tables.stats.first()

    def find_by_id(self, ident: int) -> Row | None:
        return self.df.where(F.col("id") == ident).orderBy(F.desc("ordinal")).first()

    def by_author(self, author: str) -> list[Row]:
        return self.df.where(F.col("author") == author).orderBy(*_ORDER).collect()

    def root_comments(self) -> list[Row]:
        return self.df.where(~F.col("is_reply")).orderBy(*_ORDER).collect()

    def thread(self, root: int) -> list[Row]:
        self.df  # noqa: B018 - raises if nothing was parsed
        return ops.thread(self._tables.files, root).orderBy("position").collect()


class BatchParser:
    """Comments of many documents; a file that fails leaves an error and nothing else.

    ``max_threads`` is the number of partitions that the paths are dealt to, 0 for
    Spark's own choice.  Results of a path parsed again replace the old ones;
    errors stay until the object goes.  Which file is where stays in the decoded
    tables: the driver holds a handle for each call of ``parse_all`` and the paths
    that were released one by one."""

    def __init__(self, max_threads: int = 0, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.max_threads = max_threads
        self._tables: list[tuple[_Tables, list[str]]] = []
        self._failed: DataFrame | None = None

    def parse_all(self, paths: list[str]) -> BatchParser:
        tables = _Tables(archives.read_paths(self.spark, list(paths), partitions=self.max_threads or None, fields=archives.ALL_FIELDS))
        failed = stage(ops.errors(tables.files))
        self._failed = failed if self._failed is None else self._failed.unionByName(failed)
        self._tables.append((tables, []))
        return self

    def _good(self) -> list[tuple[_Tables, DataFrame]]:
        """The tables, the latest first, each with those of its files that count."""
        out, later = [], None
        for tables, gone in reversed(self._tables):
            files = tables.files.where("error_kind IS NULL")
            files = files.where(~F.col("file_path").isin(gone)) if gone else files
            out.append((tables, files if later is None else files.join(later, "file_path", "left_anti")))
            names = files.select("file_path")
            later = names if later is None else later.unionByName(names)
        return out

    def _of(self, path: str) -> DataFrame:
        for tables, gone in reversed(self._tables):
            mine = tables.files.where((F.col("file_path") == path) & F.col("error_kind").isNull())
            if path not in gone and mine.head(1):
                return mine
        raise DocxParserError(f"File not parsed: {path}")

    @property
    def df(self) -> DataFrame:
        """All comments of all files that are held."""
        out = None
        for _, files in self._good():
            rows = ops.full(files)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise DocxParserError("No document was parsed")
        return out

    @property
    def errors_df(self) -> DataFrame:
        """file_path, error_kind and message of every file that failed."""
        if self._failed is None:
            raise DocxParserError("No document was parsed")
        return self._failed

    def comments(self, path: str) -> list[Row]:
        return ops.full(self._of(path)).orderBy(*_ORDER).collect()

    def stats(self, path: str) -> Row:
        return ops.document_stats(self._of(path)).first()

    def errors(self) -> dict[str, str]:
        """The message of every file that failed, as a dictionary; ``errors_df`` is
        the same for batches whose failures are too many for the driver."""
        return {} if self._failed is None else {r["file_path"]: r["message"] for r in self._failed.collect()}

    def release(self, path: str) -> None:
        """Drops a file's results; its error, if it has one, stays."""
        for _, gone in self._tables:
            gone.append(path)
        for tables, gone in list(self._tables):
            if not tables.files.where(F.col("error_kind").isNull() & ~F.col("file_path").isin(gone)).head(1):
                tables.release()
                self._tables.remove((tables, gone))

    def release_all(self) -> None:
        for tables, _ in self._tables:
            tables.release()
        self._tables = []


def to_dict(row: Row) -> dict:
    """A comment or statistics row as nested plain dictionaries, without the two
    columns that place a comment in its file."""
    out = row.asDict(recursive=True)
    if "ordinal" in out:
        out = {k: v for k, v in out.items() if k not in ("file_path", "ordinal")}
    return out


def to_json(row: Row) -> str:
    return json.dumps(to_dict(row), ensure_ascii=False)


PARTS = document.PARTS
