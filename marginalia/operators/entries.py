"""Entries of containers, without decoding what is in them.

``files`` below is any table of (file_path, content); null content stands for a
file that can't be opened.  A task reads a file's directory once and inflates
only the entries that are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources import archives, container

_ROW = pa.schema([("file_path", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()), ("method", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("error_kind", pa.string()), ("message", pa.string())])
_SCHEMA = "file_path string, ordinal int, name string, method int, size bigint, data binary, error_kind string, message string"
#: Rows are handed on after so many bytes.
FLUSH_BYTES = 16 << 20

Wanted = Callable[[list[container.Entry]], list[tuple[int | None, str, container.Entry | None]]]


def _scan(files: DataFrame, wanted: Wanted, room: int | None = None) -> DataFrame:
    """The entries that ``wanted`` picks from a directory, with their bytes, or the
    error of the file or entry."""

    def one(path: str, data: bytes | None) -> Iterator[dict]:
        try:
            entries = container.opened(path, data)
        except container.ContainerError as e:
            yield {"file_path": path, "error_kind": "file", "message": str(e)}
            return
        for ordinal, name, entry in wanted(entries):
            row = {"file_path": path, "ordinal": ordinal, "name": name}
            if entry is None:
                yield row | {"error_kind": "container", "message": f"Entry not found: {name}"}
                continue
            row |= {"method": entry.method, "size": entry.size}
            try:
                yield row | {"data": container.content(data, entry, room)}
            except container.ContainerError as e:
                yield row | {"error_kind": "container", "message": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for row in one(path.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row.get("data") or b"") + 200
                    if size > FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ROW)

    return archives.bounded(files).select("file_path", "content").mapInArrow(run, _SCHEMA)


def _last(entries: list[container.Entry], name: str) -> list[tuple[int | None, str, container.Entry | None]]:
    at = next((k for k in range(len(entries) - 1, -1, -1) if entries[k].name == name), None)
    return [(at, name, None if at is None else entries[at])]


def has_entry(parts: DataFrame, name: str) -> DataFrame:
    """file_path, found: one row per readable file of ``archives.parse``; an
    expression on the directory that is in its row."""
    return parts.where("error_kind IS NULL OR error_kind <> 'file'").select("file_path", F.exists("entries", lambda e: e["name"] == name).alias("found"))


def read_entry(files: DataFrame, name: str, size_limit: int | None = None) -> DataFrame:
    """The entry called ``name`` of every file, the last of equal names: one row
    per file, with its bytes (``data``) or the error: unreadable file, no such
    entry, unknown method, damage.  With ``size_limit`` an entry that would need
    more bytes is an error and isn't inflated further."""
    return _scan(files, lambda entries: _last(entries, name), size_limit)


def read_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """All entries whose names begin with ``prefix``, in the directory's order, with
    their bytes; of equal names each row has the last one's.  A file that can't be
    read has one row with its error."""
    return _scan(files, lambda entries: [(k, e.name, _last(entries, e.name)[0][2]) for k, e in enumerate(entries) if e.name.startswith(prefix)])
