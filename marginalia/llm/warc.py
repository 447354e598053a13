"""WARC: a writer of per-record gzip members and a splittable reader.

The reader cuts every file into byte ranges, one task's work each.  A task looks
for the gzip magic in its range, validates a candidate by decoding the member's
WARC header, and owns the records whose member starts inside the range; the last
one is read past the range's end.  No index.  Members may be nested in a stored
payload, so the ranges of a file that has several are walked before, in parallel,
to learn which member reaches into the next; the records are those of one range.
"""

from __future__ import annotations

import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
_CHUNK = 1 << 16
SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, content_type string, content_length long, null_fields string, payload binary"


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def member(record_type: str, record_id: str, payload: bytes, uri: str | None = None, nulls: str = "", content_type: str = "text/html", level: int = 2) -> bytes:
    """One gzip member that holds one record."""
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        if re.search(r"[\x00-\x20\x7f]|^$", uri):
            uri, nulls = urllib.parse.quote(uri), f"{nulls} quoted_uri".strip()
        fields.append(("WARC-Target-URI", uri))
    if nulls:
        fields.append(("X-Null-Fields", nulls))
    fields += [("Content-Type", content_type), ("Content-Length", str(len(payload)))]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(_header(fields)) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


def write(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """Writes ``df`` as .warc.gz files, one per partition, and returns their paths
    and sizes.  A file is named by its partition and renamed into place when
    whole, so a task that runs again replaces it.  Null keys, URIs and bodies are
    marked in the record and come back as nulls; other columns are not written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        filesystem, base = _filesystem(path)
        filesystem.create_dir(base, recursive=True)
        tmp, final = f"{base}/_{part:06d}-{attempt}.tmp", f"{base}/part-{part:06d}.warc.gz"
        n = 0
        with filesystem.open_output_stream(tmp, compression=None) as out:
            n += out.write(member("warcinfo", "<urn:info>", b"software: marginalia\r\n", content_type="application/warc-fields"))
            for b in batches:
                for k, u, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    nulls = " ".join(name for name, v in (("id", k), ("body", t)) if v is None)
                    n += out.write(member("resource", f"<urn:row:{'' if k is None else k}>", (t or "").encode(), u, nulls))
        filesystem.move(tmp, final)
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/part-{part:06d}.warc.gz"], "length": pa.array([n], pa.int64())})

    cols = [F.col(f"`{key}`").cast("string"), F.col(f"`{uri}`").cast("string"), F.col(f"`{body}`").cast("string")]
    files = df.select(*cols).toDF("k", "u", "t").mapInArrow(put, "path string, length long")
    return df.sparkSession.createDataFrame(files.collect(), "path string, length long")


class _Window:
    """The bytes of a file from ``start`` on, read as they are asked for."""

    def __init__(self, f, start: int, size: int):
        f.seek(start)
        self.f, self.start, self.size, self.buf = f, start, size, bytearray()

    def upto(self, n: int) -> bool:
        """Holds n bytes, or all to the file's end: then False."""
        while len(self.buf) < n and self.start + len(self.buf) < self.size:
            more = self.f.read(max(1 << 20, n - len(self.buf)))
            if not more:
                break
            self.buf += more
        return len(self.buf) >= n


def _decode(w: _Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``at``; None if there is none whose
    content begins with a WARC header."""
    z, out, pos = zlib.decompressobj(31), [], at
    seen = 0
    try:
        while not z.eof:
            w.upto(pos + _CHUNK)
            piece = bytes(w.buf[pos : pos + _CHUNK])
            if not piece:
                return None
            data = z.decompress(piece)
            pos += len(piece)
            if data:
                out.append(data)
                if seen < 5 and not b"".join(out)[:5] == b"WARC/"[: min(5, seen + len(data))]:
                    return None
                seen += len(data)
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data)) if seen >= 5 else None


def records(content: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """All records of a member; None if it isn't made of whole records."""
    found, at = [], 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            return None
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not head.get("content-length", "").isdigit() or "warc-type" not in head:
            return None
        stop = end + 4 + int(head["content-length"])
        if stop > len(content):
            return None
        found.append((head, content[end + 4 : stop]))
        at = stop + 4 if content.startswith(b"\r\n\r\n", stop) else stop
    return found or None


def _chain(f, size: int, at: int, end: int) -> Iterator[tuple[int, int, list[tuple[dict[str, str], bytes]]]]:
    """Start, end and records of the members that start in [at, end), each the
    first that decodes behind the one before."""
    w, base = _Window(f, at, size), at
    at, end = 0, end - base
    w.upto(end)
    while at < end:
        hit = w.buf.find(MAGIC, at)
        while hit < 0 and len(w.buf) < min(end + 2, size - base) and w.upto(len(w.buf) + 1):
            hit = w.buf.find(MAGIC, max(at, len(w.buf) - (1 << 20) - 4))
        if hit < 0 or hit >= end:
            break
        got = _decode(w, hit)
        parsed = records(got[0]) if got else None
        if parsed is None:
            at = hit + 1
            continue
        at = got[1]
        yield base + hit, base + at, parsed


def _walk(f, size: int, at: int, end: int) -> tuple[int, int]:
    """Where the first member that starts in [at, end) starts, or -1, and where
    the search for the next one from ``end`` on has to begin."""
    first, stop = -1, end
    for hit, stop_, _ in _chain(f, size, at, end):
        first, stop = hit if first < 0 else first, max(end, stop_)
    return first, stop


def entry(f, size: int, start: int) -> int:
    """Where the search from ``start`` on has to begin: there, or at the end of
    the member that covers it.  Only the file from its start on can tell, as
    members may be nested in stored payloads to any depth and length."""
    at = 0
    while at < start:
        at = _walk(f, size, at, min(at + SPLIT_BYTES, start))[1]
    return at


def scan(f, size: int, start: int, end: int, at: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose members start in [start, end) of a file.  Bytes that belong
    to no member (damage) are passed over.  ``at`` is the range's entry, found
    from the file's start if not given."""
    for hit, _, parsed in _chain(f, size, entry(f, size, start) if at is None else at, end):
        for head, body in parsed:
            yield hit, head, body


def _entries(ranges: DataFrame, split_bytes: int, parts: int) -> DataFrame:
    """``ranges`` (path, length, start) with their entries.  Every range is walked
    as if no member covered its start; a file's ranges are then put in a row, and
    only one that a member covers in part, with members nested in that part, is
    walked again."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, length, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if start + split_bytes >= length:  # nothing depends on a file's last range
                    found.append((-1, length))
                    continue
                filesystem, name = _filesystem(path)
                with filesystem.open_input_file(name) as f:
                    found.append(_walk(f, length, start, start + split_bytes))
            first, stop = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int64()), pa.array(stop, pa.int64())], ["path", "length", "start", "first", "stop"])

    def enter(table: pa.Table) -> pa.Table:
        path, length = table.column("path")[0].as_py(), table.column("length")[0].as_py()
        at, entries = 0, {}
        for start, first, stop in sorted(set(zip(*(table.column(c).to_pylist() for c in ("start", "first", "stop"))))):
            entries[start] = at = max(at, start)
            if at >= stop:
                continue
            if first < 0 or at <= first:
                at = stop
            elif at < start + split_bytes:
                filesystem, name = _filesystem(path)
                with filesystem.open_input_file(name) as f:
                    at = _walk(f, length, at, start + split_bytes)[1]
        return table.select(["path", "length", "start"]).append_column("entry", pa.array([entries[x] for x in table.column("start").to_pylist()], pa.int64()))

    walked = ranges.repartition(parts, "path", "start").mapInArrow(walk, "path string, length long, start long, first long, stop long")
    return walked.groupBy("path", "length").applyInArrow(enter, "path string, length long, start long, entry long")


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files listed in ``files`` (path, length), one row each in
    the columns of SCHEMA; missing headers are null.  Files without members, and
    empty ones, give no rows."""
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n, longest = ranges.agg(F.count(F.lit(1)), F.max("length")).first()
    per = spark.sparkContext.defaultParallelism
    parts = max(1, n if n < 4 * per else min(n, 200_000))
    several = F.col("length") > split_bytes
    entered = ranges.withColumn("entry", F.lit(0).cast("long")) if (longest or 0) <= split_bytes else _entries(ranges.where(several), split_bytes, parts).unionByName(ranges.where(~several).withColumn("entry", F.lit(0).cast("long")))
    ranges = entered.repartition(parts, "path", "start")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("null_fields", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        for b in batches:
            for path, length, start, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_file(name) as f:
                    for offset, head, body in scan(f, length, start, min(start + split_bytes, length), at):
                        uri, nulls = head.get("warc-target-uri"), head.get("x-null-fields", "")
                        if uri is not None and "quoted_uri" in nulls.split():
                            uri = urllib.parse.unquote(uri)
                        rows.append((path, offset, head["warc-type"], head.get("warc-record-id"), uri, head.get("content-type"), len(body), nulls, body))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return ranges.mapInArrow(take, SCHEMA)


def load(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all *.warc.gz below ``path``; Spark lists the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return read(spark, files, split_bytes)


def roundtrip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``pages`` written as WARC and read back: page_id, url, content_length (in
    bytes) and html, one row per row; nulls come back as nulls, '' as ''."""
    spark = pages.sparkSession
    files = write(pages, shared_dir(spark))
    got = read(spark, files, split_bytes).where("record_type = 'resource'")
    null = F.split("null_fields", " ")
    return got.select(
        F.when(~F.array_contains(null, "id"), F.regexp_extract("record_id", "urn:row:(.*)>", 1).cast("bigint")).alias("page_id"),
        F.col("target_uri").alias("url"),
        "content_length",
        F.when(~F.array_contains(null, "body"), F.decode("payload", "UTF-8")).alias("html"),
    )


QUERY = "op1_warc_split_read"
SQL = "SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS content_length, html FROM pages"


def query(spark, sf_dir: str) -> DataFrame:
    return roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
