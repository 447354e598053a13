"""Archives made from the tables ``conversations``, ``documents`` and ``pages``:
a conversation becomes a document, a turn a comment on it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import archives, container, document

STYLES = ("CommentText", "")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    para = F.lpad(F.upper(F.hex(F.col("turn") + 1)), 8, "0")
    parent = F.when(F.col("turn") > 0, F.lpad(F.upper(F.hex(F.floor((F.col("turn") - 1) / 2) + 1)), 8, "0")).otherwise("")
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    role = F.coalesce("role", F.lit(""))
    return t.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("int").alias("id"), role.alias("author"), date.alias("date"), F.upper(F.substring(role, 1, 2)).alias("initials"), F.coalesce("text", F.lit("")).alias("text"),
            F.when(F.col("turn") % 2 == 0, STYLES[0]).otherwise(STYLES[1]).alias("style"), para.alias("para_id"), parent.alias("parent"), (F.col("turn") % 3 == 2).alias("done"), F.lit("").alias("ids_para_id"),
        ).alias("turn"),
    )


def _write(grouped: DataFrame, method: int = 8) -> DataFrame:
    """file_path and content from (conv_id, turns, body)."""

    def one(conv: int, turns: list[dict], body: list[dict]) -> tuple[str, bytes]:
        return f"conv_{conv}", archives.build(turns, [(x["what"], x["text"] if x["what"] == "text" else x["id"]) for x in body], method)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archives.packed(batches, one)

    return archives.bounded(grouped).select("conv_id", "turns", "body").mapInArrow(run, "file_path string, content binary")


def _events(*rows: tuple) -> F.Column:
    return F.array(*[F.struct(F.lit(w).alias("what"), i.cast("int").alias("id"), t.cast("string").alias("text")) for w, i, t in rows])


def conversations(spark: SparkSession, sf_dir: str, anchored: bool = True) -> DataFrame:
    """One archive per conversation; turn k replies to turn (k-1) div 2, every
    third is resolved, and the first is anchored at the document of the same id."""
    grouped = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    none = F.lit(None)
    if anchored:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("conv_id"), F.coalesce("text", F.lit("")).alias("anchor"))
        grouped = grouped.join(docs, "conv_id", "left")
        zero = F.lit(0)
        body = F.when(F.col("anchor").isNotNull(), _events(("start", zero, none), ("text", zero, F.col("anchor")), ("end", zero, none))).otherwise(F.array().cast("array<struct<what:string,id:int,text:string>>"))
    else:
        body = F.array().cast("array<struct<what:string,id:int,text:string>>")
    return _write(grouped.withColumn("body", body))


def without_paragraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of odd number have no paragraph id of their own, only one in the ids part."""
    t = _turns(spark, sf_dir)
    odd = F.col("turn.id") % 2 == 1
    t = t.withColumn("turn", F.col("turn").withField("ids_para_id", F.when(odd, F.col("turn.para_id")).otherwise("")).withField("para_id", F.when(odd, "").otherwise(F.col("turn.para_id"))))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return _write(grouped.withColumn("body", F.array().cast("array<struct<what:string,id:int,text:string>>")))


def equal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in their order under the ids turn div 2, without replies."""
    t = _turns(spark, sf_dir).withColumn("order", F.col("turn.id"))
    t = t.withColumn("turn", F.col("turn").withField("id", F.floor(F.col("order") / 2).cast("int")).withField("parent", F.lit("")))
    grouped = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "turn"))), lambda x: x.turn).alias("turns"))
    return _write(grouped.withColumn("body", F.array().cast("array<struct<what:string,id:int,text:string>>")))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns' texts are the body's runs; comment k's range covers runs k and k + 1."""
    grouped = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    last = F.col("turns")[F.size("turns") - 1]["id"]

    def one(t):
        start = F.struct(F.lit("start").alias("what"), t["id"].alias("id"), F.lit(None).cast("string").alias("text"))
        run = F.struct(F.lit("text").alias("what"), t["id"].alias("id"), t["text"].alias("text"))
        before = F.struct(F.lit("end").alias("what"), (t["id"] - 1).alias("id"), F.lit(None).cast("string").alias("text"))
        own = F.struct(F.lit("end").alias("what"), t["id"].alias("id"), F.lit(None).cast("string").alias("text"))
        out = F.array(start, run)
        return F.concat(out, F.when(t["id"] > 0, F.array(before)).otherwise(F.array().cast("array<struct<what:string,id:int,text:string>>")), F.when(t["id"] == last, F.array(own)).otherwise(F.array().cast("array<struct<what:string,id:int,text:string>>")))

    return _write(grouped.withColumn("body", F.flatten(F.transform("turns", one))))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose archives are damaged in a way that conv_id mod 6 tells;
    those of remainder 0 are whole."""
    whole = conversations(spark, sf_dir, anchored=False)
    kind = F.pmod(F.substring("file_path", 6, 40).cast("bigint"), F.lit(6))

    empty, odd = container.pack([(document.COMMENTS, b"")]), container.pack([(document.COMMENTS, b"<x/>")], method=12)
    content = (
        F.when(kind == 1, F.lit(b"").cast("binary")).when(kind == 2, F.substring("content", 1, 10)).when(kind == 3, F.lit(bytes(100)))
        .when(kind == 4, F.lit(empty)).when(kind == 5, F.lit(odd)).otherwise(F.col("content"))
    )
    return whole.select("file_path", content.alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive per page, its source the text of comment 0."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id IS NOT NULL")
    empty = F.lit("")
    turn = F.struct(F.lit(0).alias("id"), F.coalesce("url", empty).alias("author"), empty.alias("date"), empty.alias("initials"), F.coalesce("html", empty).alias("text"), empty.alias("style"), empty.alias("para_id"), empty.alias("parent"), F.lit(False).alias("done"), empty.alias("ids_para_id"))
    return _write(p.select(F.col("page_id").alias("conv_id"), F.array(turn).alias("turns"), F.array().cast("array<struct<what:string,id:int,text:string>>").alias("body")))


def unreadable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose ids begin with no number (odd turns) or end in something else."""
    t = _turns(spark, sf_dir)
    number = F.col("turn.id").cast("string")
    ident = F.when(F.col("turn.id") % 2 == 1, F.concat(F.lit("n"), number)).otherwise(F.concat(F.lit(" "), number, F.lit("th")))
    turn = F.col("turn").withField("id", ident).withField("parent", F.lit(""))
    grouped = t.select("conv_id", F.col("turn.id").alias("order"), turn.alias("turn")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "turn"))), lambda x: x.turn).alias("turns"))
    return _write(grouped.withColumn("body", F.array().cast("array<struct<what:string,id:int,text:string>>")))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One container per page with the entries page/url, other/none, page/html and
    again page/url, the last the one that counts.  Page ids tell whether they are
    stored or deflated (odd ones), and in ZIP64 or not (those divisible by 3)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id IS NOT NULL")

    def one(page: int, url: str | None, html: str | None) -> tuple[str, bytes]:
        url, html = (url or "").encode(), (html or "").encode()
        return f"page_{page}", container.pack([("page/url", b"old"), ("other/none", b""), ("page/html", html), ("page/url", url)], 8 * (page % 2), wide=page % 3 == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archives.packed(batches, one)

    return archives.bounded(p).select("page_id", "url", "html").mapInArrow(run, "file_path string, content binary")


def written(files: DataFrame, folder: str) -> DataFrame:
    """The contents of ``files`` written below ``folder``: file_path, where each is.
    A file is renamed into place, so a task that runs again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = archives.filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            system.create_dir(base, recursive=True)
            paths = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with system.open_output_stream(f"{base}/{name}.{attempt}.tmp", compression=None) as out:
                    out.write(content.as_py())
                system.move(f"{base}/{name}.{attempt}.tmp", f"{base}/{name}.docx")
                paths.append(f"{folder}/{name}.docx")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["file_path"])

    return archives.bounded(files).select("file_path", "content").mapInArrow(run, "file_path string")
