"""Benchmark decontamination: MinHash containment search, partitioned by size.

An item is *in* a document when at least THRESHOLD of the item's distinct word
shingles are among the document's.  A short item in a long document has a tiny
Jaccard similarity, so one signature length can't serve all sizes: documents are
partitioned by size in powers of two, and a document of up to u shingles gets a
one-permutation MinHash signature of about CERTAINTY * u / (THRESHOLD * q) bins,
q being the item's size; then the chance that none of the shared shingles is the
least of its bin on the document's side is about exp(-CERTAINTY).  The bins are
nested, so the signature for the smallest item holds those for larger ones.
Candidates are verified by exact shingle containment.

A Bloom filter of the items' hashes travels with the scan, so that only shingles
which may be an item's leave it, marked if they are in the document's signature.
They are written once.  Candidates come from a join of signatures alone, in which
a document meets only items of a size that its number of such shingles can reach:
texts that share no more than a common phrase with many items meet none of them.
The shingles of a candidate pair are then compared along the shorter of the two
lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SLICE_BYTES, hash_words, mix, ngram_hashes, slices
from .shared import bounded, cut, lookup, unused

SHINGLE = 3
THRESHOLD = 0.6
CERTAINTY = 5.0
#: Item shingles searched in one pass over the documents: a filter of 8 MB.
FILTER_KEYS = 4_000_000
LEVELS = 40


def _bits(level: np.ndarray | int, q: np.ndarray | int) -> np.ndarray:
    """log2 of the number of bins for documents of up to 2**level shingles and
    items of q shingles."""
    want = CERTAINTY * np.exp2(np.asarray(level, float)) / (THRESHOLD * np.maximum(1, np.asarray(q, float)))
    return np.ceil(np.log2(np.maximum(1, want))).astype(np.int64)


def _least_of_bin(h: np.ndarray, owner: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of hashes sorted by owner and value: which are the least of their bin."""
    bin_ = np.where(bits > 0, h >> (np.uint64(64) - np.maximum(bits, 1).astype(np.uint64)), np.uint64(0))
    return np.concatenate([[True], (owner[1:] != owner[:-1]) | (bin_[1:] != bin_[:-1])]) if len(h) else np.zeros(0, bool)


def _shingles(h: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    g, doc = ngram_hashes(h, offs, k)
    return (g if k == SHINGLE else mix(g ^ np.uint64(0xC2B2AE3D27D4EB4F * k & (1 << 64) - 1))), doc


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item row and distinct shingle: item_id, item_row, k (words in
    a shingle), size, hash, and levels, the set of document sizes for which the
    shingle is in the item's signature."""
    src = items.select(F.col(f"`{item_id}`").alias("item_id"), F.xxhash64(F.col(f"`{item_id}`"), F.col(f"`{text}`")).alias("item_row"), F.col(f"`{text}`").alias("text")).dropDuplicates(["item_id", "item_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offs, _ = hash_words(b.column(2))
            words = np.diff(offs)
            for k in range(1, SHINGLE + 1):
                g, doc = _shingles(h, offs, k)
                use = words[doc] >= k if k == SHINGLE else words[doc] == k
                g, doc = g[use], doc[use]
                o = np.lexsort((g, doc))
                g, doc = g[o], doc[o]
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.zeros(0, bool)
                g, doc = g[new], doc[new]
                size = np.bincount(doc, minlength=b.num_rows)[doc]
                levels = np.zeros(len(g), np.int64)
                for e in range(LEVELS):
                    levels |= _least_of_bin(g, doc, _bits(e, size)).astype(np.int64) << e
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(g), k, np.int32)), pa.array(size.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(levels)], ["item_id", "item_row", "k", "size", "hash", "levels"])

    return src.mapInArrow(run, f"item_id {src.schema['item_id'].dataType.simpleString()}, item_row bigint, k int, size int, hash bigint, levels bigint")


class Bloom:
    """A Bloom filter of 64-bit hashes with two probes."""

    def __init__(self, hashes: np.ndarray):
        self.log = max(16, int(len(hashes) * 16 - 1).bit_length())
        seen = np.zeros(1 << self.log, bool)
        for k in (0, 1):
            seen[self._at(hashes, k)] = True
        self.bits = np.packbits(seen, bitorder="little")

    def _at(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h if k == 0 else h << np.uint64(20)) >> np.uint64(64 - self.log)).astype(np.int64)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes that may be in the set."""
        maybe = np.arange(len(h))
        for k in (0, 1):
            at = self._at(h[maybe], k)
            maybe = maybe[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        return maybe


def _signed(h: np.ndarray, offs: np.ndarray, k: int, bloom: Bloom, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of k words that may be some item's: hash, text, and
    whether the text's signature holds it."""
    every, of = _shingles(h, offs, k)
    at = bloom.hits(every)
    if not len(at):
        return every[:0], of[:0], np.zeros(0, bool)
    some = np.zeros(len(offs) - 1, bool)
    some[of[at]] = True
    mine = some[of]  # bins are laid out for the texts with hits alone
    every, of = every[mine], of[mine]
    o = np.lexsort((every, of))
    every, of = every[o], of[o]
    level = np.ceil(np.log2(np.maximum(1, np.diff(offs) - SHINGLE + 1))).astype(np.int64)
    signed = _least_of_bin(every, of, _bits(level[of], least)) if k == SHINGLE else np.ones(len(every), bool)
    new = np.concatenate([[True], (every[1:] != every[:-1]) | (of[1:] != of[:-1])])
    at = bloom.hits(every[new])
    return every[new][at], of[new][at], signed[new][at]


def _search(src: DataFrame, shingles: DataFrame, kind: str) -> DataFrame:
    """One pass over the documents for one share of the items."""
    facts = shingles.agg(F.min(F.when(F.col("k") == SHINGLE, F.col("size"))).alias("least"), F.collect_set("k").alias("ks")).first()
    ks, least = sorted(facts["ks"]), facts["least"] or 1
    bloom = Bloom(shingles.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES, "text"):
            h, offs, _ = hash_words(b.column(3))
            level = np.ceil(np.log2(np.maximum(1, np.diff(offs) - SHINGLE + 1))).astype(np.int32)
            for k in ks:
                g, doc, signed = _signed(h, offs, k, bloom, least)
                # a text none of whose signature is an item's is no candidate, nor is one with too few shingles
                may = np.zeros(b.num_rows, bool)
                may[doc[signed]] = True
                hits = np.bincount(doc, minlength=b.num_rows)
                if k == SHINGLE:
                    may &= hits >= THRESHOLD * least
                keep = may[doc]
                g, doc, signed = g[keep], doc[keep], signed[keep]
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(level[doc]), pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(signed), pa.array(hits[doc])], ["row", "doc_id", "text_hash", "level", "k", "hash", "signed", "hits"])

    found = cut(src.mapInArrow(sign, f"row bigint, doc_id {kind}, text_hash bigint, level int, k int, hash bigint, signed boolean, hits bigint"))
    pairs = cut(candidates(found, shingles))
    ours, theirs = found.select("row", "k", "hash"), shingles.select("item_row", "k", "hash")
    by_doc = pairs.where("hits <= size").join(ours, ["row", "k"]).join(theirs, ["item_row", "k", "hash"])
    by_item = pairs.where("hits > size").join(theirs, ["item_row", "k"]).join(ours, ["row", "k", "hash"])
    shared = by_doc.select(*pairs.columns).unionByName(by_item.select(*pairs.columns))
    count = shared.groupBy("row", "doc_id", "text_hash", "item_id", "item_row", "size").agg(F.count(F.lit(1)).alias("shared"))
    return count.where(F.col("shared") >= THRESHOLD * F.col("size")).select("doc_id", "item_id", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"), "text_hash")


def candidates(found: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs of a document's row and an item's that share a shingle which both
    signatures hold, once each; no pair whose document has too few shingles of
    any item to hold this one.  Sizes are met by their power of two, so that such
    pairs don't arise in the join either."""
    power = lambda c: F.floor(F.log2(c.cast("double"))).cast("int")
    most = F.floor(F.col("hits") / THRESHOLD + 1e-9)
    signed = found.where("signed").withColumn("most", most).withColumn("power", F.explode(F.sequence(F.lit(0), power(F.col("most")))))
    in_both = (F.col("k") < SHINGLE) | F.expr("shiftright(levels, level) & 1 = 1")
    both = signed.join(shingles.withColumn("power", power(F.col("size"))), ["k", "hash", "power"]).where((F.col("size") <= F.col("most")) & in_both)
    return both.select("row", "doc_id", "text_hash", "hits", "item_id", "item_row", "size", "k").distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, shared, size, containment, and text_hash (Spark's
    xxhash64 of the text): a row for every row of ``docs`` and every item that it
    contains.

    Words are runs of letters and digits, lower-cased; a shingle is SHINGLE of
    them in a row, and an item of fewer words is one shingle of all its words.
    Null and empty texts contain nothing, items without words are in nothing.
    Repeated documents give repeated rows; equal items (id and text) count once,
    items that share an id but not the text are judged apart.  Texts of any
    length are read to their end.  Only the named columns are used.

    Items are searched in shares of FILTER_KEYS shingles, a pass over the
    documents each, so that the filter's size is bounded whatever their number."""
    shingles = cut(item_shingles(items, item_id, item_text))
    shares = max(1, -(-shingles.count() // FILTER_KEYS))
    kind = docs.select(F.col(f"`{doc_id}`").alias("x")).schema["x"].dataType.simpleString()
    src = bounded(docs).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    out = None
    for share in range(shares):
        mine = shingles if shares == 1 else shingles.where(F.pmod(F.col("item_row"), F.lit(shares)) == share)
        one = _search(src, mine, kind)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.  Null and
    empty texts contain none and stay, repeated rows stay or go together, and
    without items, or without rows, nothing changes."""
    (name,) = unused(docs, "__bad")
    bad = cut(contaminated(docs, items, doc_id, text).select(F.col("text_hash").alias(name)).distinct())
    return docs.join(lookup(bad), F.xxhash64(F.col(f"`{text}`")) == F.col(name), "left_anti")


QUERY = "op6_minhash_containment"


def query(spark, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "shared", F.col("size").cast("bigint").alias("size"), F.round("containment", 9).alias("containment"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` without an item of the table ``benchmark``, see clean()."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _grams(table: str, ident: str, keep: str) -> str:
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"(SELECT DISTINCT {ident}, r, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT {ident}, row_number() OVER () AS r, {words} AS w FROM {table}), (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k AND {keep}))"


SQL = f"""WITH item AS {_grams("benchmark", "item_id", f"k = least({SHINGLE}, len(w))")},
  doc AS (SELECT * FROM {_grams("documents", "doc_id", "k IN (SELECT k FROM item)")} WHERE g IN (SELECT g FROM item)),
  total AS (SELECT r, count(*) AS size FROM item GROUP BY r)
  SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size, round(count(*) / any_value(size), 9) AS containment
  FROM doc JOIN item USING (k, g) JOIN total ON total.r = item.r
  GROUP BY doc_id, doc.r, item_id, item.r HAVING count(*) >= {THRESHOLD} * any_value(size)"""
