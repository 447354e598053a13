"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A text's fingerprint is 128 SimHash bits of its distinct words and 64 of its
word trigrams.  Five segments of 23 bits are looked up in the perfect binary
Golay code (23, 12): a segment yields the indices of all codewords within
distance 4 (one to six), and any two segments that differ in at most two bits
have an index in common.  Documents that share an index in two of the five
segments are candidates; by pigeonhole that finds every pair whose segments
differ in at most 11 bits together, and most beyond.  Candidates are verified on
the whole fingerprint, and verified pairs joined into groups.

What is shuffled is one row per index of a first segment, some 21 a document;
the second index is worked out where the rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import SLICE_BYTES, hash_words, mix, ngram_hashes, slices
from .shared import bounded, columns, cut, lookup, unused

MAX_WORD_BITS = 24
MAX_GRAM_BITS = 21
SHORT_WORD = 3
SEGMENTS = 5
#: Indices that a segment has on average.
INDICES = (6 * 1771 + 277) / 2048
#: Rows that one task compares at a time; how rows are dealt, not what is found.
ROWS_PER_TASK = 60_000
#: Edges that are joined into groups in one task: some 100 MB there.
EDGES_PER_TASK = 1_000_000
_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEEDS = np.array([0x51ED270B9F4A7C15, 0xA24BAED4963EE407], np.uint64)


# -- Golay code ------------------------------------------------------------
def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial of 23-bit words."""
    v = np.array(v, np.uint32)
    for k in range(22, 10, -1):
        v = np.where((v >> np.uint32(k)) & np.uint32(1), v ^ np.uint32(_GENERATOR << (k - 11)), v)
    return v


@lru_cache(1)
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the error patterns of weight up to 4, which
    lead to the codewords within distance 4, and how many they are (1 to 6)."""
    patterns = np.array([sum(1 << k for k in bits) for w in range(5) for bits in combinations(range(23), w)], np.uint32)
    weight = np.bitwise_count(patterns)
    syndrome = syndromes(patterns)
    table, n = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    lightest = np.full(2048, 9)
    np.minimum.at(lightest, syndrome, weight)
    for s in range(2048):
        own = patterns[(syndrome == s)]
        n[s] = len(own)
        table[s, : len(own)] = own
    return table, n


def indices(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within distance 4 of every segment:
    the row each belongs to, and the index.  A codeword's upper 12 bits tell it
    from all others, the code being cyclic and systematic in them."""
    table, n = near_codewords()
    segments = np.asarray(segments, np.uint32)
    s = syndromes(segments)
    who = np.repeat(np.arange(len(segments)), n[s])
    nth = np.arange(len(who)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
    return who, ((segments[who] ^ table[s[who], nth]) >> np.uint32(11)).astype(np.int64)


# -- fingerprints ----------------------------------------------------------
@lru_cache(1)
def _lanes() -> np.ndarray:
    """For each byte a word whose eight bytes hold the byte's bits."""
    return np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64)[:, 0]


def _vote(h: np.ndarray, doc: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """64 SimHash bits of each text from its distinct features, which are in the
    order of the texts.  Votes are added eight at a time in the bytes of a word,
    over runs of up to 255 features."""
    sums = np.zeros((n, 64), np.int64)
    if len(h):
        where = np.arange(len(h))
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        new |= (where - np.maximum.accumulate(np.where(new, where, 0))) % 255 == 0
        run = np.flatnonzero(new)
        raw = mix(h ^ seed).view(np.uint8).reshape(-1, 8)
        votes = np.stack([np.add.reduceat(_lanes()[raw[:, k]], run) for k in range(8)], 1).view(np.uint8)
        first = np.flatnonzero(np.concatenate([[True], doc[run][1:] != doc[run][:-1]]))
        sums[doc[run][first]] = 2 * np.add.reduceat(votes, first, 0, dtype=np.int64)
        sums -= np.bincount(doc, minlength=n)[:, None]
    return np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, shortened to 40 bits; texts below 2**24."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & np.uint64((1 << 40) - 1), (key >> np.uint64(40)).astype(np.int64)


def fingerprints(texts) -> tuple[np.ndarray, np.ndarray]:
    """Three 64-bit words for each text, and whether it has any word at all.
    Words of more than SHORT_WORD letters count, or all where there are none."""
    h, offs, lens = hash_words(texts)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    long = lens > SHORT_WORD
    use = long | (np.bincount(doc, long, n) == 0)[doc]
    words, of = _distinct(h[use], doc[use])
    grams, gram_of = _distinct(*ngram_hashes(h, offs, 3))
    fp = np.stack([_vote(words, of, n, _SEEDS[0]), _vote(words, of, n, _SEEDS[1]), _vote(grams, gram_of, n, _SEEDS[0])], 1) if n else np.zeros((0, 3), np.uint64)
    return fp, np.diff(offs) > 0


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    """The k-th 23 bits of the word bits: two from either half, the last from both."""
    if k == SEGMENTS - 1:
        return ((fp[:, 0] >> np.uint64(46)) | ((fp[:, 1] >> np.uint64(46)) & np.uint64(31)) << np.uint64(18)).astype(np.uint32)
    return ((fp[:, k // 2] >> np.uint64(23 * (k % 2))) & np.uint64((1 << 23) - 1)).astype(np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of fingerprints are near-duplicates."""
    d = np.bitwise_count(a ^ b)
    return (d[:, 0].astype(np.int64) + d[:, 1] <= MAX_WORD_BITS) & (d[:, 2] <= MAX_GRAM_BITS)


# -- comparing -------------------------------------------------------------
def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _search(fp: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is connected among ``rows``, all compared with all:
    whoever is reached leaves the set that is still compared."""
    edges, rest = [], rows
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            hit = alike(fp[at][None], fp[rest])
            edges += [(at, x) for x in rest[hit].tolist()]
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def connect(fp: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``fp`` rows that arrived under the index ``key`` of segment ``first``; for
    each row the smallest row it is linked with.  Rows are the same document
    where their fingerprints are equal."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(SEGMENTS - 1):
        mine = np.flatnonzero(first == i)
        for j in range(i + 1, SEGMENTS):
            who, index = indices(segment(fp[mine], j))
            who, bucket = mine[who], key[mine][who] << 12 | index
            o = np.argsort(bucket, kind="stable")
            who, bucket = who[o], bucket[o]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(bucket)]]))
            for s, m in zip(start[size > 48].tolist(), size[size > 48].tolist()):
                if found := _search(fp, who[s : s + m]):
                    a, b = np.array(found).T
                    left.append(a)
                    right.append(b)
            small = np.repeat(size <= 48, size)
            who, bucket, at = who[small], bucket[small], 1
            live = np.arange(len(bucket))
            while True:
                live = live[live + at < len(bucket)]
                live = live[bucket[live] == bucket[live + at]]
                if not len(live):
                    break
                a, b = who[live], who[live + at]
                ok = alike(fp[a], fp[b])
                left.append(a[ok])
                right.append(b[ok])
                at += 1
    return _labels(len(fp), np.concatenate(left), np.concatenate(right))


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, node (one per distinct fingerprint; null for a text
    without words) and the fingerprint's words f0, f1, f2."""
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES):
            fp, any_ = fingerprints(b.column(2))
            node = mix(fp[:, 0] ^ mix(fp[:, 1] ^ mix(fp[:, 2]))).view(np.int64)
            words = [pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, mask=~any_), *words], ["doc_id", "text_hash", "node", "f0", "f1", "f2"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash bigint, node bigint, f0 bigint, f1 bigint, f2 bigint")


def links(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between nodes (node, f0, f1, f2), n of them, whose components
    are the groups of near-duplicates."""
    tasks = max(1, int(np.ceil(n * (SEGMENTS - 1) * INDICES / ROWS_PER_TASK)))
    # where one index of a segment would have more rows than a task's share, rows are dealt by the second index too
    split = max(0, int(np.ceil(np.log2(max(1, n * INDICES / 4096 / ROWS_PER_TASK)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2, 3)], 1)
            raw = np.concatenate([b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None], fp], 1)
            for i in range(SEGMENTS - 1):
                who, index = indices(segment(fp, i))
                deal = index * SEGMENTS + i
                if split:
                    more = [indices(segment(fp[who], j)) for j in range(i + 1, SEGMENTS)]
                    two = np.unique(np.concatenate([np.stack([w, (j << 12 | k) >> max(0, 12 - split)], 1) for j, (w, k) in enumerate(more)]), axis=0)
                    deal, who, index = deal[two[:, 0]] << 20 | two[:, 1], who[two[:, 0]], index[two[:, 0]]
                bucket = (mix(deal.astype(np.uint64)) % np.uint64(tasks)).astype(np.int32)
                two = np.unique(np.stack([bucket, index, who], 1), axis=0) if split else np.stack([bucket, index, who], 1)
                data = np.ascontiguousarray(raw[two[:, 2]]).tobytes()
                buf = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(two), [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].astype(np.int32)), pa.array((two[:, 1] * SEGMENTS + i).astype(np.int32)), buf], ["bucket", "key", "data"])

    def compare(t: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint64).reshape(-1, 4)
        key = t.column("key").to_numpy().astype(np.int64)
        label = connect(np.ascontiguousarray(raw[:, 1:]), key // SEGMENTS, key % SEGMENTS)
        a = np.ascontiguousarray(raw[:, 0]).view(np.int64)
        b = a[label]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return nodes.mapInArrow(spread, "bucket int, key int, data binary").groupBy("bucket").applyInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for nodes that have an edge.
    Up to EDGES_PER_TASK edges, which are counted, are joined in one task; more
    by alternating large-star and small-star steps, each written to the shared
    folder, until they are as few or nothing changes."""
    edges = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    before = None
    while True:
        if edges.count() <= EDGES_PER_TASK:
            return edges.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(_join_up, "node bigint, root bigint")
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "least(u, m) AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.where("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == before and now[0] == now[1]:
            return edges.selectExpr("u AS node", "v AS root").unionByName(edges.selectExpr("v AS node", "v AS root").distinct())
        before = now


def _join_up(t: pa.Table) -> pa.Table:
    """node and root for all edges (u, v) at once."""
    node, ends = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
    label = _labels(len(node), ends[: t.num_rows], ends[t.num_rows :])
    return pa.table({"node": node, "root": node[label]})


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint table of rows with words, and node, root, group_id,
    group_size for the nodes of groups of two rows or more."""
    table = cut(fingerprint_table(docs, doc_id, text).where("node IS NOT NULL"))
    nodes = cut(table.groupBy("node").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("node", "f0", "f1", "f2"), nodes.count()))
    placed = nodes.select("node", "n_docs", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = placed.groupBy("root").agg(F.min("least_id").alias("group_id"), F.sum("n_docs").alias("group_size")).where("group_size > 1")
    return table, cut(placed.select("node", "root").join(sums, "root"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group_id, group_size: one row for every row of ``docs`` that has a
    near-duplicate, repeated rows included (a repeated row is its own duplicate).

    Near-duplicates differ in at most MAX_WORD_BITS of 128 word bits and at most
    MAX_GRAM_BITS of 64 trigram bits; groups are closed under it.  ``group_id``
    is the group's smallest doc_id (null if all are null) and ``group_size`` its
    number of rows.  Texts that are null, empty or without any letter or digit
    are in no group; a text of any length counts in full.  Of the input only the
    two columns are used."""
    table, placed = _grouped(docs, doc_id, text)
    return table.select("doc_id", "node").join(placed, "node").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with one row left of each group: that of
    the smallest doc_id (null last), then of the smallest hash of the text, then
    of all columns.  Rows in no group stay, whatever they hold."""
    pick = columns(docs)
    table, placed = _grouped(docs, doc_id, text)
    # whole rows of one id and text stand or fall together, but for their number
    classes = table.join(placed.select("node", "root"), "node").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = classes.groupBy("root").agg(F.min(order).alias("first"))
    own, id_, hash_, nth = unused(docs, "__own", "__id", "__hash", "__nth")
    verdict = cut(classes.join(first, "root").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), "n", (order == F.col("first")).alias("stays")))
    keyed = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    alone = keyed.join(lookup(verdict.where("NOT stays OR n > 1").select(id_, hash_)), same, "left_anti")
    # the repeated rows of a class that stays: few, and only they are ranked
    many = lookup(verdict.where("stays AND n > 1").select(id_, hash_))
    rank = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(F.xxhash64(*pick)))
    repeated = keyed.join(many, same).withColumn(nth, rank).where(F.col(nth) == 1)
    return alone.select(*pick).unionByName(repeated.select(*pick))


QUERY = "op10_golay_simhash_groups"


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates, see keep_one()."""
    return keep_one(docs)
