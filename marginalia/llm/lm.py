"""Stupid-backoff scores (Brants et al., 2007), computed from n-gram tables.

Documents are dealt to blocks by a hash of their content.  Each block explodes
into its distinct n-grams with counts, kept as packed, sorted vectors of 64-bit
hashes: one row per block, order and bucket of the hash space.  Grouped by
bucket these rows are the count tables, partitioned by hash; there they are
summed, pruned and joined back to the n-grams that asked, and the counts return
to the block, where they are summed per document.  Every table has at most as
many rows as there are n-grams.

Equal rows share a block, so those that occur more than REPEATS times are
counted, collapsed into one with its number before they are dealt, and joined
back at the end; texts without letters to count aren't dealt at all.  So no group
is larger than a block or a bucket by more than chance, and nothing is broadcast
but the repeated rows' keys, where their counted number allows it, and one row
of totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import hash_words, mix, slices
from .shared import bounded, cut, lookup

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 20 << 20
#: Equal rows beyond this number are collapsed; how rows are dealt, not what is found.
REPEATS = 1000


def grams(texts: pa.Array | pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order k the hash of the k-gram that ends at each word (0 where
    the text has no k words yet), and the texts' offsets."""
    hs, lens = [], []
    for b in slices([pa.RecordBatch.from_arrays([c], ["text"]) for c in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])], 2 << 20):
        h, offs, _ = hash_words(b.column(0))
        hs.append(h)
        lens.append(np.diff(offs))
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    offs = np.concatenate([[0], np.cumsum(np.concatenate(lens))]) if lens else np.zeros(1, np.int64)
    pos = np.arange(len(h)) - np.repeat(offs[:-1], np.diff(offs))
    out, g = [h | np.uint64(1)], h
    for k in range(2, order + 1):
        g = np.concatenate([np.zeros(min(1, len(g)), np.uint64), mix(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])])
        out.append(np.where(pos >= k - 1, g | np.uint64(1), np.uint64(0)))
    return out, offs


def _distinct(g: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes but 0, and how often each occurs, or the sum of its weights."""
    if weight is None:
        u, c = np.unique(g, return_counts=True)
    else:
        u, at = np.unique(g, return_inverse=True)
        c = np.bincount(at, weight, len(u)).astype(np.int64)
    return (u[1:], c[1:]) if len(u) and u[0] == 0 else (u, c)


def _runs_of(u: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall in, each once, and where each begins:
    even cuts of the 64-bit space, told by the upper 32 bits."""
    bucket = (u >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(u) else np.zeros(0, np.int64)
    return bucket[first].astype(np.int64), np.concatenate([first, [len(u)]])


def _pack(x: np.ndarray) -> bytes:
    """Sorted numbers as the steps between them, first bytes first: most planes
    are then nearly constant, which the shuffle's compression makes use of."""
    steps = np.diff(x, prepend=x[:1] * 0)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, log_score (natural logarithm of the document's
    stupid-backoff score under the whole input) and mean_log_score.

    Words are runs of letters and digits, lower-cased.  A word's score is
    count(n-gram) / count(context) for the longest n-gram, up to ``order``, whose
    count is at least ``min_count``, times ``alpha`` for every order given up,
    and at last count(word) / words in the corpus.  One row per row, repeated
    ones too.  A null text, or one without words, has no tokens, score 0 and a
    null mean.  Of the input only the two columns are used."""
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = src.where("text <> ''")
    total = some.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = n_buckets = max(1, -(-total // block_bytes))
    key = F.xxhash64("doc_id", "text")
    repeated = cut(some.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATS).select("key"))
    many = bool(repeated.head(1))
    dealt = some.withColumn("times", F.lit(1).cast("long"))
    if many:
        keys = lookup(repeated)
        keyed = some.withColumn("key", key)
        once = keyed.join(keys, "key", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
        dealt = keyed.join(keys, "key", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times")).unionByName(once)
    # both uses of this table are the same, so it is shuffled once
    blocked = dealt.withColumn("text_hash", F.xxhash64("text") if many else F.lit(0).cast("long")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def explode(table: pa.Table) -> pa.Table:
        gs, offs = grams(table.column("text"), order)
        block, times = table.column("block")[0].as_py(), table.column("times").to_numpy()
        weight = None if times.max() == 1 else np.repeat(times, np.diff(offs))
        rows = []
        for k, g in enumerate(gs, 1):
            u, c = _distinct(g, weight)
            buckets, at = _runs_of(u, n_buckets)
            c = c.astype(np.uint32 if not len(c) or c.max() < 1 << 32 else np.uint64)
            rows += [(b, block, k, y - x, _pack(u[x:y]), c[x:y].tobytes()) for b, x, y in zip(buckets.tolist(), at[:-1].tolist(), at[1:].tolist())]
        cols = zip(*rows) if rows else ([],) * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "ord", "n", "hashes", "counts"])

    def join(table: pa.Table) -> pa.Table:
        ords = table.column("ord").to_numpy()
        ns = table.column("n").to_pylist()
        hashes = [_unpack(x) for x in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, np.uint32 if len(x) == 4 * n else np.uint64) for x, n in zip(table.column("counts").to_pylist(), ns)]
        back: list[bytes] = [b""] * len(ords)
        for k in np.unique(ords):
            mine = np.flatnonzero(ords == k)
            h = np.concatenate([hashes[i] for i in mine])
            u, inverse = np.unique(h, return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([counts[i] for i in mine]), len(u))
            if k > 1:
                sums[sums < min_count] = 0
            answer = sums.astype(np.uint32 if sums.max() < 1 << 32 else np.uint64)[inverse]  # whole numbers below 2**53
            cuts = np.cumsum([len(hashes[i]) for i in mine])[:-1]
            for i, part in zip(mine, np.split(answer, cuts)):
                back[i] = part.astype(np.uint64 if len(part) and part.max() >= 1 << 32 else np.uint32 if len(part) and part.max() >= 1 << 16 else np.uint16).tobytes()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ord": table.column("ord"), "n": pa.array(ns, pa.int32()), "totals": pa.array(back, pa.binary())})

    def total_up(mine: pa.Table, found: pa.Table) -> pa.Table:
        gs, offs = grams(mine.column("text"), order)
        found = found.sort_by([("ord", "ascending"), ("bucket", "ascending")])
        ks, ns, totals = found.column("ord").to_numpy(), found.column("n").to_numpy(), found.column("totals").to_pylist()
        per = {int(k): np.concatenate([np.frombuffer(totals[i], {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(totals[i]) // ns[i]]).astype(np.float64) for i in np.flatnonzero(ks == k)]) for k in np.unique(ks)}
        n = len(gs[0])
        log, done, context = np.zeros(n), np.zeros(n, bool), []
        for k, g in enumerate(gs, 1):
            u, _ = _distinct(g)
            c = per[k][np.minimum(np.searchsorted(u, g), len(u) - 1)] if len(u) else np.zeros(n)
            context.append(np.where(g == 0, 0, c))
        for k in range(order, 1, -1):
            before = np.concatenate([[0.0], context[k - 2][:-1]]) if n else context[k - 2]
            use = ~done & (context[k - 1] > 0)
            log[use] += np.log(context[k - 1][use] / before[use])
            done |= use
            log[~done & (gs[k - 1] != 0)] += np.log(alpha)
        log[~done] += np.log(context[0][~done])
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        words = pa.array(np.diff(offs), pa.int64())
        return pa.table({"doc_id": mine.column("doc_id"), "text_hash": mine.column("text_hash"), "times": mine.column("times"), "n_tokens": words, "partial": pa.array(np.bincount(doc, log, len(offs) - 1), pa.float64()), "n_unigram": pa.array(np.bincount(doc, ~done, len(offs) - 1).astype(np.int64), pa.int64())})

    exploded = blocked.groupBy("block").applyInArrow(explode, "bucket int, block int, ord int, n int, hashes binary, counts binary")
    joined = exploded.groupBy("bucket").applyInArrow(join, "block int, bucket int, ord int, n int, totals binary")
    kind = src.schema["doc_id"].dataType.simpleString()
    scored = cut(blocked.groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(total_up, f"doc_id {kind}, text_hash long, times long, n_tokens bigint, partial double, n_unigram bigint"))
    words = F.broadcast(scored.agg(F.sum(F.col("n_tokens") * F.col("times")).cast("double").alias("words")))  # one row, whatever the input's size
    out = scored.crossJoin(words).select("doc_id", "text_hash", "times", "n_tokens", (F.col("partial") - F.when(F.col("n_unigram") > 0, F.col("n_unigram") * F.log("words")).otherwise(0.0)).alias("log_score"))
    names = ("doc_id", "n_tokens", "log_score")
    rows = out.where("times = 1").select(*names) if many else out.select(*names)
    if many:
        theirs = out.where("times > 1").select(F.col("doc_id").alias("id"), "text_hash", "n_tokens", "log_score")
        back = keyed.join(keys, "key", "left_semi").withColumn("own_hash", F.xxhash64("text"))
        rows = rows.unionByName(back.join(lookup(cut(theirs)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))).select(*names))
    none = src.where("text IS NULL OR text = ''").select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_score"))
    return rows.unionByName(none).withColumn("mean_log_score", F.expr("CASE WHEN n_tokens > 0 THEN log_score / n_tokens END"))


QUERY = "op4_stupid_backoff_scores"


def query(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


SQL = f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
  tok AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs),
  pairs AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS p FROM tok),
  uni AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
  bi AS (SELECT p, w, count(*) AS c FROM pairs WHERE p IS NOT NULL GROUP BY p, w HAVING count(*) >= {MIN_COUNT}),
  total AS (SELECT count(*)::DOUBLE AS n FROM tok),
  scored AS (SELECT r, sum(CASE WHEN bi.c IS NOT NULL THEN ln(bi.c / cu.c::DOUBLE)
      ELSE CASE WHEN pairs.p IS NULL THEN 0 ELSE ln({ALPHA}) END + ln(uni.c::DOUBLE) - ln(n) END) AS s
    FROM pairs JOIN uni USING (w) LEFT JOIN bi ON bi.p = pairs.p AND bi.w = pairs.w LEFT JOIN uni cu ON cu.w = pairs.p CROSS JOIN total GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 4) AS log_score, round(s / nullif(len(w), 0), 6) AS mean_log_score
  FROM docs LEFT JOIN scored USING (r)"""


TRIGRAM_QUERY = "op4_stupid_backoff_trigram_scores"


def trigram_query(spark, sf_dir: str) -> DataFrame:
    """The scores with one order more than in ``query``, whose SQL ends at pairs."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3)
    return out.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


TRIGRAM_SQL = f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
  tok AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs),
  grams AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS q FROM tok),
  uni AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
  bi AS (SELECT p, w, count(*) AS c FROM grams WHERE p IS NOT NULL GROUP BY p, w HAVING count(*) >= {MIN_COUNT}),
  tri AS (SELECT q, p, w, count(*) AS c FROM grams WHERE q IS NOT NULL GROUP BY q, p, w HAVING count(*) >= {MIN_COUNT}),
  total AS (SELECT count(*)::DOUBLE AS n FROM tok),
  scored AS (SELECT r, sum(CASE WHEN tri.c IS NOT NULL THEN ln(tri.c / cb.c::DOUBLE)
      ELSE CASE WHEN g.q IS NULL THEN 0 ELSE ln({ALPHA}) END + CASE WHEN bi.c IS NOT NULL THEN ln(bi.c / cu.c::DOUBLE)
      ELSE CASE WHEN g.p IS NULL THEN 0 ELSE ln({ALPHA}) END + ln(uni.c::DOUBLE) - ln(n) END END) AS s
    FROM grams g JOIN uni USING (w) LEFT JOIN tri ON tri.q = g.q AND tri.p = g.p AND tri.w = g.w LEFT JOIN bi cb ON cb.p = g.q AND cb.w = g.p
      LEFT JOIN bi ON bi.p = g.p AND bi.w = g.w LEFT JOIN uni cu ON cu.w = g.p CROSS JOIN total GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 4) AS log_score, round(s / nullif(len(w), 0), 6) AS mean_log_score
  FROM docs LEFT JOIN scored USING (r)"""
