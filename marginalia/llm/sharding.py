"""Jump consistent hashing (Lamping & Veach, 2014): stable keys to shards
without a ring table; appending shards moves only the fraction it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns

_LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards`` (1 or more); all keys that can
    still move advance together."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keys = np.array(keys, np.uint64)
    out = np.zeros(len(keys), np.int64)
    at, b = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(at):
        keys = keys * _LCG + np.uint64(1)
        nxt = ((b + 1) * (float(1 << 31) / ((keys >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        out[at] = b
        on = nxt < shards
        at, b, keys = at[on], nxt[on], keys[on]
    return out


def key_hash(key: Column) -> Column:
    """First 16 hexadecimal digits of the key's MD5: the same on every engine."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("long")
    def f(hexes: pd.Series) -> pd.Series:
        raw = bytes.fromhex("".join(hexes))
        return pd.Series(jump(np.frombuffer(raw, ">u8").astype(np.uint64), shards))

    return f(key_hash(key))


def assign(df: DataFrame, key: str = "doc_id", shards: int = 64, name: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` plus ``name``, the row's shard.

    Rows of equal key share a shard, repeated rows stay repeated, and a null key
    counts as the empty string.  A column already called ``name`` is replaced.
    No shuffle."""
    return df.withColumn(name, shard_of(F.col(f"`{key}`"), shards))


def moves(df: DataFrame, key: str = "doc_id", before: int = 64, after: int = 80) -> DataFrame:
    """Key, shard before and after the number of shards grows, and whether the
    row moves: one row per row of ``df``, of which the fraction 1 - before/after
    moves, always to an appended shard.  Repeated rows move together, a null key
    counts as the empty string, a table without rows gives none; other columns
    aren't used."""
    k = F.col(f"`{key}`")
    return df.select(k.alias(key), shard_of(k, before).alias("shard_before"), shard_of(k, after).alias("shard_after")).withColumn("moved", F.col("shard_before") != F.col("shard_after"))


def write_sharded(df: DataFrame, path: str, key: str = "doc_id", shards: int = 64) -> None:
    """Writes all rows and columns of ``df``, one directory per shard: one shuffle on
    the shard, split within a shard by a hash of the whole row, so that no task
    holds a whole shard, whatever a key's share of the rows.  Null keys count as
    the empty string, repeated rows are all written, a column called ``shard`` is
    replaced, and a table without rows writes no shard."""
    out = assign(df, key, shards)
    within = F.pmod(F.xxhash64(*columns(df)), F.lit(8))
    out.repartition("shard", within).write.mode("overwrite").partitionBy("shard").parquet(path)


QUERY = "op7_jump_sharding"


def query(spark, sf_dir: str) -> DataFrame:
    return moves(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


def _sql(before: int = 64, after: int = 80) -> str:
    def shard(n: int, name: str) -> str:
        return f"""{name} AS (
          SELECT k, 0::BIGINT AS b, -1::BIGINT AS prev, k::UHUGEINT AS s FROM keys
          UNION ALL
          SELECT k, CAST(floor((b + 1) * (2147483648.0::DOUBLE / ((nxt // 8589934592) + 1)::DOUBLE)) AS BIGINT), b, nxt
          FROM (SELECT *, (s * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS nxt FROM {name} WHERE b < {n}))"""

    return f"""WITH RECURSIVE docs AS (
          SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS k FROM documents),
        keys AS (SELECT DISTINCT k FROM docs),
        {shard(before, "walk_a")},
        {shard(after, "walk_b")},
        a AS (SELECT k, max(prev) AS shard FROM walk_a WHERE b >= {before} GROUP BY k),
        z AS (SELECT k, max(prev) AS shard FROM walk_b WHERE b >= {after} GROUP BY k)
        SELECT doc_id, a.shard AS shard_before, z.shard AS shard_after, a.shard <> z.shard AS moved
        FROM docs JOIN a USING (k) JOIN z USING (k)"""


SQL = _sql()
