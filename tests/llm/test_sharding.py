import hashlib

import numpy as np
import pytest

from marginalia.llm import sharding as J
from tests.llm.odd import EXTRA, ROWS, SCHEMA, frame


def jump(key, n):
    """The published loop, a key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_loop():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 7, 64, 80, 1000):
        assert J.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        J.jump(keys, 0)


def test_only_the_necessary_fraction_moves():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64)
    a, b = J.jump(keys, 64), J.jump(keys, 80)
    assert abs((a != b).mean() - 0.2) < 0.01 and (b[a != b] >= 64).all()
    assert np.bincount(b, minlength=80).std() < 0.05 * len(keys) / 80 * 2


def test_rows(spark, tmp_path):
    df = frame(spark)
    out = J.assign(df, shards=10)
    assert out.columns == df.columns and out.count() == len(ROWS)
    for r in out.collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == jump(int(hashlib.md5(key.encode()).hexdigest()[:16], 16), 10)
        assert all(r[k] == v for k, v in EXTRA.items() if k != "shard")
    moved = J.moves(df).collect()
    assert len(moved) == len(ROWS) and all(r["moved"] == (r["shard_before"] != r["shard_after"]) for r in moved)
    assert J.assign(spark.createDataFrame([], SCHEMA)).collect() == []
    J.write_sharded(df.drop("shard", "a.b"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and {r["shard"] for r in back.collect()} <= set(range(4))
