import gzip
import io
import random

import pytest

from marginalia.llm import warc as W
from tests.llm.odd import EXTRA, words


def file_of(payloads):
    out, starts = bytearray(), []
    for i, p in enumerate(payloads):
        starts.append(len(out))
        out += W.member("resource", f"<urn:row:{i}>", p, f"http://x/{i}")
    return bytes(out), starts


def owned(data, split):
    got = []
    for a in range(0, len(data), split):
        got += [(at, body) for at, _, body in W.scan(io.BytesIO(data), len(data), a, min(a + split, len(data)))]
    return got


@pytest.mark.parametrize("split", [50, 333, 4096, 70_000, 10**7])
def test_every_record_once(split):
    rng = random.Random(split)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 300, 3000]))) for _ in range(60)]
    payloads += [gzip.compress(b"WARC/1.1 but no record" + payloads[3]), W.MAGIC * 50, rng.randbytes(150_000)]
    data, starts = file_of(payloads)
    assert owned(data, split) == list(zip(starts, payloads))


@pytest.mark.parametrize("split", [2000, 5000])
def test_members_inside_a_stored_payload(split):
    rng = random.Random(1)
    inner, _ = file_of([rng.randbytes(500) for _ in range(2)])
    payloads = [rng.randbytes(2000), inner, rng.randbytes(2000), *(rng.randbytes(900) for _ in range(30))]
    data, starts = file_of(payloads)
    assert owned(data, split) == list(zip(starts, payloads))


def test_damage_is_passed_over():
    payloads = [words(i, 50).encode() for i in range(30)]
    data, starts = file_of(payloads)
    broken = bytearray(data)
    broken[starts[10] + 30 : starts[10] + 60] = bytes(30)
    got = owned(bytes(broken), len(data))
    assert got == [(s, p) for k, (s, p) in enumerate(zip(starts, payloads)) if k != 10]
    assert owned(data[: starts[20] + 15], len(data)) == list(zip(starts, payloads))[:20]
    assert owned(b"", 100) == [] and owned(b"no archive", 100) == []


def test_many_records_in_a_member():
    def plain(i, p):
        return W._header([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", str(len(p)))]) + p + b"\r\n\r\n"

    body = b"".join(plain(i, b"x" * i) for i in range(5))
    assert [len(p) for _, p in W.records(body)] == [0, 1, 2, 3, 4]
    assert W.records(body[:-6]) is None and W.records(b"") is None and W.records(b"WARC/1.1\r\n\r\n\r\n") is None


def test_round_trip(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h/{i}", words(i, 30)) for i in range(40)]
    rows += [(None, None, None), (None, "u", ""), (41, "http://a b/ü\n", "é"), (42, None, "x" * 3_000_000), (43, "", "y"), (43, "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    got = W.roundtrip(df, split_bytes=700).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), str(r["html"]), r["content_length"]) for r in got) == sorted((str(a), str(b), str(c), len((c or "").encode())) for a, b, c in rows)
    assert W.roundtrip(df.limit(0)).collect() == []


def test_load_finds_the_files_below_a_folder(spark, tmp_path):
    rows = [(i, f"http://h/{i}", words(i, 30)) for i in range(25)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    W.write(df, f"file://{tmp_path}/a/b")
    (tmp_path / "other.txt").write_bytes(W.member("resource", "<urn:row:9>", b"x"))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "cut.warc.gz").write_bytes(W.member("resource", "<urn:row:77>", b"whole") + W.member("resource", "<urn:row:78>", b"broken")[:-9])
    want = sorted([(f"<urn:row:{i}>", t.encode()) for i, _, t in rows[:25]] + [("<urn:row:>", b""), ("<urn:row:77>", b"whole")])
    for split in (200, 10**7):
        got = W.load(spark, str(tmp_path), split).where("record_type = 'resource'").collect()
        assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == want


def damaged_and_nested():
    """Archives with a broken member or padding every few records, and with
    archives of many members stored in a payload, nested twice."""
    rng = random.Random(2)
    data, starts = file_of([rng.randbytes(rng.choice([40, 400, 900])) for _ in range(40)])
    broken = bytearray(data)
    for k in range(1, 40, 3):
        broken[starts[k] + 20 : starts[k] + 40] = bytes(20)
    padded = b"".join(data[a:b] + (b"\0" * 7 if k % 3 == 0 else b"") for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)])))
    inner, _ = file_of([rng.randbytes(300) for _ in range(12)])
    middle, _ = file_of([rng.randbytes(200), inner, *(rng.randbytes(100) for _ in range(6))])
    nested, _ = file_of([rng.randbytes(500), middle, inner, b"x", middle, *(rng.randbytes(300) for _ in range(8))])
    return [bytes(broken), padded, nested, nested + bytes(broken) + nested[: len(nested) // 2]]


@pytest.mark.parametrize("split", [97, 500, 1000, 1531, 2500, 4096, 9000])
def test_damage_and_nesting_do_not_depend_on_the_split(split):
    for data in damaged_and_nested():
        assert owned(data, split) == owned(data, len(data))


def test_read_damage_and_nesting_at_any_split(spark, tmp_path):
    sizes, want = [], []
    for k, data in enumerate(damaged_and_nested()):
        path = tmp_path / f"{k}.warc.gz"
        path.write_bytes(data)
        sizes.append((str(path), len(data)))
        want += [(str(path), at, body) for at, body in owned(data, len(data))]
    files = spark.createDataFrame(sizes, "path string, length long")
    for split in (700, 3000, 9000, 10**6):
        got = sorted((r["path"], r["offset"], bytes(r["payload"])) for r in W.read(spark, files, split).collect())
        assert got == sorted(want)
