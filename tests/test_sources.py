import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.sources import container, document, markup
from tests.make import BODY, COMMENTS, EXTENDED, archive, f0


def one(data, key="comments", path="f"):
    out = document.rows(path, data)
    assert out["error_kind"] is None, out["message"]
    return out[key]


def message(data):
    return document.rows("f", data)["message"]


def test_f0():
    rows = one(f0())
    assert [(r["id"], r["author"], r["text"], r["paragraph_style"], r["para_id"]) for r in rows] == [
        (0, "Nora Quill", "The second figure lacks a unit.", "Remark", "7C31E5B1"),
        (1, "Ivo Brandt", "It is in kilograms, I add it.", "", "7C31E5B2"),
        (2, "Nora Quill", "Now the table agrees with it.", "", "7C31E5B3"),
    ]
    assert one(f0(), "anchors") == [{"id": 0, "anchor_text": "Loads above forty are carried by two frames."}]
    assert [r["done"] for r in one(f0(), "comments_ex")] == [False, False, True]


def test_deflate_note_and_zip64_give_the_same():
    assert one(f0(8)) == one(f0()) == one(f0(0, b"a note"))
    plain = f0()
    end = plain.rfind(b"PK\5\6")
    count, size, where = struct.unpack_from("<H", plain, end + 10)[0], *struct.unpack_from("<II", plain, end + 12)
    far = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, where)
    wide = plain[:end] + far + b"PK\6\7" + struct.pack("<IQI", 0, end, 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert one(wide) == one(plain)


def test_zip64_sizes():
    data = bytearray(container.pack([(document.COMMENTS, COMMENTS)]))
    at = data.rfind(b"PK\1\2")
    data[at + 24 : at + 28] = b"\xff" * 4
    data[at + 30 : at + 32] = struct.pack("<H", 12)
    name_end = at + 46 + len(document.COMMENTS)
    data[name_end:name_end] = struct.pack("<HHQ", 1, 8, len(COMMENTS))
    end = data.rfind(b"PK\5\6")
    struct.pack_into("<I", data, end + 12, end - at)
    assert len(one(bytes(data))) == 3


def test_container_errors():
    assert message(None) == "Cannot open file: f"
    assert message(b"") == "mmap failed: f"
    assert message(b"PK" * 5) == "File too small to be a ZIP archive"
    assert message(bytes(100)) == "EOCD signature not found — not a valid ZIP"
    assert message(container.pack([(document.COMMENTS, b"")])) == "Failed to parse word/comments.xml"
    assert message(container.pack([(document.COMMENTS, b"<x/>")], 12)) == "Unsupported compression method 12 in: word/comments.xml"
    good = bytearray(container.pack([(document.COMMENTS, COMMENTS)], 8))
    at = good.find(b"word/comments.xml") + 17
    good[at : at + 8] = b"\xff" * 8
    assert message(bytes(good)).startswith("inflate failed (")
    broken = bytearray(f0())
    broken[broken.find(b"PK\1\2")] = 0
    assert message(bytes(broken)) == "Central directory entry signature mismatch"
    broken = bytearray(container.pack([(document.COMMENTS, COMMENTS)]))
    broken[0] = 0
    assert message(bytes(broken)) == "Local file header signature mismatch for: word/comments.xml"
    assert [document.rows("f", x)["error_kind"] for x in (b"", container.pack([(document.COMMENTS, b"")]), bytes(broken))] == ["file", "format", "container"]


def test_checksum_is_ignored_and_last_name_wins():
    data = bytearray(container.pack([(document.COMMENTS, COMMENTS)]))
    at = data.rfind(b"PK\1\2")
    data[at + 16 : at + 20] = b"\1\2\3\4"
    assert len(one(bytes(data))) == 3
    twice = container.pack([(document.COMMENTS, b"<x/>"), (document.COMMENTS, COMMENTS)])
    assert len(one(twice)) == 3


def test_no_comments_part():
    assert one(container.pack([("a", b"b")])) == []
    assert one(container.pack([(document.COMMENTS, b"<c/>"), (document.BODY, BODY)]), "anchors") == []


def test_short_stored_entry_is_padded():
    data = bytearray(container.pack([("a", b"xyz")]))
    at = data.rfind(b"PK\1\2")
    data[at + 24 : at + 28] = struct.pack("<I", 5)
    e = container.directory(bytes(data))[0]
    assert container.content(bytes(data), e) == b"xyz\0\0"


@pytest.mark.parametrize(("raw", "want"), [(b" 7", 7), (b"+8", 8), (b"9abc", 9), (b"-3", -3), (b"x", None), (b"", None), (b"2147483648", None), (b"-2147483648", -(1 << 31))])
def test_numbers(raw, want):
    assert document.number(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("A &amp; B &lt;x&gt; &#233; &#x20AC; &#128512;", "A & B <x> é € 😀"),
        ("a & b", "a & b"),
        ("&foo;", "&foo;"),
        ("a & b &amp; c", "a & b &amp; c"),
        ("&#X41;|", "\0|"),
        ("&quot;&apos;", "\"'"),
    ],
)
def test_references(raw, want):
    assert markup.unescape(raw.encode()).decode() == want


def test_text_rules():
    raw = '<c><comment id="1"><p paraId="P"><r><t><![CDATA[a<b&amp;]]></t><tab/><delText>gone</delText></r></p><p><pPr><pStyle val="S2"/></pPr><r><t>two</t></r></p></comment></c>'
    (row,) = one(archive([], raw_comments=raw))
    assert (row["text"], row["paragraph_style"], row["para_id"]) == ("a<b&amp;two", "S2", "P")
    nested = "<c><comment id=0><p><r><t>x</r></p></c><comment id='1'><p><r><t>y</t></r></p></comment></c>"
    assert [(r["id"], r["text"]) for r in one(archive([], raw_comments=nested))] == []
    nested = '<c><comment id="0"><p><r><t>x</r></p></comment><comment id="1"><p><r><t>y</t></r></p></comment></c>'
    assert [(r["id"], r["text"]) for r in one(archive([], raw_comments=nested))] == [(0, "xy")]


def test_lenient_tokens():
    data = b"<?xml x?><!DOCTYPE a [<!ELEMENT b>]><a:b c='1' d e=\"2\" !f><!-- <x> --></z:b></y>tail<"
    got = [(w, v, f) for w, v, f in markup.events(data)]
    assert got == [("start", b"b", [(b"c", b"1"), (b"e", b"2")]), ("end", b"b", []), ("end", b"y", []), ("text", b"tail", [])]
    assert list(markup.events(b"<a")) == [("start", b"a", [])]
    assert list(markup.events(b"< a>x")) == [("text", b"x", [])]
    assert list(markup.events(b"<a b='1")) == [("start", b"a", [(b"b", b"")])]


def anchored(body):
    ids = [(i, f"P{i}", "t") for i in (1, 2)]
    return {r["id"]: r["anchor_text"] for r in one(archive(ids, body=body), "anchors")}


def s(i):
    return f'<commentRangeStart id="{i}"/>'


def e(i):
    return f'<commentRangeEnd id="{i}"/>'


def r(x):
    return f"<r><t>{x}</t></r>"


def test_anchor_ranges():
    assert anchored(s(1) + r("A") + s(2) + r("B") + e(1) + r("C") + e(2)) == {1: "AB", 2: "BC"}
    assert anchored("<r>X" + s(1) + "Y</r><r>Z</r>" + e(1) + s(2) + "<r>A</r><r>B" + e(2) + "C</r>") == {1: "XYZ", 2: "A"}
    assert anchored(s(1) + "<r>out1<r>in</r>out2</r>" + e(1)) == {1: "in"}
    assert anchored(s(1) + r("a")) == {}
    assert anchored(r("a") + e(1)) == {}
    assert anchored(s(1) + r("p") + e(1) + s(1) + r("q") + e(1)) == {1: "q"}
    assert anchored("<p>" + s(1) + r("A") + "</p><p>" + r("B") + e(1) + "</p>") == {1: "AB"}
    assert anchored(s(1) + "<r><delText>gone</delText></r>" + e(1)) == {1: "gone"}


def test_extended_rules():
    rows = one(archive([(0, "P0", "x")], ex=[("P0", "", "true"), ("P0", "Q", "1")]), "comments_ex")
    assert [(x["para_id_parent"], x["done"]) for x in rows] == [("", False), ("Q", True)]
    assert [x["done"] for x in document.extended(EXTENDED)] == [False, False, True]


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_any_text_survives(text):
    raw = f'<c><comment id="1" author="{markup.escape(text)}"><p><r><t>{markup.escape(text)}</t></r></p></comment></c>'
    (row,) = one(archive([], raw_comments=raw.encode()))
    assert row["text"] == text and row["author"] == text


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes_are_tokenized(data):
    list(markup.events(data))
    document.rows("f", data)
    document.rows("f", container.pack([(document.COMMENTS, data), (document.EXTENDED, data), (document.IDS, data), (document.BODY, data)]))


@given(st.binary(max_size=300), st.sampled_from([0, 8]))
@settings(deadline=None)
def test_containers_round_trip(data, method):
    packed = container.pack([("x", data), ("y/z", data[::-1])], method)
    assert [container.content(packed, e) for e in container.directory(packed)] == [data, data[::-1]]
    assert container.directory(packed)[0].crc32 == zlib.crc32(data)
