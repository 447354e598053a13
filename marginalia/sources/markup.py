"""A lenient tokenizer for XML bytes: never fails, checks no nesting, knows no
namespaces (names lose their prefix) and no entities beyond the five."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAMED = {b"amp": b"&", b"lt": b"<", b"gt": b">", b"quot": b'"', b"apos": b"'"}
_REFERENCE = re.compile(rb"&([^;]*);")
_NAME = re.compile(rb"[A-Za-z_:\x80-\xff][A-Za-z_:\x80-\xff0-9.-]*")
_BLANK = re.compile(rb"[ \t\r\n]*")
_HEX, _DEC = re.compile(rb"[ \t\n\v\f\r]*\+?(?:0[xX])?([0-9a-fA-F]+)"), re.compile(rb"[ \t\n\v\f\r]*\+?([0-9]+)")


def _utf8(point: int) -> bytes:
    """UTF-8 by the bit pattern alone, surrogates and points past the end included."""
    if point < 0x80:
        return bytes([point])
    if point < 0x800:
        return bytes([0xC0 | point >> 6, 0x80 | point & 63])
    if point < 0x10000:
        return bytes([0xE0 | point >> 12, 0x80 | point >> 6 & 63, 0x80 | point & 63])
    return bytes([(0xF0 | point >> 18) & 255, 0x80 | point >> 12 & 63, 0x80 | point >> 6 & 63, 0x80 | point & 63])


def _replace(m: re.Match) -> bytes:
    ref = m.group(1)
    if ref in _NAMED:
        return _NAMED[ref]
    if not ref.startswith(b"#"):
        return m.group()
    number = _HEX.match(ref, 2) if ref[1:2] == b"x" else _DEC.match(ref, 1)
    value = int(number.group(1), 16 if ref[1:2] == b"x" else 10) if number else 0
    return _utf8(min(value, (1 << 64) - 1))


def unescape(raw: bytes) -> bytes:
    """References replaced; an unknown one stays, up to the next semicolon."""
    return _REFERENCE.sub(_replace, raw) if b"&" in raw else raw


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _local(name: bytes) -> bytes:
    return name.partition(b":")[2] if b":" in name else name


def _attributes(data: bytes, at: int) -> tuple[list[tuple[bytes, bytes]], bool, int]:
    """Attributes from ``at`` to the tag's end, whether it closes itself, and where it ends."""
    found, n = [], len(data)
    while True:
        at = _BLANK.match(data, at).end()
        if at >= n:
            return found, False, n
        if data[at] == 0x3E:
            return found, False, at + 1
        if data.startswith(b"/>", at):
            return found, True, at + 2
        name = _NAME.match(data, at)
        if not name:
            at += 1
            continue
        at = _BLANK.match(data, name.end()).end()
        if data[at : at + 1] != b"=":
            continue
        at = _BLANK.match(data, at + 1).end()
        value, quote = b"", data[at : at + 1]
        if quote in (b'"', b"'") and quote:
            end = data.find(quote, at + 1)
            if end < 0:
                at = n
            else:
                value, at = unescape(data[at + 1 : end]), end + 1
        found.append((_local(name.group()), value))


def events(data: bytes) -> Iterator[tuple[str, bytes, list[tuple[bytes, bytes]]]]:
    """("text", bytes, []), ("start", local name, attributes) and ("end", local
    name, []), in order."""
    at, n = 0, len(data)
    while at < n:
        if data[at] != 0x3C:
            end = data.find(b"<", at)
            end = n if end < 0 else end
            if text := unescape(data[at:end]):
                yield "text", text, []
            at = end
        elif at + 1 >= n:
            return
        elif data.startswith(b"<!--", at):
            end = data.find(b"-->", at + 4)
            at = end + 3 if end >= 0 else max(at + 4, n - 2)
        elif data.startswith(b"<![CDATA[", at):
            end = data.find(b"]]>", at + 9)
            stop = end if end >= 0 else max(at + 9, n - 2)
            if stop > at + 9:
                yield "text", data[at + 9 : stop], []
            at = end + 3 if end >= 0 else stop
        elif data.startswith(b"<?", at):
            end = data.find(b"?>", at + 2)
            at = end + 2 if end >= 0 else max(at + 2, n - 1)
        elif data.startswith(b"<!DOCTYPE", at):
            depth, at = 1, at + 2
            for m in re.compile(rb"[<>]").finditer(data, at):
                depth += 1 if m.group() == b"<" else -1
                at = m.end()
                if not depth:
                    break
            at = n if depth else at
        elif data[at + 1] == 0x2F:
            name = _NAME.match(data, at + 2)
            at = _BLANK.match(data, name.end() if name else at + 2).end()
            at += data[at : at + 1] == b">"
            yield "end", _local(name.group()) if name else b"", []
        elif name := _NAME.match(data, at + 1):
            found, closed, at = _attributes(data, name.end())
            local = _local(name.group())
            yield "start", local, found
            if closed:
                yield "end", local, []
        else:
            end = data.find(b">", at + 1)
            at = n if end < 0 else end + 1
