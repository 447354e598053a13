"""ZIP containers, read leniently: only the central directory counts, checksums
and encryption flags are not looked at, and the last of equal names wins."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_FULL = 0xFFFFFFFF


class ContainerError(Exception):
    """The bytes are no readable container."""


class Entry(NamedTuple):
    name: str
    method: int
    crc32: int
    compressed_size: int
    size: int
    offset: int


def _wide(extra: bytes, sizes: list[int]) -> list[int]:
    """Sizes and offset with their 64-bit values where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            out, at = [], at + 4
            for v in sizes:
                if v == _FULL and at + 8 <= len(extra):
                    (v,) = struct.unpack_from("<Q", extra, at)
                    at += 8
                out.append(v)
            return out
        at += 4 + n
    return sizes


def directory(data: bytes) -> list[Entry]:
    """All entries, in the order of the central directory."""
    if len(data) < 22:
        raise ContainerError("File too small to be a ZIP archive")
    end = data.rfind(_END, max(0, len(data) - 22 - 0xFFFF), len(data) - 18)
    if end < 0:
        raise ContainerError("EOCD signature not found — not a valid ZIP")
    count, at = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0]
    if end >= 20 and data[end - 20 : end - 16] == _LOCATOR:
        (far,) = struct.unpack_from("<Q", data, end - 12)
        if far + 56 <= len(data) and data[far : far + 4] == _END64:
            count, at = struct.unpack_from("<Q", data, far + 32)[0], struct.unpack_from("<Q", data, far + 48)[0]
    entries = []
    for _ in range(count):
        if at + 46 > len(data) or data[at : at + 4] != _ENTRY:
            raise ContainerError("Central directory entry signature mismatch")
        method = struct.unpack_from("<H", data, at + 10)[0]
        crc, packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", data, at + 16)
        (offset,) = struct.unpack_from("<I", data, at + 42)
        body = at + 46
        size, packed, offset = _wide(data[body + n_name : body + n_name + n_extra], [size, packed, offset])
        entries.append(Entry(data[body : body + n_name].decode("utf-8", "replace"), method, crc, packed, size, offset))
        at = body + n_name + n_extra + n_note
    return entries


def opened(path: str, data: bytes | None) -> list[Entry]:
    """The entries of a file's bytes; None stands for a file that can't be opened."""
    if data is None:
        raise ContainerError(f"Cannot open file: {path}")
    if not data:
        raise ContainerError(f"mmap failed: {path}")
    return directory(data)


def content(data: bytes, entry: Entry, room: int | None = None) -> bytes:
    """An entry's bytes, as many as the directory declares (zeros if there are
    fewer).  With ``room`` as many as there are, up to that number."""
    most = entry.size if room is None else room
    at, name = entry.offset, entry.name
    if at + 30 > len(data) or data[at : at + 4] != _LOCAL:
        raise ContainerError(f"Local file header signature mismatch for: {name}")
    n_name, n_extra = struct.unpack_from("<HH", data, at + 26)
    at += 30 + n_name + n_extra
    raw = data[at : at + entry.compressed_size]
    if entry.method == 0:
        if entry.compressed_size > most:
            raise ContainerError(f"Buffer too small for stored entry: {name}")
        return raw if room is not None else raw.ljust(entry.size, b"\0")
    if entry.method != 8:
        raise ContainerError(f"Unsupported compression method {entry.method} in: {name}")
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(raw, most + 1)
    except zlib.error as e:
        code = str(e).partition("Error ")[2].partition(" ")[0] or "-3"
        raise ContainerError(f"inflate failed ({code}) for: {name}") from None
    if not z.eof or len(out) > most:
        raise ContainerError(f"inflate failed (-5) for: {name}")
    return out if room is not None else out.ljust(entry.size, b"\0")


def pack(files: list[tuple[str, bytes]], method: int = 0, note: bytes = b"", wide: bool = False) -> bytes:
    """A container of (name, bytes); method 0 stores, 8 deflates, others only claim
    to.  ``wide`` writes sizes, offsets and the directory's place as ZIP64 does."""
    out, central = bytearray(), bytearray()
    for name, body in files:
        raw, crc, where = name.encode(), zlib.crc32(body), len(out)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(body) + z.flush() if method == 8 else body
        out += _LOCAL + struct.pack("<HHHHHIIIHH", 20, 0, method, 0, 33, crc, len(packed), len(body), len(raw), 0) + raw + packed
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(packed), where) if wide else b""
        sizes = (_FULL, _FULL) if wide else (len(packed), len(body))
        central += _ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, method, 0, 33, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, _FULL if wide else where) + raw + extra
    if wide:
        end = len(out) + len(central)
        far = _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(files), len(files), len(central), len(out))
        return bytes(out + central + far + _LOCATOR + struct.pack("<IQI", 0, end, 1) + _END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, len(note)) + note)
    return bytes(out + central + _END + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(central), len(out), len(note)) + note)
