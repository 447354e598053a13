"""Secret scans with structural confirmation.

Long runs of base64, base32 or hexadecimal letters are only candidates.  One is
reported if what it decodes to has the structure of a key or token: DER whose
nested lengths fill each other exactly and whose fields are those of a private
key, an OpenSSH key file, the JSON header and payload of a signed token with a
signature of the algorithm's length, a token whose checksum fits, an access key
id, or random bytes of full length that are the whole value of an assignment to
a name for secrets.  Encodings may be nested to any depth, as each level is
shorter than the one around it.  A name is looked for in the 40 letters before a
value, or in the 64 before the sign of an assignment without blanks.

A text is read in time proportional to its length, whatever is in it: the marks
of key blocks are found once and a block lies between two marks that follow each
other, so that a mark without a partner costs nothing.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .shared import bounded

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{18,}(?:\.[A-Za-z0-9_-]+){0,4}")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}PRIVATE KEY)-----")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\++[nrt/])*+")
_ESCAPED = re.compile(r"\\+([nrt/])")
_NAME = re.compile(r"(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)[\"']?\s*(?:=|:|=>)\s*$")
_NAMED = re.compile(r"(?i)(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)=")
#: A word for secrets anywhere in a name, but not in 'author' or 'tokenizer'.
_WORD = re.compile(r"(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?(?![a-z]|(?i:or|iz))")
_LEFT = re.compile(r"[\w.-]*[\"']?$")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){8,}")
_AWS = re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}")
_CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{36}")
_SIGNATURE = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 64), "none": (0, 0)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the elements that fill data[at:end] exactly; lengths
    must be definite and as short as DER wants them."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k])
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def key_structure(data: bytes) -> str | None:
    """Kind of the private key that ``data`` is, whole; else None."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 0
        while fields < 6:  # cipher, kdf, its options, [number of keys], public, private
            if fields == 3:
                at += 4
            if at + 4 > len(data):
                return None
            n = int.from_bytes(data[at : at + 4])
            at += 4 + n
            fields += 1
            if at > len(data):
                return None
            if fields == 5:
                break
        return "openssh_private_key" if at == len(data) else None
    top = der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    inner = der(data, top[0][1], top[0][2])
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return None
    version, tags = data[inner[0][1]], [t for t, _, _ in inner]
    if version == 0 and len(tags) == 9 and set(tags) == {0x02}:
        return "rsa_private_key"
    if version == 0 and len(tags) == 6 and set(tags) == {0x02}:
        return "dsa_private_key"
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = der(data, inner[1][1], inner[1][2])
        return "pkcs8_private_key" if algorithm and algorithm[0][0] == 0x06 else None
    if version == 1 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]) and len(tags) > 2:
        return "ec_private_key"
    return None


def _b64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if "=" in body or len(body) % 4 == 1 or len(text) - len(body) > 2:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _token(text: str) -> str | None:
    """Kind of the signed token that ``text`` is."""
    parts = text.split(".")
    if len(parts) not in (3, 5) or not parts[0].startswith("e"):
        return None
    raw = [_b64(p) for p in parts]
    if raw[0] is None:
        return None
    try:
        head = json.loads(raw[0])
        if not isinstance(head, dict) or not isinstance(alg := head.get("alg"), str):
            return None
        if len(parts) == 5:
            return "encrypted_token" if isinstance(head.get("enc"), str) and None not in raw else None
        if raw[1] is None or raw[2] is None or not isinstance(json.loads(raw[1]), dict):
            return None
    except (ValueError, RecursionError):
        return None
    low, high = _SIGNATURE.get(alg, (64, 1024))
    return "signed_token" if low <= len(raw[2]) <= high else None


def _random(data: bytes) -> bool:
    """Bytes without text, runs or counting: as many distinct values as chance gives."""
    return len(data) >= 8 and len(set(data)) >= min(len(data), 64) * 0.7 and not all(32 <= c < 127 for c in data) and len({(b - a) & 255 for a, b in zip(data, data[1:])}) > 3


def _blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name and body of every key block."""
    last = None
    for m in _MARK.finditer(text):
        if m.group(1) == "END" and last and last.group(1) == "BEGIN" and last.group(2) == m.group(2) and _BODY.fullmatch(text, last.end(), m.start()):
            yield last.start(), m.end(), m.group(2), text[last.end() : m.start()]
        last = m


def confirm(text: str, named: bool) -> str | None:
    """Kind of the secret that a candidate is, whole; ``named`` if it is the value
    of an assignment to a name for secrets."""
    if _AWS.fullmatch(text):
        return "access_key_id" if len(base64.b32decode(text[4:])) == 10 and len(set(text[4:])) > 5 else None
    if _CHECKED.fullmatch(text):
        n, digits = zlib.crc32(text[4:34].encode()), ""
        while n:
            n, r = divmod(n, 62)
            digits = _BASE62[r] + digits
        return "checksummed_token" if digits.rjust(6, "0") == text[34:] else None
    if kind := _token(text):
        return kind
    if "." in text:
        return None
    ways = []
    if _HEX.fullmatch(text):
        ways.append(("hex", bytes.fromhex(text)))
    elif len(text) >= 24 and (raw := _b64(text)) is not None:
        ways.append(("base64", raw))
    for _, data in ways:
        if kind := key_structure(data):
            return kind
        if data.isascii():
            inner = data.decode("ascii").strip()
            if block := next(_blocks(inner), None):
                if kind := confirm(re.sub(r"\s", "", _unescape(block[3])), False):
                    return kind
            elif re.fullmatch(r"[A-Za-z0-9+/_=.-]{18,}", inner) and (kind := confirm(inner, named)):
                return kind
    if named and ways and _random(ways[0][1]):
        return "assigned_" + ways[0][0]
    return None


def _unescape(body: str) -> str:
    """A key block's body with line ends that a string literal has escaped."""
    return _ESCAPED.sub(lambda m: {"n": "\n", "r": "\r", "t": "\t", "/": "/"}[m.group(1)], body).replace("\r\n", "\n")


def secrets(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of every confirmed secret of a text, in order."""
    out = []
    for start, end, name, body in _blocks(text) if "-----BEGIN" in text else ():
        body = _unescape(body)
        encrypted = "Proc-Type:" in body
        body = re.sub(r"\s", "", body.rpartition("\n\n")[2] if encrypted else body)
        data = _b64(body)
        kind = data and (key_structure(data) or ("encrypted_private_key" if "ENCRYPTED" in name and der(data, 0, len(data)) or encrypted and len(data) % 8 == 0 else None))
        if kind:
            out.append((start, end, kind))
    blocks, at = list(out), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(blocks) and blocks[at][1] <= start:
            at += 1
        if at < len(blocks) and blocks[at][0] < end:
            continue
        run, named = m.group(), False
        if n := _NAMED.match(run):  # password=... is one run of letters
            start, run, named = start + n.end(), run[n.end() :], True
        else:
            named = bool(_NAME.search(text[max(0, start - 40) : start].rstrip("\"'")))
        found = _confirmed(run, named)
        if not found and (sign := run.rfind("=", 0, len(run.partition(".")[0].rstrip("="))) + 1):
            # NAME=value without blanks is one run too; no value has a sign inside, so it follows the last one
            name = _LEFT.search(text[max(0, start + sign - 65) : start + sign - 1]).group()
            if found := _confirmed(run[sign:], bool(_WORD.search(name))):
                start += sign
        if found:
            tail, kind = found
            out.append((start, start + len(tail), kind))
    return sorted(out)


def _confirmed(run: str, named: bool) -> tuple[str, str] | None:
    """The secret that a run begins with, up to its end or a dot, and its kind."""
    if len(run) < 16:
        return None
    if kind := confirm(run, named):
        return run, kind
    if "." in run:  # the dot may belong to the sentence
        tail = run.split(".")[0]
        if kind := confirm(tail, named):
            return tail, kind
    return None


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (in characters, end excluded), kind, secret: one row for
    every confirmed secret of every row.

    Null and empty texts hold none, repeated rows report theirs again, texts are
    scanned to their end.  A run that decodes to nothing with a known structure
    is not reported.  No shuffle.  Only the two columns are used."""
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, s, e, k, t[s:e]) for i, t in enumerate(b.column(1).to_pylist()) if t for s, e, k in secrets(t)]
            at, start, end, kind, secret = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(secret, pa.string())], ["doc_id", "start", "end", "kind", "secret"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start bigint, end bigint, kind string, secret string")


QUERY = "op9_structural_secret_scan"


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
