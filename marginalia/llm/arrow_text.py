"""Word and n-gram hashing over whole Arrow batches.

A batch of texts becomes one array of code points; words are found, lower-cased
and hashed with a handful of numpy passes, so no Python loop walks a text.

A *word* is a maximal run of Unicode letters and digits, lower-cased code point
by code point: what ``regexp_split(lower(text), '[^\\p{L}\\p{N}]+')`` leaves once
empty strings are dropped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def folding() -> np.ndarray:
    """For each code point: its lower-case form if it belongs to a word, else 0."""
    import unicodedata

    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else ord(low[0])
    return table


#: Code points worked on at a time.  What is held beside the texts grows with
#: this, not with their length.
WINDOW = 1 << 20


def windows(texts, rows: int = 1 << 30):
    """The texts in groups of WINDOW code points (marks counted) and ``rows`` texts
    at most: the number of each text, its piece, and whether the last goes on in
    the next group, which only a text longer than a window does.  None is ''."""
    who: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        if pieces and (size + len(t) + 1 > WINDOW or len(pieces) >= rows):
            yield who, pieces, False
            who, pieces, size = [], [], 0
        at = 0
        while len(t) - at + 1 > WINDOW:
            yield [i], [t[at : at + WINDOW - 1]], True
            at += WINDOW - 1
        who.append(i)
        pieces.append(t[at:] if at else t)
        size += len(t) - at + 1
    if pieces:
        yield who, pieces, False


def code_points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a list of texts, each text followed by one 0, and the
    offset of each text and of the end."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    joined = "\0".join(pieces) + "\0" if pieces else ""
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lens)])


def ngram_hashes(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text and the index of the text of each.
    A text of fewer than n words has none."""
    lens = np.diff(offs)
    doc = np.repeat(np.arange(len(lens)), lens)
    if n == 1:
        return h, doc
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:m]
    for k in range(1, n):
        g = mix(g * _GOLD + h[k : k + m])
    inside = doc[:m] == doc[n - 1 :]
    return g[inside], doc[:m][inside]


#: Text worked on at a time; with the marks between texts below 2**20 letters, so
#: that the tables of powers stay at that size unless one text is longer.
SLICE_BYTES = 900_000


def slices(batches, most_bytes: int = 8 << 20, column: str = "text"):
    """Record batches cut so that their text column is about ``most_bytes`` long:
    bounds what a task holds at once, whatever the texts' lengths."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column(b.schema.get_field_index(column))
        import pyarrow.compute as pc

        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) + 64)
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most_bytes, "right")))
            yield b.slice(at, end - at)
            at = end
    trim()


def trim() -> None:
    """Gives memory that is free back to the system: Python workers live on after
    a task, and what they keep is lost to the next operator's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        pass


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point a random word for its lower-case form, 0 outside words."""
    low = folding()
    return np.where(low == 0, np.uint64(0), mix(low.astype(np.uint64) * _GOLD) | np.uint64(1))


_BASE = 0x9E6C63D0876A9A47


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, enough for a window."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.ones(WINDOW + 2, np.uint64)
        done, step = 1, base
        while done < len(out):  # the next as many are the first, times base**done
            more = out[done : 2 * done]
            more[:] = out[: len(more)] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
        both.append(out)
    return both[0], both[1]


def runs(texts, value: np.ndarray, also=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every maximal run of code points whose ``value`` isn't 0: a polynomial in
    the values, read off their running sum over a window, the length, and the
    number of the text, in order.  A run that windows cut is put together again.
    ``also`` is called with the numbers, code points and offsets of each window."""
    sums, lens, owners = [], [], []
    up, down = powers()
    on = False
    for who, pieces, goes_on in windows(texts):
        flat, offs = code_points(pieces)
        if also:
            also(np.array(who), flat, offs)
        v = value[flat]
        v[offs[1:] - 1] = 0
        inside = np.concatenate([[False], v != 0]).view(np.int8)
        edge = np.flatnonzero(inside[1:] != inside[:-1])  # the marks make the edges come in pairs
        starts, ends = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)])])
        s, n = (total[ends] - total[starts]) * down[starts], ends - starts
        owner = np.array(who)[np.searchsorted(offs, starts, "right") - 1]
        if on and len(starts) and starts[0] == 0:
            sums[-1][-1:] += np.uint64(pow(_BASE, int(lens[-1][-1]), 1 << 64) * int(s[0]) & (1 << 64) - 1)
            lens[-1][-1] += n[0]
            s, n, owner = s[1:], n[1:], owner[1:]
        if len(s):
            sums.append(s)
            lens.append(n)
            owners.append(owner)
        on = goes_on and len(ends) > 0 and bool(ends[-1] == offs[-1] - 1)
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sums), np.concatenate(lens), np.concatenate(owners)


def hash_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, each text's offsets, and the words' lengths.
    Works through the texts in windows, so that beside them only some eight bytes
    a word are held several times over."""
    if isinstance(texts, (pa.Array, pa.ChunkedArray)):
        texts = texts.to_pylist()
    s, n, owner = runs(texts, _letters())
    return mix(s + n.astype(np.uint64)), np.searchsorted(owner, np.arange(len(texts) + 1)), n
