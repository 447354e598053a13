"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point.  A
trigram's vector binds its letters' vectors, each permuted by its place (rotation,
then product); a text's profile bundles (adds) its trigrams' vectors; a text is
given the language whose prototype, the bundle of its training texts, is nearest
by cosine.

A bundle is linear in the trigram counts: profiles are products of counts and
the vectors of the trigrams that occur, worked out in windows of text and, within
them, a few thousand trigrams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import code_points, mix, slices, windows
from .shared import bounded

DIM = 1024
SEED = 7
#: Expected number of training documents per language; the one bounded sample here.
TRAIN_PER_LANGUAGE = 1000
#: Texts whose profiles are worked out together, and trigrams at a time.
_ROWS, _TRIGRAMS = 512, 4096
_POINT = np.int64(21)
_MASK = (1 << 21) - 1


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Code point -> symbol: the lower-case form of letters and of the marks that
    go with them, else 0."""
    import unicodedata

    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LM" and not 0xD800 <= cp < 0xE000:
            low = chr(cp).lower()
            out[cp] = ord(low[0])
    return out


def letters(points: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The vectors of symbols: the bits of a hash of symbol, place and seed."""
    words = -(-dim // 64)
    keys = np.asarray(points, np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(keys + np.uint64(1)) + np.uint64(seed)).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits[:, :dim].astype(np.int8) << 1) - 1


def trigram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of trigrams, each a code of three symbols."""
    codes = np.asarray(codes, np.int64)
    three = np.stack([codes >> 2 * _POINT, codes >> _POINT & _MASK, codes & _MASK])
    own, at = np.unique(three, return_inverse=True)
    at, v = at.reshape(three.shape), letters(own, dim)
    return (np.roll(v, 2, 1)[at[0]] * np.roll(v, 1, 1)[at[1]] * v[at[2]]).astype(np.float32)


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code of every trigram of symbols and its text's number, window by window;
    blanks are collapsed, one stands at a text's end and none at its start."""
    carry, of, on = np.zeros(0, np.int64), -1, False
    for who, pieces, goes_on in windows(texts, _ROWS):
        flat, offs = code_points(pieces)
        s, doc = _symbols()[flat].astype(np.int64), np.repeat(who, np.diff(offs))
        if goes_on:  # no mark there: the text's end comes in a later window
            s, doc = s[:-1], doc[:-1]
        n = len(carry) if on else 0
        if n:
            s, doc = np.concatenate([carry, s]), np.concatenate([np.full(n, of), doc])
        keep = (s != 0) | (np.concatenate([[0], s[:-1]]) != 0)
        keep[:n] = True
        s, doc = s[keep], doc[keep]
        of, on = who[-1], goes_on
        carry = s[-2:][doc[-2:] == of]
        if len(s) >= 3:
            code = s[:-2] << 2 * _POINT | s[1:-1] << _POINT | s[2:]
            inside = doc[:-2] == doc[2:]
            yield code[inside], doc[:-2][inside]


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the place of each in them."""
    seen = np.zeros(_MASK + 1, bool)
    for k in (2 * _POINT, _POINT, np.int64(0)):
        seen[code >> k & _MASK] = True
    own = np.flatnonzero(seen)
    if len(own) > 128:
        return np.unique(code, return_inverse=True)
    small = np.zeros(_MASK + 1, np.int32)  # an alphabet: trigrams are numbered in a table
    small[own] = np.arange(len(own))
    short = small[code >> 2 * _POINT] << 14 | small[code >> _POINT & _MASK] << 7 | small[code & _MASK]
    there = np.zeros(1 << 21, bool)
    there[short] = True
    which = np.flatnonzero(there)
    place = np.zeros(1 << 21, np.int32)
    place[which] = np.arange(len(which))
    return own[which >> 14] << 2 * _POINT | own[which >> 7 & 127] << _POINT | own[which & 127], place[short]


def profiles(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The sum of each text's trigram vectors."""
    out = np.zeros((len(texts), dim), np.float32)
    for code, doc in trigrams(texts):
        if not len(code):
            continue
        which, place = _distinct(code)
        low, n = int(doc[0]), int(doc[-1] - doc[0]) + 1
        for at in range(0, len(which), _TRIGRAMS):
            vectors = trigram_vectors(which[at : at + _TRIGRAMS], dim)
            mine = (place >= at) & (place < at + _TRIGRAMS) if len(which) > _TRIGRAMS else slice(None)
            cells = n * len(vectors)
            key = (doc[mine] - low) * len(vectors) + (place[mine] - at)
            if cells <= 16 * len(key):
                out[low : low + n] += np.bincount(key, minlength=cells).reshape(n, len(vectors)).astype(np.float32) @ vectors
                continue
            key, times = np.unique(key, return_counts=True)
            for a in range(0, len(key), 8192):  # most counts are 0: only the others are multiplied
                row, col = np.divmod(key[a : a + 8192], len(vectors))
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[low + row[first]] += np.add.reduceat(vectors[col] * times[a : a + 8192, None].astype(np.float32), first, 0)
    return out


def train(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit prototypes.  Of each language a sample
    of ``per_language`` documents in expectation, chosen by a hash of the id, is
    bundled; rows without a label are left out, null and empty texts add nothing,
    repeated rows count as often as they occur, rows of a null id are sampled
    together, and a table without rows gives a model without languages.  What
    reaches the driver are trigram counts of that sample."""
    src = bounded(docs).select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("label IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in src.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, dim), np.float32)
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 30, -(-per_language * (1 << 30) // n)))])
    sample = src.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit[F.col("label")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20):
            labels = b.column(0).dictionary_encode()
            of = np.asarray(labels.indices).astype(np.int64)
            for code, doc in trigrams(b.column(2).to_pylist()):
                which, place = _distinct(code)
                key, n = np.unique(of[doc] * len(which) + place, return_counts=True)
                if len(key):
                    yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(key // len(which))), pa.array(which[key % len(which)]), pa.array(n)], ["label", "code", "n"])

    rows = sample.mapInArrow(count, "label string, code bigint, n bigint").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sizes)
    out = np.zeros((len(names), dim), np.float64)
    for i, name in enumerate(names):
        mine = rows[rows.label == name]
        code, n = mine.code.to_numpy(np.int64), mine.n.to_numpy(np.float64)
        for at in range(0, len(code), _TRIGRAMS):
            out[i] += n[at : at + _TRIGRAMS] @ trigram_vectors(code[at : at + _TRIGRAMS], dim)
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def classify(texts, names: list[str], prototypes: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language, its cosine and that of the runner-up for each text."""
    texts = texts.to_pylist() if isinstance(texts, (pa.Array, pa.ChunkedArray)) else list(texts)
    n = len(texts)
    if not names or not n:
        return [None] * n, np.full(n, np.nan), np.full(n, np.nan)
    profile = profiles(texts, prototypes.shape[1])
    norm = np.linalg.norm(profile, axis=1)
    cos = profile @ prototypes.T / np.maximum(norm, 1e-12)[:, None]
    best = cos.argmax(1)
    top = cos[np.arange(n), best].astype(np.float64)
    cos[np.arange(n), best] = -2
    second = cos.max(1).astype(np.float64)
    some = norm > 0
    return [names[b] if ok else None for b, ok in zip(best, some)], np.where(some, top, np.nan), np.where(some & (second > -2), second, np.nan)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, language, cosine, runner_up (its cosine): one row per row.

    Texts without a trigram of letters (null, empty, digits) and any text under a
    model without languages get nulls; of languages at the same cosine the first
    by name.  Repeated rows get equal rows, texts are read to their end and a table
    without rows gives none.  No shuffle.  Of the input only the two columns are used."""
    names, prototypes = model
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            lang, top, second = classify(b.column(1), names, prototypes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(top, from_pandas=True), pa.array(second, from_pandas=True)], ["doc_id", "language", "cosine", "runner_up"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, language string, cosine double, runner_up double")


QUERY = "op8_hyperdimensional_language_id"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", "language", F.round("cosine", 4).alias("cosine"), F.round("runner_up", 4).alias("runner_up"))
