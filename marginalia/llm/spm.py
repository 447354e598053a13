"""SentencePiece encoding and decoding in batches.

Words of equal length advance together through one Viterbi pass: the hashes of
all their substrings probe the sorted hashes of the vocabulary, and for each end
position a maximum over piece lengths stores the backpointers.

* Unigram models: the score of a path is the sum of its pieces' scores.
* BPE models: merges are not a sum of scores, yet a segmentation is the one BPE
  makes if and only if BPE leaves every pair of neighbours in it apart.  A step
  from piece a to piece b is therefore admitted exactly when BPE splits the text
  of a+b into (a, b), and the one admitted step wins the maximum.  To tell it,
  the merges that made a and b are taken back, the latest first, along a's right
  and b's left edge: the pair falls if at any moment the two pieces that meet
  would have been merged before the merge just taken back.  The tree of merges of
  each piece is an array; whole arrays of pairs walk down together.

Words that start with more than one blank, and very long ones, go through the
merge loop itself.  Both ways give the ids of the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import WINDOW, code_points, mix, powers, slices, trim
from .shared import bounded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE_POINT = ord(SPACE)
_BLANK = re.compile(f"[^{SPACE}]{SPACE}")
LONGEST = 48
#: Words a worker remembers before it starts afresh; bounds memory only.
REMEMBER = 600_000
#: Text encoded at a time, and new words.
SLICE_BYTES = 1_000_000
ROWS = 5000
_BASE = np.uint64(0x9E6C63D0876A9A47)
_BITS = 20
_CACHE_BITS = 21
_PAIR_BITS = 22
_NEVER = float("inf")


def _text_hash(c: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(np.ascontiguousarray(c).tobytes(), digest_size=8).digest())


class Model:
    """A parsed model file.  Refuses models with a character map or whitespace
    removal, and those with user-defined pieces: their normalisation isn't done here."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        norm, trainer = m.normalizer_spec, m.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation are supported")
        self.bpe, self.dummy = trainer.model_type == 2, norm.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        kind = [p.type for p in m.pieces]
        if 4 in kind:
            raise ValueError("models with user-defined pieces are not supported")
        self.n = len(kind)
        self.score = np.array([p.score for p in m.pieces], np.float64)
        self.id = {p: i for i, p in enumerate(self.text) if kind[i] == 1}
        self.rank = {p: -self.score[i] for p, i in self.id.items()}
        self.unk = kind.index(2)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.text) if kind[i] == 6}
        self.control = {i for i in range(self.n) if kind[i] == 3}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.most = max(map(len, self.id), default=1)
        self.low = (self.score[list(self.id.values())].min() if self.id else 0.0) - 10.0
        by_length: dict[int, list[str]] = {}
        for p in self.id:
            by_length.setdefault(len(p), []).append(p)
        keys = [self._hash(self._chars(same), k)[:, 0] for k, same in by_length.items()]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id[p] for same in by_length.values() for p in same], np.int64)[order]
        self.hint = np.zeros(1 << _BITS, bool)
        self.hint[self.keys >> np.uint64(64 - _BITS)] = True
        self.letter = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
        if self.bpe:
            self._grow_trees()
            self.verdict = np.full(1 << _CACHE_BITS, -1, np.int64)
        self._find_marks()
        bodies = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.body_len = np.array([len(b) for b in bodies], np.int64)
        self.body_at = np.concatenate([[0], np.cumsum(self.body_len)[:-1]])
        self.body = np.frombuffer(b"".join(bodies), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drops the words seen so far: their hashes, sorted, and where in ``flat``
        the ids of each are."""
        self.known = np.zeros(0, np.uint64)
        self.at, self.len, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # -- hashing -----------------------------------------------------------
    @staticmethod
    def _chars(words: list[str]) -> np.ndarray:
        """Words of one length as rows of code points."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), len(words[0]))

    @classmethod
    def _hash(cls, chars: np.ndarray, size: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all substrings of ``size`` letters of the rows."""
        if prefix is None:
            prefix = cls._prefix(chars)
        return prefix[:, size:] - prefix[:, : prefix.shape[1] - size] * np.uint64(pow(int(_BASE), size, 1 << 64))

    @staticmethod
    def _prefix(chars: np.ndarray) -> np.ndarray:
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        m = mix(chars.astype(np.uint64) + np.uint64(1))
        for k in range(chars.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + m[:, k]
        return out

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Piece id of every hash, -1 where there is none."""
        out = np.full(h.shape, -1, np.int32)
        maybe = self.hint[h >> np.uint64(64 - _BITS)]
        some = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, self.key_ids[at], -1)
        return out

    # -- the merge loop ----------------------------------------------------
    def merge(self, word: str) -> list[str]:
        """BPE by its definition: join the pair of highest score, leftmost first."""
        if len(word) <= LONGEST:
            return self._merge_short(word)
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (k := self.id.get(both)) is not None:
                heapq.heappush(heap, (-self.score[k], i, both, j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _merge_short(self, word: str, least: int = 1) -> list[str]:
        """The same without a heap, down to ``least`` parts."""
        parts, rank = list(word), self.rank.get
        pair = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while len(pair) >= least and (best := min(pair)) != _NEVER:
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = rank(parts[i] + parts[i + 1], _NEVER)
            if i:
                pair[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
        return parts

    def _find_marks(self) -> None:
        """What texts may be cut at: marks that no piece has behind another letter,
        line ends if they are in no piece, and blanks that follow a letter."""
        joined = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        marks = {c for p in self.id for c in p if not c.isalnum() and c != SPACE}
        while drop := {b for a, b in joined if b in marks and a not in marks and a != SPACE}:
            marks -= drop
        self.at_blanks = all(b != SPACE or a == SPACE for a, b in joined)
        self.at_lines = not any("\n" in p for p in self.id)
        self.mark = np.zeros(0x110000, bool)
        self.mark[[ord(c) for c in marks]] = True

    def _cuts(self, c: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where words start among code points c of texts with a 0 behind each:
        no piece lies across such a place.  The 0s count as words."""
        start = np.zeros(len(c), bool)
        start[offs[:-1]] = True
        start[offs[1:] - 1] = True
        if not self.at_blanks:
            return start
        blank = c == _SPACE_POINT
        after = np.concatenate([[False], blank[:-1]])
        start |= blank & ~after
        if self.at_lines:
            line = c == 10
            start |= line
            start[1:] |= line[:-1]
        mark = self.mark[c]
        mark[offs[1:] - 1] = False
        where = np.flatnonzero(mark)
        if len(where):  # the first mark between two cuts
            chunk = np.cumsum(start)[where]
            first = where[np.concatenate([[True], chunk[1:] != chunk[:-1]])]
            start[first[~after[first]]] = True
        return start

    def _windows(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts as the model sees them, some WINDOW letters together; one longer
        than that is cut before blanks, where there are any."""
        who, pieces, size = [], [], 0
        for i, t in enumerate(texts):
            t = (SPACE if self.dummy else "") + t.replace(" ", SPACE) if t else ""
            at = 0
            while at < len(t):
                end = len(t)
                if self.at_blanks and end - at > WINDOW:
                    end = t.rfind(SPACE, at + 1, at + WINDOW)
                    end = len(t[at:end].rstrip(SPACE)) + at if end > 0 else 0
                    if end <= at:
                        far = _BLANK.search(t, at + WINDOW - 1)
                        end = far.start() + 1 if far else len(t)
                if size and size + end - at > WINDOW:
                    yield who, pieces
                    who, pieces, size = [], [], 0
                who.append(i)
                pieces.append(t[at:end])
                size += end - at + 1
                at = end
        if pieces:
            yield who, pieces

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.id.get(p)
            out += [k] if k is not None else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
        return out

    # -- which pieces BPE leaves apart ---------------------------------------
    def _grow_trees(self) -> None:
        """The last merge of every piece, and all pairs that may merge, shorter
        pieces first.  A piece that BPE doesn't make of its own text is in no
        result and is struck out; one that is merged earlier than a part of it
        has no order of merges to take back and is left to the merge loop."""
        n = self.n
        self.merged = np.full(n, -np.inf)  # when a piece was made; letters were there before
        self.first, self.second = np.full(n, n, np.int64), np.full(n, n, np.int64)
        self.odd = np.zeros(n + 1, bool)
        valid = np.zeros(n, bool)
        by_length: dict[int, list[int]] = {}
        for p, i in self.id.items():
            by_length.setdefault(len(p), []).append(i)
        valid[by_length.get(1, [])] = True
        self.pair_key, self.pair_rank = np.zeros(0, np.int64), np.zeros(0)
        get, text, keys, ranks = self.id.get, self.text, [], []
        self.pair_hint = np.zeros(1 << _PAIR_BITS, bool)
        for size in sorted(by_length):
            if size == 1:
                continue
            cuts = [(i, a, b) for i in by_length[size] for k in range(1, size) if (a := get(text[i][:k])) is not None and (b := get(text[i][k:])) is not None and valid[a] and valid[b]]
            if not cuts:
                continue
            i, a, b = np.array(cuts, np.int64).T
            apart, unsure = self._apart(a, b, True)
            for k in np.flatnonzero(unsure).tolist():
                apart[k] = self._merge_short(text[i[k]], 2) == [text[a[k]], text[b[k]]]
            i_, a_, b_ = i[apart], a[apart], b[apart]
            self.first[i_], self.second[i_], self.merged[i_], valid[i_] = a_, b_, -self.score[i_], True
            self.odd[i_] = (np.maximum(self.merged[a_], self.merged[b_]) > self.merged[i_]) | self.odd[a_] | self.odd[b_]
            keys.append(a << 32 | b)
            ranks.append(-self.score[i])
            self.pair_key, self.pair_rank = np.concatenate(keys), np.concatenate(ranks)
            order = np.argsort(self.pair_key)
            self.pair_key, self.pair_rank = self.pair_key[order], self.pair_rank[order]
            self.pair_hint[self._slot(keys[-1], _PAIR_BITS)] = True
        self.key_ids = np.where(valid[self.key_ids] | (self.key_ids < 0), self.key_ids, -1)

    @staticmethod
    def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def _joined(self, pairs: np.ndarray) -> np.ndarray:
        """When each pair would be merged; never: infinity."""
        out = np.full(len(pairs), np.inf)
        maybe = np.flatnonzero(self.pair_hint[self._slot(pairs, _PAIR_BITS)])
        if len(maybe):
            some = pairs[maybe]
            at = np.minimum(np.searchsorted(self.pair_key, some), len(self.pair_key) - 1)
            out[maybe] = np.where(self.pair_key[at] == some, self.pair_rank[at], np.inf)
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Whether BPE leaves the pieces a and b of each pair apart, and where only
        the merge loop can tell.  ``own``: up to the merge of the pair itself."""
        ok, unsure = np.ones(len(a), bool), self.odd[a] | self.odd[b]
        live = np.flatnonzero(~unsure)
        a, b, limit, right = a[live], b[live], np.full(len(live), np.inf), np.zeros(len(live), bool)
        if own:
            limit[:] = -np.inf
        while len(live):
            when = self._joined(a << 32 | b)
            # what is merged earlier wins, and of equals the one further left
            stay = ~((when < limit) | ((when == limit) & right & (when < np.inf)))
            ok[live[~stay]] = False
            one, two = self.merged[a], self.merged[b]
            stay &= np.maximum(one, two) > -np.inf
            live, a, b, one, two = live[stay], a[stay], b[stay], one[stay], two[stay]
            right = two >= one
            limit = np.where(right, two, one)
            a, b = np.where(right, a, self.second[a]), np.where(right, self.first[b], b)
        return ok, unsure

    def _admitted(self, pairs: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair (left * 2**32 + right) apart; left = n: none.
        Verdicts are kept in a direct-mapped cache; those it lost are worked out again."""
        slot = self._slot(pairs, _CACHE_BITS)
        kept = self.verdict[slot]
        out = (kept & 1).astype(bool)
        miss = np.flatnonzero(kept >> 1 != pairs)
        if len(miss):
            a, b = pairs[miss] >> 32, pairs[miss] & 0xFFFFFFFF
            inner = a != self.n
            ok = np.ones(len(miss), bool)
            ok[inner], unsure = self._apart(a[inner], b[inner])
            for k in np.flatnonzero(inner)[unsure].tolist():
                want = [self.text[a[k]], self.text[b[k]]]
                ok[k] = self.merge("".join(want)) == want
            out[miss] = ok
            self.verdict[slot[miss]] = pairs[miss] << 1 | ok
        return out

    # -- Viterbi -----------------------------------------------------------
    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that all have the same number of letters, one word after
        another, and how many each has; n for a letter that isn't in the vocabulary."""
        return self._viterbi(self._chars(words))[:2]

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words as rows of code points; and where each piece ends."""
        n, size = chars.shape
        prefix = self._prefix(chars)
        found = [None, *(self._probe(self._hash(chars, k, prefix)) for k in range(1, min(self.most, size) + 1))]
        step, last = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), self.n, np.int32)
        if self.bpe:
            self._admitted_steps(found, step, last)
        else:
            self._best_steps(found, step, last)
        at, out = np.full(n, size), []
        live = np.arange(n)
        while len(live):
            here = at[live]
            out.append((live, last[live, here], here))
            at[live] = here = here - step[live, here]
            live = live[here > 0]
        who, ids, pos = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(who * (size + 1) + pos, kind="stable")
        return ids[order], np.bincount(who, minlength=n), pos[order]

    def _best_steps(self, found: list, step: np.ndarray, last: np.ndarray) -> None:
        """For each end the piece that gives the highest sum of scores, the longest
        of equals; sums are rounded as the library rounds them, so that near ties
        fall alike."""
        n, size = len(step), step.shape[1] - 1
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        for end in range(1, size + 1):
            ks = range(min(self.most, end), 0, -1)
            cand = np.stack([found[k][:, end - k] for k in ks], 1)
            value = np.stack([best[:, end - k] for k in ks], 1)
            cand[cand[:, -1] < 0, -1] = self.n
            value = np.where(cand >= 0, value + np.where(cand == self.n, self.low, self.score[np.clip(cand, 0, self.n - 1)]).astype(np.float32), np.float32(-np.inf))
            pick, row = value.argmax(1), np.arange(n)
            best[:, end], step[:, end], last[:, end] = value[row, pick], ks.start - pick, cand[row, pick]

    def _admitted_steps(self, found: list, step: np.ndarray, last: np.ndarray) -> None:
        """For each end the one admitted piece.  A letter outside the vocabulary
        merges with nothing."""
        step[:, 1:][found[1] < 0] = 1
        rows, ends, sizes, ids = [], [], [], []
        for k in range(1, len(found)):
            row, start = np.nonzero(found[k] >= 0)
            rows.append(row.astype(np.int32))
            ends.append((start + k).astype(np.int32))
            sizes.append(np.full(len(row), k, np.int16))
            ids.append(found[k][row, start])
        rows, ends, sizes, ids = (np.concatenate(x) for x in (rows, ends, sizes, ids))
        order = np.argsort(ends.astype(np.int16), kind="stable") if step.shape[1] < 1 << 15 else np.argsort(ends, kind="stable")
        rows, sizes, ids = rows[order], sizes[order], ids[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=step.shape[1]))])
        for end in range(1, step.shape[1]):
            mine = slice(bounds[end], bounds[end + 1])
            row, k, piece = rows[mine], sizes[mine], ids[mine]
            ok = self._admitted(last[row, end - k].astype(np.int64) << 32 | piece)
            row = row[ok]
            step[row, end], last[row, end] = k[ok], piece[ok]

    def _spell(self, ids: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with the bytes, or the unknown id, in the place of each n, whose
        letters are given in order; and how many ids each word has then."""
        strange = ids == self.n
        if not strange.any():
            return ids, n
        if not self.bytes:
            return np.where(strange, self.unk, ids), n
        raw = np.frombuffer("".join(map(chr, letters.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        many = np.ones(len(ids), np.int64)
        many[strange] = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
        out = np.repeat(ids, many)
        table = np.array([self.bytes[b] for b in range(256)], np.int64)
        out[np.repeat(strange, many)] = table[raw]
        word = np.repeat(np.arange(len(n)), n)
        return out, np.bincount(word, many, len(n)).astype(np.int64)

    def _learn(self, hashes: np.ndarray, groups: dict[int, np.ndarray], order: list[np.ndarray], long: list[str]) -> None:
        """Encodes new words: those of each length as rows of code points, whose
        places in ``hashes`` are in ``order``; then the long ones."""
        places, parts, lens = [], [], []
        for chars, place in zip(groups.values(), order):
            for at in range(0, len(chars), ROWS):
                some = chars[at : at + ROWS]
                ids, n, pos = self._viterbi(some)
                word = np.repeat(np.arange(len(n)), n)
                strange = ids == self.n
                ids, n = self._spell(ids, n, some[word[strange], pos[strange] - 1])
                places.append(place[at : at + ROWS])
                parts.append(ids.astype(np.int32))
                lens.append(n)
        for w in long:
            if self.bpe:
                ids = np.array(self._ids(self.merge(w)), np.int32)
            else:
                ids, n, pos = self._viterbi(self._chars([w]))
                ids = self._spell(ids, n, self._chars([w])[0][pos[ids == self.n] - 1])[0].astype(np.int32)
            parts.append(ids)
            lens.append(np.array([len(ids)]))
        places.append(np.arange(len(hashes) - len(long), len(hashes)))
        size = np.concatenate(lens)
        at = len(self.flat) + np.cumsum(size) - size
        hashes = np.concatenate([self.known, hashes[np.concatenate(places)]])
        by = np.argsort(hashes, kind="stable")
        self.known = hashes[by]
        self.at, self.len = np.concatenate([self.at, at])[by], np.concatenate([self.len, size])[by]
        self.flat = np.concatenate([self.flat, *parts])

    def _words(self, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each word of up to LONGEST letters, of others of its place."""
        out = np.zeros(len(start), np.uint64)
        up, down = powers()
        block = len(up) - LONGEST - 1
        for low in range(0, len(c), block):
            a, b = np.searchsorted(start, [low, low + block])
            some = self.letter[c[low : low + block + LONGEST]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(some * up[: len(some)])])
            s = start[a:b] - low
            e = s + np.minimum(size[a:b], LONGEST)
            out[a:b] = mix((total[e] - total[s]) * down[s] + size[a:b].astype(np.uint64))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's offsets."""
        if len(self.known) > REMEMBER:
            self.forget()
        hashes, owners, wheres, sizes, windows_ = [], [], [], [], []
        for who, pieces in self._windows(texts):
            c, offs = code_points(pieces)
            start = np.flatnonzero(self._cuts(c, offs))
            size = np.diff(np.concatenate([start, [len(c)]]))
            text = np.searchsorted(offs, start, "right") - 1
            word = start != offs[1:][text] - 1  # not the mark
            start, size, text = start[word], size[word], text[word]
            h = self._words(c, start, size)
            odd = size > LONGEST
            if self.bpe:
                odd |= (c[start] == _SPACE_POINT) & (c[start + 1] == _SPACE_POINT) & (size > 1)
            for k in np.flatnonzero(odd).tolist():  # these are known by a hash of their text
                h[k] = _text_hash(c[start[k] : start[k] + size[k]])
            hashes.append(h)
            owners.append(np.array(who)[text])
            wheres.append(start)
            sizes.append(np.where(odd, -size, size))
            windows_.append(c)
        if not hashes:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        new = self.known[at] != own if len(self.known) else np.ones(len(own), bool)
        if new.any():
            begin, size = np.concatenate(wheres), np.concatenate(sizes)
            bounds = np.cumsum([0, *map(len, hashes)])
            pick = np.sort(first[new])
            window = np.searchsorted(bounds, pick, "right") - 1
            groups, order, done = {}, [], []
            for k in np.unique(size[pick][size[pick] > 0]).tolist():
                mine = np.flatnonzero(size[pick] == k)
                rows = [windows_[w][begin[pick[mine[window[mine] == w]]][:, None] + np.arange(k)] for w in range(len(windows_))]
                groups[k] = np.concatenate(rows)
                order.append(sum(map(len, done)) + np.arange(len(mine)))
                done.append(mine)
            odd = np.flatnonzero(size[pick] < 0)
            long = ["".join(map(chr, windows_[w][begin[i] : begin[i] - size[i]].tolist())) for i, w in zip(pick[odd], window[odd])]
            self._learn(h[pick[np.concatenate([*done, odd])]], groups, order, long)
            at = np.searchsorted(self.known, own)
        idx = at[inverse]
        lens = self.len[idx]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.at[idx] - total[:-1], lens) + np.arange(total[-1])]
        offs = total[np.searchsorted(owner, np.arange(len(texts) + 1))]
        if not self.bytes:  # the library makes one of unknown ids in a row
            text = np.repeat(np.arange(len(texts)), np.diff(offs))
            keep = np.concatenate([[True], (ids[1:] != self.unk) | (ids[:-1] != self.unk) | (text[1:] != text[:-1])]) if len(ids) else np.zeros(0, bool)
            offs = np.concatenate([[0], np.cumsum(keep)])[offs]
            ids = ids[keep]
        return ids, offs.astype(np.int64)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Text of each run of ids.  Bytes that make no UTF-8 become U+FFFD.  Raises
        for a number that is no id."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < self.n):
            raise ValueError(f"ids must be from 0 to {self.n - 1}")
        lens = self.body_len[ids]
        total = np.concatenate([[0], np.cumsum(lens)])
        raw = self.body[np.repeat(self.body_at[ids] - total[:-1], lens) + np.arange(total[-1])] if len(ids) else np.zeros(0, np.uint8)
        at = total[offs]
        if self.dummy and len(raw):  # the first piece's blank is the dummy prefix
            starts = at[:-1][at[1:] > at[:-1]]
            starts = starts[raw[starts] == 32]
            keep = np.ones(len(raw), bool)
            keep[starts] = False
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            raw = raw[keep]
        out = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            data = raw.tobytes()
            out = pa.array([_mend(data[x:y]) for x, y in zip(at[:-1], at[1:])], pa.large_string())
        return out.cast(pa.string())


_MODELS: dict[bytes, Model] = {}


def _mend(data: bytes) -> str:
    """Each byte that is in no character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for k in (1, 2, 3, 4):
            try:
                out.append(data[at : at + k].decode())
                at += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def model(data: bytes) -> Model:
    """The model of these bytes, parsed once per worker."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(data)
    return _MODELS[key]


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and, if asked for, ``decoded``: the ids' text.

    One row per row; a null text has null ids, no tokens and null ``decoded``,
    an empty one an empty array and ''.  The driver reads the model file and
    ships its bytes (half a megabyte).  No shuffle.  Only the two columns are used."""
    data = _load(path)
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data)
        for b in slices(batches, SLICE_BYTES):
            texts = b.column(1).to_pylist()
            ids, offs = m.encode(texts)
            none = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(none))
            cols = [b.column(0), pa.array(np.diff(offs), pa.int64()), lists]
            if decoded:
                back = m.decode(ids, offs)
                cols.append(pc.if_else(pa.array(none), pa.scalar(None, pa.string()), back))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", *["decoded"] * decoded])
        m.forget()  # the worker lives on, perhaps for other work
        trim()

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` plus ``name``, the text of its ``ids``.  Null ids give null, and so
    do ids with a null or a number that is no id among them; an empty array gives
    '', repeated rows stay repeated and other columns stay as they are.  A column
    already called ``name`` is replaced."""
    data = _load(path)

    @F.pandas_udf("string")
    def text(col):
        import pandas as pd

        m = model(data)
        rows = [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in col]  # a null among numbers is nan
        bad = np.array([x is None or not ((r >= 0) & (r < m.n)).all() for x, r in zip(col, rows)], bool)
        lens = np.array([0 if b else len(r) for b, r in zip(bad, rows)], np.int64)
        flat = np.concatenate([r.astype(np.int64) for b, r in zip(bad, rows) if not b] or [np.zeros(0, np.int64)])
        back = m.decode(flat, np.concatenate([[0], np.cumsum(lens)])).to_pylist()
        return pd.Series([None if b else t for b, t in zip(bad, back)], dtype=object)

    return tokens.withColumn(name, text(F.col(f"`{ids}`")))


QUERY = "op2_sentencepiece_viterbi"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)


ROUND_TRIP_QUERY = "op2_sentencepiece_round_trip"


def round_trip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the ids of all documents, which SQL can tell: they are the texts."""
    return query(spark, sf_dir).select("doc_id", "decoded")


ROUND_TRIP_SQL = "SELECT doc_id, text AS decoded FROM documents"


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row, see encode(): null and empty
    texts, repeated rows and null ids are kept, other columns are not; a table
    without rows gives none."""
    return encode(docs, decoded=True)
