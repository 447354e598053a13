import os
import random

import numpy as np
import pytest
import sentencepiece

from marginalia.llm import spm
from tests.llm.odd import ROWS, SCHEMA, frame, words


pytestmark = pytest.mark.skipif(not os.path.exists(spm.MODEL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def bpe():
    with open(spm.MODEL, "rb") as f:
        data = f.read()
    return spm.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def unigram():
    """A unigram model put together by hand; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    rng = random.Random(4)
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    alphabet = "abcdeéß" + spm.SPACE
    pieces = set(alphabet) | {"".join(rng.choice(alphabet[:-1]) for _ in range(rng.randint(2, 5))) for _ in range(200)}
    pieces |= {spm.SPACE + p for p in rng.sample(sorted(pieces - {spm.SPACE}), 80)}
    for p in sorted(pieces):
        m.pieces.add(piece=p, score=-rng.uniform(2, 12), type=1)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.name = "identity"
    return m.SerializeToString()


def split(ids, offs):
    return [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]


def texts():
    rng = random.Random(0)
    out = [words(i, 40) for i in range(30)]
    out += ["", " ", "  ", "a", " a", "a  b", "\n\n x", "héllo wörld ß", "日本語のテキスト", "😀😀 a😀b", "a" * 500, "ab " * 300, "\t\x00\x01", "don't!!! (really) - x=1;", "ALL CAPS, 12345 678.90"]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x4E00, 0x9FFF), 32, 32])) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    return out


def test_bpe_equals_the_library(bpe):
    mine, theirs = bpe
    t = texts()
    ids, offs = mine.encode(t)
    assert split(ids, offs) == theirs.encode(t)
    assert mine.decode(ids, offs).to_pylist() == theirs.decode(theirs.encode(t))


def test_unigram_equals_the_library():
    data = unigram()
    mine, theirs = spm.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    t = ["".join(rng.choice("abcdeéß    ") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    t += ["".join(rng.choice("abcé  xyzü日") for _ in range(rng.randrange(0, 60))) for _ in range(300)]  # unknown letters
    t += ["".join(rng.choice("abcdeéßx") for _ in range(n)) for n in (47, 48, 49, 50, 100, 700)]
    t += [t[-1][:60] + tail for tail in ("a", "b", "é")]
    ids, offs = mine.encode(t)
    assert split(ids, offs) == theirs.encode(t)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_all_documents_equal_the_library(bpe, monkeypatch):
    """The path through admitted pairs, without one word merged by the loop."""
    import pyarrow.parquet as pq

    mine, theirs = bpe
    mine.forget()
    mine.verdict[:] = -1
    monkeypatch.setattr(mine, "_merge_short", None)
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for at in range(0, len(t), 200):
        some = [x or "" for x in t[at : at + 200]]
        ids, offs = mine.encode(some)
        assert split(ids, offs) == theirs.encode(some)
        assert mine.decode(ids, offs).to_pylist() == some


def test_admitted_pairs_are_those_that_merging_leaves_apart(bpe):
    mine, _ = bpe
    rng = random.Random(3)
    pieces = list(mine.id.values())
    a = np.array(rng.choices(pieces, k=20_000))
    b = np.array(rng.choices(pieces, k=20_000))
    halves = [(mine.id[p[:k]], mine.id[p[k:]]) for p in rng.sample(sorted(mine.id), 3000) for k in range(1, len(p)) if p[:k] in mine.id and p[k:] in mine.id]
    a, b = np.concatenate([a, [x for x, _ in halves]]), np.concatenate([b, [y for _, y in halves]])
    ok, unsure = mine._apart(a, b)
    want = [mine.merge(mine.text[x] + mine.text[y]) == [mine.text[x], mine.text[y]] for x, y in zip(a.tolist(), b.tolist())]
    assert not unsure.any() and ok.tolist() == want and 0.2 < np.mean(want) < 0.98


def test_trees_with_merges_out_of_order():
    """A piece merged before its own part, one that is never made, and equal letters."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    order = ["abc", "aa", "ab", "cab", "bcd", "cd", "aab", "abab", "dd", "ddd", "dddd", "▁a", "▁ab", "bb", "abb", "bbc"]
    for k, p in enumerate([*order, *"abcd▁"]):
        m.pieces.add(piece=p, score=-k, type=1)
    m.trainer_spec.model_type = 2
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.name = "identity"
    data = m.SerializeToString()
    mine, theirs = spm.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert mine.odd.any()
    rng = random.Random(4)
    t = ["".join(rng.choice("aabbccdd x") for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    ids, offs = mine.encode(t)
    assert split(ids, offs) == theirs.encode(t)


def test_windows_and_forgetting_change_nothing(bpe, monkeypatch):
    mine, theirs = bpe
    t = [*texts(), "word " * 300, "x" * 700, "y" * 60 + " " * 9 + "z" * 300 + " \n \n"]
    want = theirs.encode(t)
    for window in (7, 50, 333):
        monkeypatch.setattr(spm, "WINDOW", window)
        monkeypatch.setattr(spm, "REMEMBER", 10)
        for at in range(0, len(t), 40):
            ids, offs = mine.encode(t[at : at + 40])
            assert split(ids, offs) == want[at : at + 40]


def test_ids_out_of_range(spark, bpe):
    mine, _ = bpe
    for bad in (-1, mine.n, 10**6):
        with pytest.raises(ValueError, match="ids must be"):
            mine.decode(np.array([5, bad]), np.array([0, 2]))
    rows = [(1, [10, 200]), (2, [10, -1]), (3, [32_005]), (4, [10, None]), (5, []), (6, None), (7, [10, 200])]
    got = {r["k"]: r["decoded"] for r in spm.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    good = mine.decode(np.array([10, 200]), np.array([0, 2]))[0].as_py()
    assert got == {1: good, 2: None, 3: None, 4: None, 5: "", 6: None, 7: good}


def test_viterbi_finds_the_best_path():
    m = spm.Model(unigram())
    rng = random.Random(2)
    for n in (1, 4, 9):
        ws = ["".join(rng.choice("abcdeéß") for _ in range(n)) for _ in range(20)]
        ids, lens = m.viterbi(ws)
        for w, own in zip(ws, np.split(ids, np.cumsum(lens)[:-1])):
            best = {0: 0.0}
            for end in range(1, n + 1):
                best[end] = max(best[a] + m.score[m.id[w[a:end]]] for a in range(end) if w[a:end] in m.id)
            assert "".join(m.text[i] for i in own) == w and abs(m.score[own].sum() - best[n]) < 1e-4


def test_round_trip_in_spark(spark):
    df = frame(spark)
    out = spm.encode(df, decoded=True)
    got = sorted(((str(r["doc_id"]), r["decoded"], r["ids"] is None, r["n_tokens"]) for r in out.collect()), key=str)
    assert [(a, b) for a, b, *_ in got] == sorted(((str(i), t) for i, t, *_ in ROWS), key=str)
    assert all(none == (t is None) and (n == 0) == (not t) for _, t, none, n in got)
    again = spm.decode(out.select("doc_id", "ids"))
    assert sorted(((str(r["doc_id"]), r["decoded"]) for r in again.collect()), key=str) == [(a, b) for a, b, *_ in got]
    assert spm.encode(spark.createDataFrame([], SCHEMA), decoded=True).collect() == []
