import os
import random
import re
import subprocess
import sys
import unicodedata

import numpy as np
import pytest

from marginalia.llm import arrow_text
from marginalia.llm import langid as L
from tests.llm.odd import ROWS, SCHEMA, frame, words

SF = "/root/testdata/sf0.001"


def bits(letter):
    """A letter's vector, from the words of splitmix64 in plain numbers."""

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % 2**64
        return x

    words = [mix((mix(ord(letter) * (L.DIM // 64) + k + 1) + L.SEED) % 2**64) if letter != " " else mix((mix(k + 1) + L.SEED) % 2**64) for k in range(L.DIM // 64)]
    return np.array([w >> b & 1 for w in words for b in range(64)]) * 2 - 1


def plain(text):
    """A text's profile, trigram by trigram."""
    kept = "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    kept = re.sub(" +", " ", kept.strip(" ")) + " " if kept.strip(" ") else ""
    out = np.zeros(L.DIM)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        out += np.roll(bits(a), 2) * np.roll(bits(b), 1) * bits(c)
    return out


TEXTS = ["Ab, cde!", None, "", " ab", "a", "12 34", "Ünïcödé ßtraße — Ёлка, ΣΊΣΥΦΟΣ 中文字", "  x  y  zz  ", "हिन्दी"]


def test_profile_by_hand(monkeypatch):
    want = [plain(t) for t in TEXTS]
    assert (L.profiles(TEXTS) == want).all()
    for window in (2, 3, 5, 8, 13):
        monkeypatch.setattr(arrow_text, "WINDOW", window)
        assert (L.profiles(TEXTS) == want).all()
    for few in (1, 2, 3):
        monkeypatch.setattr(L, "_TRIGRAMS", few)
        assert (L.profiles(TEXTS) == want).all()


def test_every_letter_has_its_own_vector():
    points = np.flatnonzero(L._symbols() == np.arange(0x110000))[1:]
    v = np.packbits(L.letters(points) > 0, axis=1)
    assert len(points) > 100_000 and len(np.unique(v[:, :16].copy().view("V16"))) == len(points)


def test_brute_force(spark):
    """Prototypes and decisions worked out document by document."""
    rows = [(i, words(i, 12, 60) if i % 3 else words(i, 9).upper() + " çé", ("en", "fr", None)[i % 3] if i % 7 else "de", None) for i in range(40)] + [(50, None, "en", None), (51, "", "fr", None), (2, words(2, 12, 60), "xx", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    names, prototypes = L.train(df)
    profile = [plain(t) for _, t, *_ in rows]
    want = []
    for name in names:
        p = sum(x for x, r in zip(profile, rows) if r[2] == name)
        want.append(p / np.linalg.norm(p))
    assert names == sorted({r[2] for r in rows if r[2]}) and np.abs(prototypes - want).max() < 1e-6
    plainly = []
    for (i, *_), x in zip(rows, profile):
        cos = sorted(((p @ x / np.linalg.norm(x), name) for p, name in zip(want, names)), key=lambda v: (-v[0], v[1])) if x.any() else [(None, None)] * 2
        plainly.append((i, cos[0][1], *(c and round(float(c), 4) for c in (cos[0][0], cos[1][0]))))
    got = [(r["doc_id"], r["language"], r["cosine"] and round(r["cosine"], 4), r["runner_up"] and round(r["runner_up"], 4)) for r in L.identify(df, (names, prototypes)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plainly))


def test_ties_go_to_the_first_by_name(spark):
    text = words(3, 20)
    df = spark.createDataFrame([(1, text, "zz", None), (2, text, "aa", None), (3, text, None, None)], SCHEMA)
    assert {(r["language"], round(r["cosine"], 3), round(r["runner_up"], 3)) for r in L.identify(df, L.train(df)).collect()} == {("aa", 1.0, 1.0)}


def test_memory_stays_bounded():
    """Ten thousand texts of random letters, whose trigrams are nearly all different."""
    script = """
import random, resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from marginalia.llm import arrow_text
from marginalia.llm import langid as L
rng = random.Random(0)
make = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
L.classify(["warm up"], ["a"], L.letters(np.arange(1)).astype(np.float32))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for texts in ([make(30) for _ in range(10_000)], ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=30)) for _ in range(10_000)], ["long text of common words " * 400_000]):
    L.classify(texts, ["a"], L.letters(np.arange(1)).astype(np.float32))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", script, root], capture_output=True, text=True, timeout=300, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert done.returncode == 0, done.stderr[-500:]
    assert int(done.stdout) < 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"))
    got = L.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [r["language"] == r["lang"] for r in got]
    assert len(right) > 80 and np.mean(right) >= 0.97


def test_unrelated_alphabets(spark):
    rng = random.Random(0)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make(a, 60), name, None) for name, a in (("x", "abcdefg"), ("y", "αβγδεζη"), ("z", "абвгдеж")) for i in range(20)]
    model = L.train(spark.createDataFrame(rows, SCHEMA))
    assert model[0] == ["x", "y", "z"]
    lang, top, second = L.classify([make("αβγδεζη", 30), make("abcdefg", 30), None, "", "12 34", make("абвгдеж", 50_000)], *model)
    assert lang == ["y", "x", None, None, None, "z"] and (top[[0, 1, 5]] > second[[0, 1, 5]]).all() and np.isnan(top[2:5]).all()


def test_odd_rows(spark):
    df = frame(spark)
    model = L.train(df)
    assert model[0] == ["de", "en", "fr"]
    got = L.identify(df, model).collect()
    assert len(got) == len(ROWS) and sum(r["language"] is None for r in got) == 5
    assert all((r["cosine"] is None) == (r["language"] is None) for r in got)
    none = spark.createDataFrame([], SCHEMA)
    assert L.identify(none, model).collect() == []
    empty = L.train(none)
    assert empty[0] == [] and {r["language"] for r in L.identify(df, empty).collect()} == {None}
    assert len(words(1, 3).split()) == 3
