import re

import numpy as np

from marginalia.llm import pii
from tests.llm.odd import EXTRA, LONG, ROWS, SCHEMA, frame, words

PLANTED = [
    ("email", "jo.doe+x@mail.example.com"),
    ("email", "ÉLAN.42@MAIL8.EXAMPLE.COM"),
    ("phone", "+1 (826) 555-4081"),
    ("phone", "+49 30 1234 5678"),
    ("card", "4757965300669737"),
    ("card", "9807915762804490"),
    ("ip", "190.137.223.204"),
    ("ip", "8.252.9.145"),
]
CLEAN = ["licensed under CC BY-NC 4.0. and more", "version 1.2.3 of 2024", "on page 12 of 345", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "in 2023-01-02 they sold 1,234,567 items", "a@b c", "room 12345", "x" * 30]


def corpus():
    rows, want = [], set()
    for i in range(300):
        w = words(i, 60).split()
        kind, value = PLANTED[i % len(PLANTED)]
        if i % 3 == 0:
            at = 7 + i % 40
            w[at:at] = [value]
            want.add((i, kind, value))
        elif i % 3 == 1:
            w[20:20] = CLEAN[i % len(CLEAN)].split(" ")
        rows.append((i, " ".join(w)))
    return rows, want


def test_planted_and_clean(spark):
    rows, want = corpus()
    got = {(r["doc_id"], r["kind"], r["span"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_query_equals_the_model_by_hand(spark):
    rows, _ = corpus()
    all_ = [(i, s, e, pii.KINDS[k], t[s:e], c) for i, t in rows for s, e, k, c in pii.spans(t)]
    codes, n = np.unique([x[5] for x in all_], return_counts=True)
    kind, v, x = pii._decode(codes)
    post, share, rate = pii.reliabilities(kind, v, n.astype(float))
    p = dict(zip(codes.tolist(), pii.probability(codes, pii.fit(x, post, n.astype(float)))))
    want = sorted((i, s, e, k, t, round(p[c], 6)) for i, s, e, k, t, c in all_ if p[c] >= pii.CUTOFF)
    got = sorted((r["doc_id"], r["start"], r["end"], r["kind"], r["span"], round(r["probability"], 6)) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and (rate[1] > rate[0]).all() and 0 <= share.min() <= share.max() <= 1


def test_expectation_maximisation_finds_reliabilities():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.6])
    votes = np.where(r.random((len(truth), 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[r.random(votes.shape) < 0.3] = 2
    post, share, rate = pii.reliabilities(np.full(len(truth), 1), votes, np.ones(len(truth)))
    assert abs(share[1] - 0.4) < 0.03 and np.abs(rate[1] - right).max() < 0.06 and np.abs(rate[0] - (1 - right)).max() < 0.06
    assert ((post > 0.5) == truth).mean() > 0.93


def test_spans_are_apart_and_whole():
    text = "call +1 (826) 555-4081 190.137.223.204, a.b@c.org 1232810148878564! 1.2.3.4.5"
    got = [(text[s:e], pii.KINDS[k]) for s, e, k, _ in pii.spans(text)]
    assert got[:4] == [("+1 (826) 555-4081", "phone"), ("190.137.223.204", "ip"), ("a.b@c.org", "email"), ("1232810148878564", "card")]
    ends = [(s, e) for s, e, _, _ in pii.spans(text)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert pii.spans("") == []
    assert [x[:3] for x in pii.spans("1" * 100_000)] == [(0, 100_000, pii._NUMBER)]


def test_checks():
    assert pii._luhn("4539578763621486") and not pii._luhn("4539578763621487")
    assert pii.votes("DE89370400440532013000", 0, 22, "iban")[2] == 1
    assert pii.votes("999.1.1.1", 0, 9, "ip")[2] == 0


def test_masked(spark):
    rows, want = corpus()
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i: v for i, _, v in want}
    for i, t in rows:
        if i in hit:
            assert hit[i] not in out[i] and re.sub(r"\[(EMAIL|PHONE|CARD|IP)\]", "@@", out[i]) == t.replace(hit[i], "@@")
        else:
            assert out[i] == t


def test_odd_rows(spark):
    text = LONG + " at 190.137.223.204"
    df = frame(spark, [*ROWS, (10, text, None, None), (10, text, None, None)])
    got = pii.find(df).collect()
    assert [(r["doc_id"], r["span"], r["start"]) for r in got] == [(10, "190.137.223.204", len(LONG) + 4)] * 2
    out = pii.stage(spark, df, "")
    assert out.columns == df.columns
    back = sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=str)
    assert back == sorted(((str(r[0]), r[1]) for r in [*ROWS, *[(10, LONG + " at [IP]")] * 2]), key=str)
    assert all(r[k] == v for r in out.collect() for k, v in EXTRA.items())
    none = spark.createDataFrame([], SCHEMA)
    assert pii.find(none).collect() == [] and pii.redact(none).collect() == []


def test_every_kind_before_punctuation():
    values = [("email", "jo.doe@mail.example.com"), ("phone", "+1 555 123 4567"), ("phone", "+49 30 1234 5678"), ("phone", "555-123-4567"), ("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("card", "4757 9653 0066 9737"), ("card", "4757965300669737"), ("ssn", "123-45-6789"), ("iban", "DE89370400440532013000")]
    for kind, value in values:
        for mark in (".", ",", ";", ":", "!", "?", ")", "]", "'", '"', "/", "-", "…", "...", ".)", ". Then", "- or"):
            text = f"call {value}{mark}"
            assert [(text[s:e], pii.KINDS[k]) for s, e, k, _ in pii.spans(text)] == [(value, kind)], text


def test_telephone_numbers_are_not_cut_by_what_follows():
    def phones(text):
        return [text[s:e] for s, e, k, _ in pii.spans(text) if pii.KINDS[k] == "phone"]

    assert phones("+1 555 123 4567.5") == [] and phones("+49 30 1234 5678.5") == [] and phones("555-123-4567.8") == []
    assert phones("+1 555 123 4567 12.50 EUR") == ["+1 555 123 4567"] and phones("+49 30 1234 5678 2.5 times") == ["+49 30 1234 5678"]


def test_a_rare_kind_keeps_its_verdict_when_others_multiply():
    texts = ["call jo@x.com now", "ip 190.137.223.204 is", "see 12345.67 there", "see 1.2.3.4.5.6 there", "iban DE89370400440532013000, ok"]
    codes = np.array([pii.spans(t)[0][3] for t in texts])
    x = pii._decode(codes)[2]
    for label in (0.4, 0.6):
        for k in (20, 200):
            got = []
            for m in (1e3, 1e5, 1e6, 1e8, 1e10):
                w = pii.fit(x, np.array([0.97, 0.95, 0.02, 0.02, label]), np.array([m, m, 5 * m, 5 * m, k]))
                got.append(pii.probability(codes[-1:], w)[0])
            assert max(got) - min(got) < 0.03 and all((p >= pii.CUTOFF) == (label >= pii.CUTOFF) for p in got), (label, k, got)


def plain_votes(before, value, after, kind):
    """The six votes, told from the words around and the value's own parts."""
    digits = [int(c) for c in value if c in "0123456789"]
    local, _, host = value.rpartition("@")
    numbers = value.split(".")
    if kind == "email":
        form = "." in host and local.replace(".", "").isalnum() and all(p.isalnum() and p.isascii() for p in host.split(".")) and host.split(".")[-1].isalpha() and len(host.split(".")[-1]) > 1
        check, listed = 2, int(host.split(".")[-1] in pii.DOMAINS)
    elif kind == "phone":
        form = value[0] == "+" and value[2:4] == " (" and value[-5] == "-"
        check, listed = 2, int(any("".join(map(str, digits[:k])) in pii.CALLING for k in (1, 2, 3)))
    elif kind == "card":
        form = len(digits) == 16
        double = [d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(digits[::-1], 1)]
        check, listed = 1 if sum(double) % 10 == 0 else 2, 1 if digits[0] in (3, 4, 5, 6) else 2
    elif kind == "ip":
        form = all(x == str(int(x)) and int(x) < 256 for x in numbers)
        check, listed = int(all(int(x) < 256 for x in numbers)), int(int(numbers[0]) not in (0, 127, 255))
    else:
        form, check, listed = False, 2, 2
    glued = before[-1:] == "=" or before[-1:].isalnum() or after[:1].isalnum()
    near = set((before[-48:] + " " + after[:48]).replace(",", " ").replace("=", " ").split())
    words = 0 if "version" in near else 1 if "call" in near or "card" in near else 2
    among = before.rstrip()[-1:].isdigit() and after.lstrip()[:1].isdigit()
    return int(form), int(not glued), check, listed, words, 0 if among else 2


def test_brute_force(spark):
    """Labelers, expectation-maximisation and classifier worked out span by span,
    with no function of the module: documents are put together so that it is known
    where their candidates are."""
    values = [("email", "jo.doe@mail.example.com"), ("email", "jo@localhost"), ("phone", "+1 (826) 555-4081"), ("phone", "+0 (826) 555-4081"), ("card", "4757965300669737"), ("card", "9807915762804490"), ("ip", "190.137.223.204"), ("ip", "190.137.223.999"), ("ip", "127.0.0.1"), ("number", "12345.67"), ("number", "2024-11-05")]
    rows, spans_ = [], []
    for i in range(700):
        w = words(i % 50, 30).split()
        kind, value = values[i * i % len(values)]
        before = " ".join(w[:9]) + (" call ", " version ", " card ", " ", " x=", " 7 ")[i * 7 % 6]
        after = (". ", " ", ", ", " 8 ", "! ")[i * 3 % 5] + " ".join(w[9:])
        rows.append((i, before + value + after))
        spans_.append((i, len(before), len(before) + len(value), kind, value, plain_votes(before, value, after, kind), before[-1:], after[:1]))
    kinds, n = np.array([pii.KINDS.index(s[3]) for s in spans_]), len(spans_)
    v = np.array([s[5] for s in spans_])
    post = np.array([(sum(x == 1 for x in r) + 0.5) / (sum(x != 2 for x in r) + 1) for r in v])
    for _ in range(50):
        p1, p0 = np.zeros(6), np.zeros(6)
        for k in range(6):
            said = v[:, k] != 2
            p1[k] = ((post * (v[:, k] == 1)).sum() + 80) / (post[said].sum() + 100)
            p0[k] = (((1 - post) * (v[:, k] == 1)).sum() + 20) / ((1 - post)[said].sum() + 100)
        p1, p0 = p1.clip(0.5, 0.995), p0.clip(0.005, 0.5)
        share = {k: min(0.98, max(0.02, (post[kinds == k].sum() + 1) / ((kinds == k).sum() + 2))) for k in set(kinds)}
        odds = np.array([np.log(share[k] / (1 - share[k])) for k in kinds])
        for j in range(n):
            for k in range(6):
                if v[j, k] != 2:
                    odds[j] += np.log(p1[k] / p0[k]) if v[j, k] else np.log((1 - p1[k]) / (1 - p0[k]))
        post = 1 / (1 + np.exp(-odds))

    def features(s):
        _, _, _, kind, value, votes, before, after = s
        side = [0 if c == " " or not c else 1 if c.isalnum() else 2 if c in ".,!" else 3 for c in (before, after)]
        many = sum(c.isdigit() for c in value)
        out = [float(kind == k) for k in pii.KINDS] + [float(x == k) for x in (*side, 0 if many < 4 else 1 if many < 8 else 2 if many < 13 else 3) for k in range(4)]
        return [*out, *(float(x == k) for x in votes for k in range(3)), 1.0]

    x = np.array([features(s) for s in spans_])
    w = np.zeros(x.shape[1])
    for _ in range(60):  # the loss is convex: any way down leads to the same weights
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (p - post) + w)
    p = 1 / (1 + np.exp(-x @ w))
    want = {s[:5]: round(float(q), 4) for s, q in zip(spans_, p) if q >= 0.5}
    got = {(r["doc_id"], r["start"], r["end"], r["kind"], r["span"]): round(r["probability"], 4) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want) and 150 < len(want) < 650
    assert max(abs(got[k] - want[k]) for k in want) < 2e-4
