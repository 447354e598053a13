"""Personal data by weak supervision.

Candidate spans come from loose patterns; of IP addresses only IPv4 has one.
Labelers of three sorts vote on each (1 personal, 0 not, or abstain): regular expressions (strict form, boundaries,
check digits), gazetteers (top-level domains, calling codes, issuer prefixes,
reserved networks) and context (words around, numbers around).  Expectation-
maximisation over the counts of all vote patterns estimates each labeler's
reliability on either class and the share of personal data per kind; its
posteriors are the soft labels of a logistic span classifier, which also sees
form and neighbours and has the last word.

Texts are scanned once.  The driver gets the number of spans per feature code,
a table bounded by the features and not by the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .shared import bounded, columns, cut

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "number")
CUTOFF = 0.5
CONTEXT_CHARS = 48
_NUMBER = len(KINDS) - 1

_EMAIL = re.compile(r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)*(?<!-)")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]+")
#: A telephone number may end a sentence, but not before a decimal part.  Where a
#: decimal number follows, it is not the last group of ten digits and more.
_FORM = re.compile(
    r"(?P<phone>\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?=\+(?:[ -]?[0-9]){10,}[ -][0-9]{2,4}\.[0-9])\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?=[ -][0-9]{2,4}\.[0-9])|\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?![0-9]|\.[0-9]|(?:[ -]?[0-9]{2,4}){1,2}\.[0-9])|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9]|[.-][0-9]))"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|[0-9]{13,19}(?![0-9]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<number>[0-9][0-9.,:/-]{3,}[0-9])"
)
_STRICT = {
    "email": re.compile(r"[^\W_](?:[\w.+-]*[^\W_])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}", re.I),
    "phone": re.compile(r"\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3,4}-[0-9]{4}|\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}|\(?[0-9]{3}[) -]{1,2}[0-9]{3}-[0-9]{4}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}"),
    "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{13}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}"),
    "number": re.compile(r"(?!)"),
}
#: Gazetteers: generic and country top-level domains, calling codes of countries
#: and services, and countries with bank account numbers of this form.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io co app dev ai cloud online site shop xyz club blog tech store agency email museum travel jobs mobi coop aero example "
    "ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 800 808 850 852 853 855 856 870 878 880 881 882 883 886 888 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 979 992 993 994 995 996 998".split()
)
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HN HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE".split())
_PERSONAL = re.compile(r"\b(?:e-?mails?|mail|contact|phone|tel|telephone|call|mobile|cell|fax|card|visa|credit|ssn|iban|account|ip|address|teléfono|correo|tarjeta|llame|courriel|carte|appelez|karte|konto|anruf|adresse)\b", re.I)
_OTHER = re.compile(r"\b(?:version|release|licen[cs]e|licensed|section|chapter|page|isbn|doi|figure|fig|table|build|kapitel|seite|capítulo|chapitre|rfc|error)\b", re.I)

#: The labelers, in the order of their votes.
LABELERS = ("form", "boundary", "checksum", "gazetteer", "words", "numbers")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 personal, 0 not, 2 abstains."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    digits = re.sub(r"[^0-9]", "", span)
    form = int(bool(_STRICT[kind].fullmatch(span)))
    glued = bool(before[-1:].isalnum() or before[-1:] in ("_", "=") and before or after[:1].isalnum() or after[:1] == "_")
    check = 2
    if kind == "card":
        check = 1 if _luhn(digits) else 2  # a mistyped or made-up number fails too
    elif kind == "iban":
        s = span.replace(" ", "")
        check = int(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    elif kind == "ip":
        check = int(all(int(x) < 256 for x in span.split(".")))
    gazetteer = 2
    if kind == "email":
        gazetteer = int(span.rpartition(".")[2].lower() in DOMAINS)
    elif kind == "phone":
        gazetteer = int(any(digits[:k] in CALLING for k in (1, 2, 3))) if span[0] == "+" else 2
    elif kind == "card":
        gazetteer = 1 if digits[0] in "3456" else 2
    elif kind == "iban":
        gazetteer = int(span[:2] in COUNTRIES)
    elif kind == "ip":
        gazetteer = 0 if re.match(r"0\.|127\.|255\.", span) else 1
    near = before + " " + after
    words = 0 if _OTHER.search(near) else 1 if _PERSONAL.search(near) else 2
    numbers = 0 if re.search(r"[0-9][,;|/]?\s*$", before) and re.match(r"[,;|/]?\s*[0-9]", after) else 2
    if kind == "number":
        form, numbers = 0, 0 if numbers == 0 else 2
    return form, int(not glued), check, gazetteer, words, numbers


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in ".,;:!?\"'()|" else 3


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """Candidate spans of a text, in order and apart: start, end, kind, code."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found = [(m.start(), m.end(), 0) for m in _EMAIL.finditer(text)]
    taken, at, pos = iter([*found, (len(text) + 1, len(text) + 1, 0)]), None, 0
    at = next(taken)
    while m := _DIGIT.search(text, pos):
        i = m.start()
        while at[1] <= i:
            at = next(taken)
        if at[0] <= i:
            pos = at[1]
            continue
        hit = None
        for s in (i - 2, i - 1, i):
            if s >= pos and (s == i or (s == i - 1 and text[s] in "+(") or (s == i - 2 and text[s:i].isalpha() and text[s:i].isascii())):
                hit = _FORM.match(text, s)
                if hit and hit.end() <= at[0]:
                    break
                hit = None
        if hit:
            found.append((hit.start(), hit.end(), KINDS.index(hit.lastgroup)))
            pos = hit.end()
        else:
            pos = _RUN.match(text, i).end()
    out = []
    for s, e, k in sorted(found):
        code = k
        for v in votes(text, s, e, KINDS[k]):
            code = code * 3 + v
        code = code * 4 + _side(text[s - 1 : s])
        code = code * 4 + _side(text[e : e + 1])
        n = sum(c.isdigit() for c in text[s:e])
        code = code * 4 + (0 if n < 4 else 1 if n < 8 else 2 if n < 13 else 3)
        out.append((s, e, k, code))
    return out


def _decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and the classifier's 0/1 features of codes."""
    code = np.asarray(code, np.int64)
    digits, after, before = code % 4, code // 4 % 4, code // 16 % 4
    rest = code // 64
    v = np.stack([rest // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)], 1)
    kind = rest // 3 ** len(LABELERS)
    one = [kind[:, None] == np.arange(len(KINDS)), before[:, None] == np.arange(4), after[:, None] == np.arange(4), digits[:, None] == np.arange(4)]
    one += [v[:, k : k + 1] == np.arange(3) for k in range(len(LABELERS))]
    return kind, v, np.concatenate(one, 1).astype(float)


def reliabilities(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid and Skene's EM on weighted vote patterns: posterior of each pattern,
    share of class 1 per kind, and P(vote 1 | class) per labeler.  Priors stand
    for a labeler right four times in five, and no labeler may be worse than
    chance, so that the classes can't swap."""
    said = v != 2
    yes = (v == 1) & said
    post = np.where(said.any(1), (yes.sum(1) + 0.5) / (said.sum(1) + 1.0), 0.5)
    share = np.full(len(KINDS), 0.5)
    rate = np.zeros((2, v.shape[1]))
    for _ in range(rounds):
        for c, w in ((0, (1 - post) * n), (1, post * n)):
            hit, all_ = (w[:, None] * yes).sum(0), (w[:, None] * said).sum(0)
            rate[c] = (hit + (80 if c else 20)) / (all_ + 100)
        rate[0], rate[1] = np.clip(rate[0], 0.005, 0.5), np.clip(rate[1], 0.5, 0.995)
        share = (np.bincount(kind, post * n, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        share = np.clip(share, 0.02, 0.98)
        like = np.log(share[kind] / (1 - share[kind]))
        like = like + (said * np.where(yes, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))).sum(1)
        post = 1 / (1 + np.exp(-np.clip(like, -30, 30)))
    return post, share, rate


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on weighted soft labels.
    ``n`` counts in full, so that what a rare kind's spans say stays as it is
    when the others multiply."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return (n * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * w)
        while np.abs(step).max() >= 1e-8 and loss(w + step) > loss(w):
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier for the candidates in ``found`` (code)."""
    return _fit_codes(found)[0]


def _fit_codes(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The same, and the codes that occur."""
    rows = found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").toPandas()
    codes = rows["code"].to_numpy(np.int64)
    kind, v, x = _decode(codes)
    n = rows["n"].to_numpy(float)
    post, _, _ = reliabilities(kind, v, n)
    return fit(x, post, n), codes


def probability(code: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = _decode(code)[2]
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def _may(text: Column) -> Column:
    """Whether a text can have spans: every form holds a digit or an at sign."""
    return text.rlike("[@0-9]")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (in characters, end excluded), kind, span and feature
    code of every candidate.  Null and empty texts have none, repeated rows have
    theirs repeated, texts are scanned to their end; only the two columns are used."""
    src = bounded(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(_may(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, s, e, KINDS[k], t[s:e], c) for i, t in enumerate(b.column(1).to_pylist()) if t for s, e, k, c in spans(t)]
            at, start, end, kind, span, code = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(span, pa.string()), pa.array(code, pa.int64())], ["doc_id", "start", "end", "kind", "span", "code"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start bigint, end bigint, kind string, span string, code bigint")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, kind, span, probability: one row for every span of
    every row that the classifier holds for personal data.

    The model is fitted on all candidates of ``docs``; without candidates, or
    without rows, the result is empty.  Null and empty texts have no spans,
    repeated rows have theirs repeated, texts are scanned to their end.  Only the
    two columns are used."""
    found = cut(candidates(docs, doc_id, text))
    w = train(found)
    codes = found.select("code").distinct()

    @F.pandas_udf("double")
    def p(code):
        import pandas as pd

        return pd.Series(probability(code.to_numpy(np.int64), w))

    scores = codes.select("code", p("code").alias("probability"))  # as few rows as there are feature codes
    return found.join(F.broadcast(scores), "code").where(F.col("probability") >= CUTOFF).select("doc_id", "start", "end", "kind", "span", "probability")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with ``text`` masked: every span held for
    personal data becomes its kind in brackets.  Null stays null, '' stays '',
    repeated rows are masked alike, and a table without rows gives none.

    Only texts with a digit or an at sign can have spans, and only they go to
    Python: once to train the classifier and once to be masked.  To write the spans
    in between would mean to write the texts."""
    where, fresh = F.col(f"`{text}`"), F.lit(0).alias("__none")
    w, codes = _fit_codes(cut(candidates(docs.select(fresh, where.alias("__text")), "__none", "__text").select("code")))
    held = {int(c) for c in codes[probability(codes, w) >= CUTOFF]} if len(codes) else set()

    @F.pandas_udf("string")
    def mask(texts):
        import pandas as pd

        out = []
        for t in texts:
            parts, at = [], 0
            for s, e, k, code in spans(t) if t else ():
                if code in held:
                    parts += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = e
            out.append("".join([*parts, t[at:]]) if at else t)
        return pd.Series(out, dtype=object)

    return bounded(docs).withColumn(text, F.coalesce(mask(F.when(_may(where), where)), where))


QUERY = "op3_weakly_supervised_pii"


def query(spark, sf_dir: str) -> DataFrame:
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("probability", F.round("probability", 6))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masked documents, all rows, see redact(); a column n_chars counts the new text."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns(docs))
