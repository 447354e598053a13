"""Quality rules judged by host.

Every document is tested against fixed rules in two strengths.  A *hard* failure
rejects the document on its own.  The failures of each host are summed, its rate
is shrunk towards a beta prior fitted to all hosts by the method of moments, and
on hosts whose shrunken rate exceeds ``host_rate`` a *soft* failure rejects too.
A document that fails nothing is kept, whatever its host.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix, runs, trim
from .shared import bounded, cut, unused

#: rule -> (hard, soft): numerator times the factor exceeds the denominator.
RULES = {
    "symbols": ("n_symbols", "n_chars", 10, 25),
    "pipes": ("n_pipes", "n_words", 8, 20),
    "shouting": ("n_upper", "n_letters", 2, 3),
    "repeats": ("n_adjacent", "n_words", 5, 12),
    "long_words": ("n_solid", "n_words * 40", 1, 2),
}
HOST_RATE = 0.5
#: Columns that judge() adds.
ADDED = ("host_docs", "host_fails", "host_rate", "hard_fails", "soft_fails", "keep")
_BLANK = "[ \\t\\n\\r]+"


_LETTER, _UPPER, _PLAIN, _SPACE, _PIPE = 1, 2, 4, 8, 16
_COUNTS = ("n_chars", "n_solid", "n_words", "n_symbols", "n_pipes", "n_upper", "n_letters", "n_adjacent")


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the set of its classes, and a random word, 0 for blanks."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LN":
            out[cp] = _PLAIN | (_LETTER if kind[0] == "L" else 0) | (_UPPER if kind == "Lu" else 0)
    out[[ord(c) for c in " \t\n\r.,;:'()-"]] |= _PLAIN
    out[[ord(c) for c in " \t\n\r"]] |= _SPACE
    out[ord("|")] |= _PIPE
    value = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out, np.where(out & _SPACE, np.uint64(0), value)


def measures(texts: list[str | None]) -> np.ndarray:
    """A row of _COUNTS for each text, null like ''.  Words are what blanks part;
    n_adjacent counts those equal to the word before.  In windows, so that a
    text's length doesn't matter."""
    classes, value = _classes()
    sums = np.zeros((len(texts), 6), np.int64)

    def also(who: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> None:
        c = classes[flat]
        c[offs[1:] - 1] = 0
        sums[who, 0] += np.diff(offs) - 1
        for k, bit in enumerate((_LETTER, _UPPER, _PLAIN, _SPACE, _PIPE), 1):
            sums[who, k] += np.add.reduceat((c & bit) != 0, offs[:-1], dtype=np.int64)

    h, n, owner = runs(texts, value, also)
    same = (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (owner[1:] == owner[:-1])
    words, adjacent = np.bincount(owner, minlength=len(texts)), np.bincount(owner[1:][same], minlength=len(texts))
    return np.stack([sums[:, 0], sums[:, 0] - sums[:, 4], words, sums[:, 0] - sums[:, 3], sums[:, 5], sums[:, 2], sums[:, 1], adjacent], 1)


def counts(text: Column) -> Column:
    """Struct of the measures from which the rules are computed.  In batches of
    code points, which takes a tenth of the time of the regular expressions and
    array functions that say the same."""

    @F.pandas_udf(", ".join(f"{k} bigint" for k in _COUNTS))
    def f(texts: pd.Series) -> pd.DataFrame:
        out = measures([t if isinstance(t, str) else None for t in texts])
        trim()
        return pd.DataFrame(out, columns=list(_COUNTS))

    return f(text)


def _mask(which: int) -> str:
    """SQL of the bit set of failed rules; bit 5: no words at all."""
    bits = [f"CASE WHEN {a} * {r[which]} > {b} AND n_chars >= 20 THEN {1 << i} ELSE 0 END" for i, (a, b, *r) in enumerate(RULES.values())]
    return " + ".join([*bits, "CASE WHEN n_words = 0 THEN 32 ELSE 0 END"])


def flag(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``hard_fails`` and ``soft_fails``, bit sets over the rules in
    the order of RULES, bit 5 for a text without words (null and '' alike).
    Columns already so called are replaced."""
    (c,) = unused(df, "__rules")
    out = bounded(df).withColumn(c, counts(F.col(f"`{text}`").cast("string")))
    deep = {k: f"{c}.{k}" for k in ("n_chars", "n_words", "n_symbols", "n_pipes", "n_upper", "n_letters", "n_adjacent", "n_solid")}

    def sql(which: int) -> str:
        return re.sub(r"n_\w+", lambda m: deep[m.group()], _mask(which))

    return out.withColumns({"hard_fails": F.expr(sql(0)).cast("int"), "soft_fails": F.expr(sql(1)).cast("int")}).drop(c)


def host_rates(flags: DataFrame) -> DataFrame:
    """One row per host of (host, soft_fails): documents, failures, and the rate
    shrunk by the empirical beta prior.  Hosts without spread, or a single one,
    get the uninformative prior (1, 1).  A null host is a host like any other."""
    per = flags.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum((F.col("soft_fails") > 0).cast("bigint")).alias("host_fails"))
    rate = F.col("host_fails") / F.col("host_docs")
    prior = per.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.expr("CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 END")
    prior = prior.select(F.coalesce(F.col("m") * strength, F.lit(1.0)).alias("a"), F.coalesce((1 - F.col("m")) * strength, F.lit(1.0)).alias("b"))
    # one row, whatever the size of the input
    return per.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_fails", ((F.col("host_fails") + F.col("a")) / (F.col("host_docs") + F.col("a") + F.col("b"))).alias("host_rate"))


def judge(df: DataFrame, text: str = "text", host: str = "source", host_rate: float = HOST_RATE, with_text: bool = True, lost_text: bool = True) -> DataFrame:
    """``df`` with host_docs, host_fails, host_rate, hard_fails, soft_fails, keep.

    One row per row of ``df``: repeated rows and null ids are judged like others,
    an empty table gives an empty one, and same-named columns are replaced; null
    and empty texts fail the rule for texts without words.  The flagged rows are
    written to the shared folder, so the rules run once over each text and the
    host sums read two columns.  Few hosts are broadcast and no text is shuffled;
    more hosts than the session's threshold are joined by shuffle.  Without
    ``with_text`` the text column is left out, of what is written too; without
    ``lost_text`` the texts of hard failures are, and come back as nulls."""
    base = df.drop(*ADDED)
    (name,) = unused(base, "__host")
    flagged = flag(base, text)
    if not lost_text:
        flagged = flagged.withColumn(text, F.when(F.col("hard_fails") == 0, F.col(f"`{text}`")))
    flagged = cut(flagged if with_text else flagged.drop(text))
    rates = cut(host_rates(flagged.select(F.col(f"`{host}`").alias("host"), "soft_fails"))).withColumnRenamed("host", name)
    out = flagged.join(rates, F.col(f"`{host}`").eqNullSafe(F.col(name)), "left").drop(name)
    bad = (F.col("hard_fails") > 0) | ((F.col("soft_fails") > 0) & (F.coalesce(F.col("host_rate"), F.lit(0.0)) > host_rate))
    return out.withColumn("keep", ~bad)


QUERY = "op5_host_quality_rules"


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), with_text=False)
    return out.select("doc_id", "source", "hard_fails", "soft_fails", "host_docs", "host_fails", F.round("host_rate", 9).alias("host_rate"), "keep")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they were.
    Null, empty and blank texts go; repeated rows stay repeated; a null host is a
    host; a table without rows gives none."""
    own = {c: unused(docs, "__own_" + c)[0] for c in docs.columns if c.lower() in ADDED}
    kept = judge(docs.withColumnsRenamed(own), lost_text=False).where("keep")
    return kept.select(*[F.col("`" + own.get(c, c).replace("`", "``") + "`").alias(c) for c in docs.columns])


def ctes(table: str = "documents") -> str:
    """DuckDB WITH-list whose last table ``judged`` has all columns of judge()."""
    return f"""raw AS (SELECT *, coalesce(text, '') AS t_ FROM {table}),
      split_ AS (SELECT *, list_filter(string_split_regex(t_, '{_BLANK}'), lambda x: x <> '') AS w_ FROM raw),
      measured AS (SELECT * EXCLUDE (w_, t_, n_chars), length(t_) AS n_chars, n_chars AS n_chars_, len(w_) AS n_words,
        length(translate(t_, ' ' || chr(9) || chr(10) || chr(13), '')) AS n_solid,
        length(regexp_replace(t_, '[\\p{{L}}\\p{{N}} \\t\\n\\r.,;:''()-]+', '', 'g')) AS n_symbols,
        length(t_) - length(replace(t_, '|', '')) AS n_pipes,
        length(regexp_replace(t_, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
        length(regexp_replace(t_, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
        len(list_filter(w_, lambda x, i: i > 1 AND x = w_[i - 1])) AS n_adjacent FROM split_),
      flagged AS (SELECT *, CAST({_mask(0)} AS INTEGER) AS hard_fails, CAST({_mask(1)} AS INTEGER) AS soft_fails FROM measured),
      per AS (SELECT source, count(*) AS host_docs, CAST(sum(CASE WHEN soft_fails > 0 THEN 1 ELSE 0 END) AS BIGINT) AS host_fails FROM flagged GROUP BY source),
      moments AS (SELECT avg(host_fails / host_docs) AS m, var_samp(host_fails / host_docs) AS v FROM per),
      prior AS (SELECT coalesce(m * s, 1.0) AS a, coalesce((1 - m) * s, 1.0) AS b FROM (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 END AS s FROM moments)),
      rates AS (SELECT source AS host, host_docs, host_fails, (host_fails + a) / (host_docs + a + b) AS host_rate FROM per, prior),
      judged AS (SELECT *, NOT (hard_fails > 0 OR (soft_fails > 0 AND host_rate > {HOST_RATE})) AS keep
        FROM flagged JOIN rates ON source IS NOT DISTINCT FROM host)"""


SQL = f"WITH {ctes()} SELECT doc_id, source, hard_fails, soft_fails, host_docs, host_fails, round(host_rate, 9) AS host_rate, keep FROM judged"
