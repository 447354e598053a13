"""The queries of this package and their SQL, for registration."""

from __future__ import annotations

from . import decontaminate, langid, lm, pii, rules, secrets, sharding, simhash, spm, warc

_MODULES = (warc, spm, pii, lm, rules, decontaminate, sharding, langid, secrets, simhash)


def queries() -> dict:
    return {m.QUERY: m.query for m in _MODULES} | {lm.TRIGRAM_QUERY: lm.trigram_query, spm.ROUND_TRIP_QUERY: spm.round_trip_query}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.SQL for m in _MODULES if getattr(m, "SQL", None)} | {lm.TRIGRAM_QUERY: lm.TRIGRAM_SQL, spm.ROUND_TRIP_QUERY: spm.ROUND_TRIP_SQL}
