"""The training-data queries and their SQL oracles."""

from __future__ import annotations

from chunkloom.llm import jaccard, language, lines, media, packing, scoring, search, sharding, tokens, warc

MODULES = (tokens, warc, lines, language, packing, sharding, media, scoring, search, jaccard)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
