"""Queries of the reference's own operators, by name, with their SQL."""

from __future__ import annotations

from caseweave.plans import details, records, reports, stored, streams, tables, texts, timelines

PACKS = (timelines, tables, texts, records, reports, details, streams, stored)
QUERIES: dict = {name: query for pack in PACKS for name, query in pack.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for pack in PACKS for name, sql in pack.ORACLE_SQL.items()}
