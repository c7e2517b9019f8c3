"""Queries over stored tables: versions by copy on write, re-processing, contracts; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.operators import contracts
from caseweave.operators.contracts import Column
from caseweave.sources import views
from caseweave.sources.shared import fresh_folder
from caseweave.sources.versions import VersionedTable
from caseweave.sources.views import read, with_views


def stored_upserts(spark, sf_dir):
    """Low values of users' events as a stored table, in which high ones are put, those of users with a high view patched and those of users with a high error deleted: four versions."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    table = VersionedTable(spark, fresh_folder(spark, "stored"), "user_id", 16)
    table.create(e.where(F.col("value") < 20).groupBy("user_id", "event_type").agg(F.min("value").alias("value")))
    table.upsert(e.where(F.col("value") >= 20), ["user_id", "event_type"])
    table.patch(table.read().where((F.col("event_type") == "view") & (F.col("value") > 150)).groupBy("user_id").agg(F.lit(-1.0).alias("value")), "user_id")
    table.delete(table.read().where((F.col("event_type") == "error") & (F.col("value") > 150)).select("user_id"), "user_id")
    return table.read()


def reprocessed_documents(spark, sf_dir):
    """The documents of cases, with those of drafts derived anew: of over ten pages alone."""
    documents = views.case_documents(spark, sf_dir).select("case_id", "document_id", "status", F.col("pages").cast("double").alias("pages"))
    table = VersionedTable(spark, fresh_folder(spark, "documents"), "case_id", 16)
    table.create(documents)
    drafts = views.cases(spark, sf_dir).where(F.col("status") == "bozza").select("case_id")
    table.replace(drafts, documents.where(F.col("pages") > 10).withColumn("status", F.lit("rielaborato")))
    return table.read()


CONTRACT = [
    Column("orders", "o_orderkey", "bigint", required=True, unique=True), Column("orders", "o_orderstatus", "string", labels=("F", "O")), Column("orders", "o_custkey", "bigint", refers=("customer", "c_custkey")), Column("orders", "o_note", "string"),
    Column("lineitem", "l_orderkey", "bigint", unique=True, refers=("orders", "o_orderkey")), Column("events", "event_type", "string", required=True, labels=("view", "click", "signup", "purchase")), Column("events", "value", "string"),
    Column("documents", "text", "string", required=True), Column("labels", "doc_id", "bigint", unique=True, refers=("documents", "doc_id")), Column("pages", "page_id", "bigint", refers=("labels", "doc_id")),
]


def contract_report(spark, sf_dir):
    """Every rule of a contract that the test tables keep in part."""
    tables = {t: read(spark, sf_dir, t) for t in dict.fromkeys([*(c.table for c in CONTRACT), *(c.refers[0] for c in CONTRACT if c.refers)])}
    return contracts.contract_report(spark, tables, CONTRACT)


def label_sets(spark, sf_dir):
    return contracts.label_sets(read(spark, sf_dir, "events"), ["event_type"]).unionByName(contracts.label_sets(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


def _contract_sql() -> str:
    def row(c: Column, rule: str, fine: str, n: str, detail: str, source: str = "") -> str:
        return f"SELECT '{c.table}' AS table_name, '{c.name}' AS column_name, '{rule}' AS rule, {fine} AS fine, {n} AS violations, {detail} AS detail{source}"

    kinds = {"value": "double"}
    parts = []
    for c in CONTRACT:
        found = "no column" if c.name == "o_note" else kinds.get(c.name, c.kind)
        parts.append(row(c, "present", str(found == c.kind).lower(), f"{int(found != c.kind)}::BIGINT", f"'{found}'"))
        if found == "no column":
            continue
        if c.required:
            parts.append(row(c, "required", "n = 0", "n", "CAST(NULL AS VARCHAR)", f" FROM (SELECT count(*) FILTER (WHERE {c.name} IS NULL) AS n FROM {c.table})"))
        if c.labels:
            listed = ", ".join(f"'{x}'" for x in c.labels)
            parts.append(row(c, "labels", "n = 0", "n", "d", f" FROM (SELECT count({c.name}) AS n, min({c.name}) AS d FROM {c.table} WHERE {c.name} NOT IN ({listed}))"))
        counted = f"SELECT {c.name} AS v, count(*) AS k FROM {c.table} WHERE {c.name} IS NOT NULL GROUP BY {c.name}"
        if c.unique:
            parts.append(row(c, "unique", "n = 0", "n", "d", f" FROM (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS n, CAST(min(v) AS VARCHAR) AS d FROM ({counted}) WHERE k > 1)"))
        if c.refers:
            parts.append(row(c, "refers", "n = 0", "n", "d", f" FROM (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS n, CAST(min(v) AS VARCHAR) AS d FROM ({counted}) WHERE v NOT IN (SELECT {c.refers[1]} FROM {c.refers[0]}))"))
    return " UNION ALL ".join(parts)


QUERIES = {f.__name__: f for f in (stored_upserts, reprocessed_documents, contract_report, label_sets)}
ORACLE_SQL = {
    "stored_upserts": """WITH e AS (SELECT user_id, event_type, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS new, value FROM events), u AS (SELECT user_id, event_type, CASE WHEN max(new) = 1 THEN max(value) ELSE min(value) END AS value FROM e GROUP BY user_id, event_type),
        p AS (SELECT user_id, event_type, CASE WHEN user_id IN (SELECT user_id FROM u WHERE event_type = 'view' AND value > 150) THEN -1.0::DOUBLE ELSE value END AS value FROM u)
        SELECT * FROM p WHERE user_id NOT IN (SELECT user_id FROM p WHERE event_type = 'error' AND value > 150)""",
    "reprocessed_documents": with_views("cases", "case_documents") + """, b AS (SELECT case_id FROM cases WHERE status = 'bozza') SELECT case_id, document_id, CASE WHEN case_id IN (SELECT case_id FROM b) THEN 'rielaborato' ELSE status END AS status, CAST(pages AS DOUBLE) AS pages
        FROM case_documents WHERE case_id NOT IN (SELECT case_id FROM b) OR pages > 10""",
    "contract_report": _contract_sql(),
    "label_sets": "SELECT 'event_type' AS column_name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels FROM events UNION ALL SELECT 'o_orderstatus', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders",
}
