"""Case-file views of the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators.timeline import numbered
from caseweave.packs import CASE_TYPES, EVENT_TYPES
from caseweave.shipping import importable

#: Texts that stand for clinical notes, by event number modulo their count.
NOTES = ["pa 215/130 all ingresso", "fc 190 bpm", "spo2 80%", "dimissione in buone condizioni", "glicemia 450 mg/dl", "temperatura 42,5", "controllo regolare", "consenso informato firmato", "pa 120/80, fc 70", "diario clinico, esami pre-operatori"]
DIAGNOSES = ["frattura scomposta femore destro", "frattura composta femore sinistro", "lesione meniscale ginocchio mediale", "distorsione cervicale recente trauma", "lombalgia"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values)).cast("int") + 1)


def _events(rows: DataFrame, case: str, event: str, at: str) -> DataFrame:
    e = F.col(event)
    kind = pick(EVENT_TYPES, e)
    return rows.select(
        F.col(case).alias("case_id"), e.alias("event_id"), (e % 4).alias("document_id"), F.to_date(at).alias("event_date"), kind.alias("event_type"),
        (e % len(EVENT_TYPES)).cast("int").alias("type_rank"), F.concat(kind, F.lit(" "), e.cast("string")).alias("title"), pick(NOTES, F.floor(e / 15)).alias("description"),
        F.when(e % 15 % 3 == 2, pick(DIAGNOSES, F.floor(e / 15))).alias("diagnosis"), pick(CASE_TYPES, F.col(case)).alias("case_type"),
    )


def timeline_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of their customers' cases: few and far apart."""
    return numbered(_events(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate"))


def timeline_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users' cases: many and close."""
    return numbered(_events(read(spark, sf_dir, "events"), "user_id", "event_id", "ts"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for p in (("F", "archiviato"), ("O", "in_lavorazione"), ("P", "bozza")) for x in p])
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("user_id"), status[F.col("o_orderstatus")].alias("status"), pick(CASE_TYPES, F.col("o_orderkey")).alias("case_type"), F.to_date("o_orderdate").alias("updated_on"), F.col("o_totalprice").alias("amount"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("c_custkey") % 5 != 4, F.element_at(F.array(*map(F.lit, (90, 180, 365, 730))), F.least(F.col("c_custkey") % 5, F.lit(3)).cast("int") + 1))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("plan"), days.alias("retention_days"), F.col("c_nationkey").alias("nation"))


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "errore").when(F.col("l_linestatus") == "F", "completato").otherwise("in_coda")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("document_id"), F.col("l_linenumber").alias("number"), status.alias("status"), F.to_date("l_shipdate").alias("updated_on"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("pages"))


def _list(values: list) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _timeline_sql(table: str, case: str, event: str, at: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY event_date, type_rank, event_id) AS order_number FROM (
        SELECT {case} AS case_id, {event} AS event_id, {event} % 4 AS document_id, CAST({at} AS DATE) AS event_date,
               list_extract({_list(EVENT_TYPES)}, CAST({event} % 15 AS INTEGER) + 1) AS event_type, CAST({event} % 15 AS INTEGER) AS type_rank,
               list_extract({_list(EVENT_TYPES)}, CAST({event} % 15 AS INTEGER) + 1) || ' ' || {event} AS title,
               list_extract({_list(NOTES)}, CAST(({event} // 15) % {len(NOTES)} AS INTEGER) + 1) AS description,
               CASE WHEN {event} % 15 % 3 = 2 THEN list_extract({_list(DIAGNOSES)}, CAST(({event} // 15) % {len(DIAGNOSES)} AS INTEGER) + 1) END AS diagnosis,
               list_extract({_list(CASE_TYPES)}, CAST({case} % 13 AS INTEGER) + 1) AS case_type
        FROM {table})"""


#: The views as SQL, to be put into WITH.
SQL = {
    "sparse": _timeline_sql("orders", "o_custkey", "o_orderkey", "o_orderdate"),
    "dense": _timeline_sql("events", "user_id", "event_id", "ts"),
    "cases": f"""SELECT o_orderkey AS case_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'archiviato' WHEN 'O' THEN 'in_lavorazione' WHEN 'P' THEN 'bozza' END AS status,
        list_extract({_list(CASE_TYPES)}, CAST(o_orderkey % 13 AS INTEGER) + 1) AS case_type, CAST(o_orderdate AS DATE) AS updated_on, o_totalprice AS amount FROM orders""",
    "profiles": "SELECT c_custkey AS user_id, c_name AS full_name, c_mktsegment AS plan, list_extract([90, 180, 365, 730, NULL], CAST(c_custkey % 5 AS INTEGER) + 1) AS retention_days, c_nationkey AS nation FROM customer",
    "case_documents": """SELECT l_orderkey AS case_id, l_orderkey * 100 + l_linenumber AS document_id, l_linenumber AS number,
        CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'errore' WHEN l_linestatus = 'F' THEN 'completato' ELSE 'in_coda' END AS status, CAST(l_shipdate AS DATE) AS updated_on, l_partkey AS part, l_quantity AS pages FROM lineitem""",
}


def with_views(*names: str) -> str:
    """The head of a SQL query that uses these views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
