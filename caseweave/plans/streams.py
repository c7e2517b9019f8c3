"""Queries that run streams over the test tables to their end, with SQL for what must come out."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.sources.files import blobs
from caseweave.sources.shared import fresh_folder
from caseweave.sources.views import _list, pick, read
from caseweave.streaming import gates, ledger, limits

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that arbitrary state needs."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a folder or one file (a pattern is taken for either)."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(found: DataFrame, name: str) -> DataFrame:
    """All rows that a stream gives for what is there, as a table."""
    spark, folder = found.sparkSession, fresh_folder(found.sparkSession, name)
    with rocks(spark):
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def gate_outcomes(spark, sf_dir):
    """Errors that wait for a purchase of their user, as a stream: what is settled a day before the last of either."""
    e = stream(spark, sf_dir, "events")
    asked = e.where(F.col("event_type") == "error").select(F.col("user_id").alias("case_id"), F.col("ts").alias("requested"))
    answers = e.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("case_id"), F.col("ts").alias("confirmed"))
    return finished(gates.gate_stream(asked, answers), "gate")


def case_runs(spark, sf_dir):
    """Runs of users' cases from a stream of commands: two steps, the second after a confirmation."""
    kind = F.create_map(*[F.lit(x) for p in (("signup", "process"), ("purchase", "confirm"), ("error", "cancel")) for x in p])
    commands = stream(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), kind[F.col("event_type")].alias("action"), F.col("ts").cast("timestamp").alias("at")).where(F.col("action").isNotNull())

    def whole(due: DataFrame) -> DataFrame:
        return due.select("case_id", F.lit(True).alias("ok"), F.lit("").alias("value"))

    folder = fresh_folder(spark, "runs")
    book = ledger.Ledger(f"{folder}/book", [ledger.Step("extract", whole), ledger.Step("report", whole, "confirm")])
    query = book.start(commands, f"{folder}/checkpoint")
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return book.state(spark, last).select("case_id", "run", "stage", F.size("done").alias("steps"))


def sliding_outcomes(spark, sf_dir):
    """Requests judged by a sliding window as they stream by: those that are settled a minute before the last."""
    return finished(limits.sliding_stream(stream(spark, sf_dir, "events"), 86400, 3), "sliding")


STAGES = ["completato", "idle", "elaborazione", "revisione_anomalie", "errore"]


def failure_stages(spark, sf_dir):
    """Customers by the stage of their case after its run has failed."""
    stage = gates.final_status(pick(STAGES, F.col("c_custkey")), F.lit("errore"))
    return read(spark, sf_dir, "customer").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def stored_blobs(spark, sf_dir):
    """The files of a table as blobs: how many bytes each has, and that they are what is stored."""
    found = blobs(spark, f"{sf_dir}/part.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", (F.octet_length("content") == F.col("length")).alias("whole"), F.md5("content").alias("digest"))


QUERIES = {f.__name__: f for f in (gate_outcomes, case_runs, sliding_outcomes, failure_stages, stored_blobs)}
ORACLE_SQL = {
    "gate_outcomes": """WITH e AS (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('error', 'purchase')), mark AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS m FROM e),
        g AS (SELECT a.user_id AS case_id, a.ts AS requested, min(b.ts) AS confirmed FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 7 DAY WHERE a.event_type = 'error' GROUP BY a.user_id, a.ts)
        SELECT case_id, requested, confirmed FROM g, mark WHERE epoch_us(coalesce(confirmed, requested + INTERVAL 7 DAY)) < m""",
    "failure_stages": f"SELECT CASE WHEN s IN ('idle', 'completato') THEN s ELSE 'errore' END AS stage, count(*) AS n FROM (SELECT list_extract({_list(STAGES)}, CAST(c_custkey % 5 AS INTEGER) + 1) AS s FROM customer) GROUP BY 1",
    "sliding_outcomes": """WITH mark AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 60000000 AS m FROM events), t AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events)
        SELECT user_id, ts, recent, recent <= 3 AS allowed FROM t, mark WHERE epoch_us(ts) < m""",
    "case_runs": """WITH runs AS (SELECT user_id AS case_id, max(ts) AS run FROM events WHERE event_type = 'signup' GROUP BY user_id),
        told AS (SELECT case_id, run, coalesce(bool_or(event_type = 'error'), false) AS over, coalesce(bool_or(event_type = 'purchase'), false) AS sure FROM runs LEFT JOIN events ON user_id = case_id AND ts >= run GROUP BY case_id, run)
        SELECT case_id, run, CASE WHEN over THEN 'idle' WHEN sure THEN 'completato' ELSE 'elaborazione' END AS stage, CAST(CASE WHEN over THEN 0 WHEN sure THEN 2 ELSE 1 END AS INTEGER) AS steps FROM told""",
}
