"""Case runs as a stream of commands: steps whose results are remembered, gates between them, retries, cancellation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """A step of a run: `work` turns the due cases (case_id, run) into results (case_id, ok, value); it begins once the run has had the command `needs`."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    needs: str = "process"


STATE = "case_id long, run timestamp, stage string, heard array<string>, done array<string>, failures int"
RESULT = "case_id long, run timestamp, ok boolean, value string"
COMMAND = "case_id long, action string, at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


class Ledger:
    """The durable record of runs in a shared folder: commands of each batch, results of each step of a batch, the state of all cases after it.

    A run is a case from its last `process` on. Each table of a batch is written once and whole: a batch that is run again
    takes what is there as its own and goes on behind it, so a step whose results were written is not done again.
    Within a batch commands count in order of time; `cancel` ends the run, and what it has not begun by
    then stays undone, whichever batch brings it. A case that a step fails (or gives no result for) is tried again with the next
    batch, `retries` times; then its stage is errore. Cases that wait for a command have the stage of it.
    """

    def __init__(self, folder: str, steps: list[Step], retries: int = 1) -> None:
        self.folder, self.steps, self.retries = folder.rstrip("/"), steps, retries

    def _path(self, kind: str, number: int, step: str = "") -> str:
        return f"{self.folder}/{kind}/batch={number}" + (f"/step={step}" if step else "")

    def _kept(self, path: str, schema: str, make: Callable[[SparkSession], DataFrame], spark: SparkSession) -> DataFrame:
        """The table at the path; made and written first if it isn't there."""
        if not exists(spark, path):
            make(spark).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    def state(self, spark: SparkSession, number: int) -> DataFrame:
        """All cases after a batch; before the first there are none."""
        return spark.read.schema(STATE).parquet(self._path("state", number)) if number >= 0 else spark.createDataFrame([], STATE)

    def _heard(self, before: DataFrame, rows: DataFrame) -> DataFrame:
        """The state after the commands: a new run forgets what was done, a cancelled one has the stage idle."""
        every = rows.groupBy("case_id").agg(F.max(F.when(F.col("action") == "process", F.col("at"))).alias("new"), F.collect_list(F.struct("at", "action")).alias("said"))
        both = before.join(every, "case_id", "full")
        run = F.coalesce("new", "run")
        since = F.filter(F.coalesce("said", F.array().cast("array<struct<at:timestamp,action:string>>")), lambda c: c["at"] >= run)
        words = F.array_distinct(F.concat(F.when(F.col("new").isNull(), F.coalesce("heard", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), F.transform(since, lambda c: c["action"])))
        fresh = F.col("new").isNotNull()
        told = both.where(run.isNotNull()).select("case_id", run.alias("run"), words.alias("heard"), F.when(fresh, F.array().cast("array<string>")).otherwise(F.col("done")).alias("done"), F.when(fresh, 0).otherwise(F.col("failures")).alias("failures"), F.when(~fresh, F.col("stage")).alias("stage"))
        over = F.array_contains("heard", "cancel")
        stage = F.when(over & ~F.coalesce(F.col("stage").isin("completato", "errore"), F.lit(False)), "idle").otherwise(F.coalesce("stage", F.lit("elaborazione")))
        return told.select("case_id", "run", stage.alias("stage"), F.when(over, F.array().cast("array<string>")).otherwise(F.col("heard")).alias("heard"), "done", "failures")

    def batch(self, rows: DataFrame, number: int) -> None:
        """Take the commands of a batch and do the steps that are due."""
        spark = rows.sparkSession
        if exists(spark, self._path("state", number)):
            return
        given = rows.select(F.col("case_id").cast("long").alias("case_id"), "action", F.col("at").cast("timestamp").alias("at")).where(F.col("case_id").isNotNull())
        commands = self._kept(self._path("commands", number), COMMAND, lambda _: given, spark)
        now = self._heard(self.state(spark, number - 1), commands)
        now = self._kept(self._path("heard", number), STATE, lambda _: now.select([f.split()[0] for f in STATE.split(", ")]), spark)
        for place, step in enumerate(self.steps):
            before = [s.name for s in self.steps[:place]]
            ready = F.size(F.array_except(F.array(*map(F.lit, before)), "done")) == 0 if before else F.lit(True)
            due = now.where((F.col("stage") == "elaborazione") & F.array_contains("heard", step.needs) & ready & ~F.array_contains("done", step.name)).select("case_id", "run")
            due = self._kept(self._path("due", number, step.name), "case_id long, run timestamp", lambda _, due=due: due, spark)
            if due.isEmpty():
                continue

            def work(_, step=step, due=due):
                return due.join(step.work(due).select("case_id", "ok", "value"), "case_id", "left").select("case_id", "run", F.coalesce("ok", F.lit(False)).alias("ok"), "value").dropDuplicates(["case_id"])

            got = self._kept(self._path("results", number, step.name), RESULT, work, spark).select("case_id", F.col("ok").alias("_ok"))
            held = now.join(got, "case_id", "left")
            done = F.when(F.col("_ok"), F.concat("done", F.array(F.lit(step.name)))).otherwise(F.col("done"))
            failures = F.when(F.col("_ok"), 0).when(~F.col("_ok"), F.col("failures") + 1).otherwise(F.col("failures"))
            # a case that failed waits for the next batch, so no later step of this one is due
            stage = F.when(~F.col("_ok") & (F.col("failures") >= self.retries), "errore").when(F.lit(place == len(self.steps) - 1) & F.col("_ok"), "completato").otherwise(F.col("stage"))
            now = held.select("case_id", "run", stage.alias("stage"), "heard", done.alias("done"), failures.alias("failures"))
        self._kept(self._path("state", number), STATE, lambda _: now, spark)

    def results(self, spark: SparkSession) -> DataFrame:
        """case_id, run, step, ok, value and batch of every step done so far."""
        return spark.read.schema(RESULT + ", batch long, step string").parquet(f"{self.folder}/results")

    def start(self, commands: DataFrame, checkpoint: str, **trigger):
        """Follow a stream of commands (case_id, action, at); its checkpoint and the ledger's folder belong together."""
        return commands.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def waiting(state: DataFrame, steps: list[Step]) -> DataFrame:
    """case_id and the command that its run waits for: that of its first step not done, if it was not heard yet."""
    needs = F.lit(None).cast("string")
    for step in reversed(steps):
        needs = F.when(~F.array_contains("done", step.name), step.needs).otherwise(needs)
    open_ = state.where(F.col("stage") == "elaborazione").withColumn("needs", needs)
    return open_.where(F.col("needs").isNotNull() & ~F.array_contains("heard", F.col("needs"))).select("case_id", "needs")
