"""Streams against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from caseweave.streaming import gates, ledger, limits


def run(query_df, tmp_path, name, spark, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def requests(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:{m:02d}:00") for u in (1, 2) for m in (0, 1, 2, 11, 12, 25)] + [(3, "2024-01-01 00:00:30")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df


def test_fixed_windows_open_at_the_first_request(spark, tmp_path):
    df = requests(spark, tmp_path)
    assert {(r.user_id, r.allowed, r.refused) for r in limits.fixed(df, 600, 2).collect()} == {(1, 5, 1), (2, 5, 1), (3, 1, 0)}
    stream = limits.fixed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 600, 2)
    found = run(stream, tmp_path, "fixed_windows", spark).groupBy("user_id").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("r"))
    assert {tuple(r) for r in found.collect()} == {(1, 5, 1), (2, 5, 1), (3, 1, 0)}


def test_sliding_windows(spark, tmp_path):
    found = limits.sliding(requests(spark, tmp_path), 600, 2).where("user_id = 1").orderBy("ts").collect()
    assert [r.recent for r in found] == [1, 2, 3, 2, 2, 1]


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def times(spark, rows, name):
    return spark.createDataFrame(rows, "case_id long, t string").select("case_id", F.col("t").cast("timestamp").alias(name))


def outcomes(df):
    return sorted((str(r.case_id), str(r.requested), str(r.confirmed)) for r in df.collect())


def test_a_gate_has_one_outcome(rocks, tmp_path):
    """Confirmations before their request has come, doubled, too late for the gate, too late for the stream; two requests of a case; nulls."""
    a = [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01"), (4, "2024-01-02"), (4, "2024-01-04"), (4, "2024-01-04"), (None, "2024-01-01")]
    b = [(1, "2024-01-05"), (1, "2024-01-03"), (1, "2024-01-03"), (2, "2024-01-08 00:00:01"), (3, "2024-01-08"), (4, "2024-01-06"), (None, "2024-01-02"), (7, "2024-01-02")]
    end = [(99, "2024-02-01")]
    want = outcomes(gates.gate(times(rocks, a, "requested"), times(rocks, b, "confirmed")))
    assert len(want) == 6 and [w[2][:10] for w in want] == ["2024-01-03", "None", "2024-01-08", "2024-01-06", "2024-01-06", "None"]
    streams = {}
    for k, (name, column) in enumerate((("a", "requested"), ("b", "confirmed"))):
        times(rocks, [], column).write.parquet(str(tmp_path / name))
        streams[name] = rocks.readStream.schema(times(rocks, [], column).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    found = gates.gate_stream(streams["a"], streams["b"])

    def arrive(name, column, rows):
        times(rocks, rows, column).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def go():
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress

    arrive("b", "confirmed", b)  # all confirmations first, then the requests in two parts
    arrive("a", "requested", a[:3])
    arrive("a", "requested", a[3:])
    go()
    arrive("a", "requested", end)
    progress = go()
    assert sum(x["numRowsTotal"] for x in progress["stateOperators"]) <= 2  # that of the request that moved time on
    arrive("b", "confirmed", [(2, "2024-01-02")])  # too late for the stream: nothing waits for it
    go()
    assert outcomes(rocks.read.parquet(str(tmp_path / "out"))) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_stream_equals_its_twin_in_any_order(rocks, tmp_path, seed):
    """Requests in three batches, shuffled within the watermark, some at one time, one too late."""
    rng = random.Random(seed)
    times_ = sorted(rng.choice([rng.randrange(0, 7_200), rng.randrange(0, 7_200) // 60 * 60]) for _ in range(150))
    rows = [(rng.randrange(1, 4), f"2024-01-01 {10 + t // 3600}:{t // 60 % 60:02d}:{t % 60:02d}", t) for t in times_] + [(None, "2024-01-01 10:00:00", 0)]
    frame = lambda part: rocks.createDataFrame([r[:2] for r in part], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    frame([]).write.parquet(folder)
    stream = limits.sliding_stream(rocks.readStream.schema(frame([]).schema).parquet(folder), 600, 3, "30 minutes")
    parts = [[r for r in rows if r[2] // 2400 == k] for k in range(3)] + [[(99, "2024-01-02 10:00:00", 0)], [(1, "2024-01-01 10:00:00", 0)]]
    for k, (a, b) in enumerate(zip(parts, parts[1:3], strict=False)):  # some of each come with the next
        move = [r for r in a if r[2] // 2400 == k and r[2] % 2400 > 1200 and rng.random() < 0.5]
        a[:] = [r for r in a if r not in move]
        b += move
    for part in parts:
        rng.shuffle(part)
        frame(part).coalesce(1).write.mode("append").parquet(folder)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = limits.sliding(frame([r for r in rows if r[0]]), 600, 3).collect()
    got = rocks.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.user_id, r.ts, r.recent, r.allowed) for r in got) == sorted((r.user_id, r.ts, r.recent, r.allowed) for r in want)
    assert sum(x["numRowsTotal"] for x in q.lastProgress["stateOperators"]) <= 3


def commands(spark, rows):
    return spark.createDataFrame(rows, "case_id long, action string, at string").withColumn("at", F.col("at").cast("timestamp"))


class Done:
    """Steps that note for which cases they were called; `bad` fails cases, `broken` the whole step, each so many times."""

    def __init__(self):
        self.calls, self.bad, self.broken = [], {}, {}

    def step(self, name, needs="process"):
        def work(due):
            ids = sorted(r.case_id for r in due.collect())
            if self.broken.get(name, 0):
                self.broken[name] -= 1
                raise RuntimeError("executor lost")
            self.calls += [(name, i) for i in ids]
            fails = [i for i in ids if self.bad.get((name, i), 0)]
            for i in fails:
                self.bad[name, i] -= 1
            return due.select("case_id", (~F.col("case_id").isin(fails or [-1])).alias("ok"), F.lit(name).alias("value"))

        return ledger.Step(name, work, needs)


def follow(spark, tmp_path, book, rows):
    """One batch of commands through the stream; whether it failed."""
    commands(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return resume(spark, tmp_path, book)


def resume(spark, tmp_path, book):
    q = book.start(spark.readStream.schema(commands(spark, []).schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    try:
        q.awaitTermination(120)
    except Exception:
        return True
    return False


def stages(book, spark, number):
    return {r.case_id: r.stage for r in book.state(spark, number).collect()}


def test_a_batch_that_is_run_again_does_its_steps_once(spark, tmp_path):
    done = Done()
    book = ledger.Ledger(str(tmp_path / "book"), [done.step("ocr"), done.step("extract"), done.step("report")])
    done.broken["extract"] = 1
    assert follow(spark, tmp_path, book, [(1, "process", "2024-01-01"), (2, "process", "2024-01-01")])
    assert done.calls == [("ocr", 1), ("ocr", 2)]
    assert not resume(spark, tmp_path, book)
    assert done.calls == [("ocr", 1), ("ocr", 2), ("extract", 1), ("extract", 2), ("report", 1), ("report", 2)]
    assert stages(book, spark, 0) == {1: "completato", 2: "completato"}
    # the whole batch again, as after a lost checkpoint
    book.batch(commands(spark, [(1, "process", "2024-01-01"), (2, "process", "2024-01-01")]), 0)
    assert len(done.calls) == 6 and book.results(spark).count() == 6


def test_a_cancel_in_a_later_batch_stops_what_has_not_begun(spark, tmp_path):
    done = Done()
    steps = [done.step("ocr"), done.step("consolidate", "confirm"), done.step("report", "confirm")]
    book = ledger.Ledger(str(tmp_path / "book"), steps)
    follow(spark, tmp_path, book, [(1, "process", "2024-01-01"), (2, "process", "2024-01-01"), (3, "process", "2024-01-01"), (3, "cancel", "2024-01-02"), (4, "cancel", "2024-01-01")])
    assert done.calls == [("ocr", 1), ("ocr", 2)]
    assert sorted(map(tuple, ledger.waiting(book.state(spark, 0), steps).collect())) == [(1, "confirm"), (2, "confirm")]
    follow(spark, tmp_path, book, [(2, "cancel", "2024-01-03"), (1, "confirm", "2024-01-03"), (2, "confirm", "2024-01-04")])
    assert done.calls[2:] == [("consolidate", 1), ("report", 1)]
    assert stages(book, spark, 1) == {1: "completato", 2: "idle", 3: "idle"}
    # a new run of a cancelled case starts from the first step; a completed case keeps its stage
    follow(spark, tmp_path, book, [(2, "process", "2024-01-05"), (1, "cancel", "2024-01-06")])
    assert done.calls[4:] == [("ocr", 2)] and stages(book, spark, 2) == {1: "completato", 2: "elaborazione", 3: "idle"}


def test_failed_cases_are_tried_again_and_then_given_up(spark, tmp_path):
    done = Done()
    done.bad = {("ocr", 1): 1, ("ocr", 2): 5}
    book = ledger.Ledger(str(tmp_path / "book"), [done.step("ocr"), done.step("report")])
    follow(spark, tmp_path, book, [(1, "process", "2024-01-01"), (2, "process", "2024-01-01"), (3, "process", "2024-01-01")])
    assert stages(book, spark, 0) == {1: "elaborazione", 2: "elaborazione", 3: "completato"}
    follow(spark, tmp_path, book, [(9, "process", "2024-01-02")])
    assert stages(book, spark, 1) == {1: "completato", 2: "errore", 3: "completato", 9: "completato"}
    follow(spark, tmp_path, book, [(9, "cancel", "2024-01-03")])
    assert done.calls.count(("ocr", 2)) == 2


def test_final_status_keeps_idle_and_completed(spark):
    df = spark.createDataFrame([("idle",), ("completato",), ("elaborazione",)], "s string")
    assert [r[0] for r in df.select(gates.final_status(F.col("s"), F.lit("errore"))).collect()] == ["idle", "completato", "errore"]
