"""Rate limits over requests (user_id, ts): sliding windows, and fixed ones that open at a user's first request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseweave.streaming.columns import Held, bucket, firsts, taken


def sliding(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """Requests with how many the user made in the last `seconds` (their own included), and whether that is allowed."""
    by = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("recent", F.count("*").over(by)).withColumn("allowed", F.col("recent") <= most)


class Sliding(StatefulProcessor):
    """The users of a bucket: the numbers of their requests at each time, in microseconds, that are in a window still or wait for the watermark.

    A request is judged once the watermark has passed its time, so all that count before it are there whatever their order.
    """

    def __init__(self, seconds: int, most: int) -> None:
        self.width, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Held(handle, 4)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, old = self.held.load()
        user, at = taken(rows, "user_id", "us")
        both = np.concatenate([old, np.array([user, at, np.ones_like(at), np.zeros_like(at)])], axis=1)
        both = both[:, np.lexsort((both[1], both[0]))]
        start = np.flatnonzero(firsts(both[0], both[1]))
        user, at, n, judged = both[0, start], both[1, start], np.add.reduceat(both[2], start), np.maximum.reduceat(both[3], start)
        self.held.store(before, self._wake(at, judged), np.array([user, at, n, judged]))
        return iter(())

    def _wake(self, at: np.ndarray, judged: np.ndarray) -> int | None:
        return int((at + self.width * judged).min()) if len(at) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        user, at, n, judged = self.held.load()[1]
        # rows and, behind those of their time, the ends of their windows: what is counted before an end is not in the window
        size = len(at)
        order = np.lexsort((np.repeat([0, 1], size), np.concatenate([at, at - self.width]), np.concatenate([user, user])))
        total = np.empty(2 * size, np.int64)
        total[order] = np.cumsum(np.concatenate([n, np.zeros_like(n)])[order])
        recent = total[:size] - total[size:]
        due = (judged == 0) & (at < now)
        judged = np.where(due, 1, judged)
        kept = at >= now - self.width  # no request to come is within reach of the others
        self.held.store(None, self._wake(at[kept], judged[kept]), np.array([user, at, n, judged])[:, kept])
        if due.any():
            yield pd.DataFrame({c: np.repeat(v[due], n[due]) for c, v in (("user_id", user), ("us", at), ("recent", recent))})


def sliding_stream(requests: DataFrame, seconds: int, most: int, late: str = "1 minute") -> DataFrame:
    """`sliding` over a stream: user_id, ts, recent and allowed of each request, once the watermark (`late` behind the last) has passed it.

    Requests may come in any order within the watermark. State is the times of one window a user, held for buckets of users as arrays, and goes with it. Needs
    the RocksDB state store. Requests of no user or no time are left out.
    """
    timed = requests.where(F.col("user_id").isNotNull()).select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).where(F.col("us").isNotNull())
    found = timed.withColumn("bucket", bucket("user_id")).groupBy("bucket").transformWithStateInPandas(Sliding(seconds, most), "user_id long, us long, recent long", "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("us").alias("ts"), "recent", (F.col("recent") <= most).alias("allowed"))


def fixed(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """user_id and how many of its requests are allowed and refused, walking over its times in order: a window opens at a request when the last one is over.

    Requests pass a task sorted by user and time, with the open window as all that is held, so no user's requests are gathered.
    """
    width = seconds * 1_000_000

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        user, opened, used, allowed, refused, done = None, None, 0, 0, 0, []

        def out(rows: list):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["user_id", "allowed", "refused"])

        some = False
        for batch in batches:
            for who, at in zip(batch.column("user_id").to_pylist(), batch.column("us").to_pylist(), strict=True):
                if not some or who != user:
                    if some:
                        done.append((user, allowed, refused))
                    some, user, opened, used, allowed, refused = True, who, None, 0, 0, 0
                if opened is None or at - opened >= width:
                    opened, used = at, 0
                fine = used < most
                used += fine
                allowed += fine
                refused += not fine
            if len(done) > 4096:
                yield out(done)
                done = []
        if some:
            done.append((user, allowed, refused))
        yield out(done)

    timed = requests.select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where(F.col("us").isNotNull())
    dealt = timed.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id").sortWithinPartitions("user_id", "us")
    return dealt.mapInArrow(walk, "user_id long, allowed long, refused long")


def fixed_stream(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """The same over a stream: user_id, ts and allowed of each request. State is one open window a user and goes when it is over."""
    width = pd.Timedelta(seconds=seconds)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        opened = pd.Timestamp(opened, unit="us") if opened is not None else None
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed = []
        for t in rows["ts"]:
            if opened is None or t - opened >= width:
                opened, n = t, 0
            allowed.append(n < most)
            n += n < most
        state.update((int(opened.value // 1000), int(n)))
        state.setTimeoutTimestamp(max(int((opened + width).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed)[["user_id", "ts", "allowed"]]

    timed = requests.withWatermark("ts", f"{seconds} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(judge, "user_id long, ts timestamp, allowed boolean", "opened long, n int", "append", "EventTimeTimeout")
