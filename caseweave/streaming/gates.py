"""Gates: a request waits for its confirmation; subscriptions and final stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseweave.streaming.columns import Held, bucket, firsts, taken


def gate(requests: DataFrame, confirmations: DataFrame, days: int = 7) -> DataFrame:
    """case_id, requested and confirmed: the first confirmation within `days` of a request, null where the gate times out."""
    a, b = requests.select("case_id", "requested"), confirmations.select(F.col("case_id").alias("_case"), "confirmed")
    within = (F.col("case_id") == F.col("_case")) & (F.col("confirmed") >= F.col("requested")) & (F.col("confirmed") <= F.col("requested") + F.expr(f"INTERVAL {days} DAYS"))
    return a.join(b, within, "left").groupBy("case_id", "requested").agg(F.min("confirmed").alias("confirmed"))


#: A request without a confirmation so far.
OPEN = np.iinfo(np.int64).max


class Gate(StatefulProcessor):
    """The cases of a bucket: their open requests, each with its first confirmation so far, and the confirmations that a request to come may still meet.

    Times are microseconds. A request is answered once the watermark has passed its first confirmation, so no
    earlier one can come, or its end; a confirmation goes once the watermark has passed it.
    """

    def __init__(self, days: int) -> None:
        self.width = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Held(handle, 5)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, old = self.held.load()
        none, case, given, at = taken(rows, "none", "case_id", "given", "us")
        both = np.concatenate([old, np.array([none, case, at, given, np.full_like(at, OPEN)])], axis=1)
        both = both[:, np.lexsort((both[4], both[3], both[2], both[1], both[0]))]  # a request before a confirmation of its time
        none, case, at, given, first = both = both[:, firsts(*both[:4])]
        # the next confirmation of each row, from the last row on
        place = np.where(given == 1, np.arange(len(at)), len(at))
        place = np.minimum.accumulate(place[::-1])[::-1]
        near = np.minimum(place, len(at) - 1)
        meets = (given == 0) & (none == 0) & (place < len(at)) & (none[near] == 0) & (case[near] == case) & (at[near] <= at + self.width)
        both[4] = np.where(meets, np.minimum(first, at[near]), first)
        self.held.store(before, self._wake(both), both)
        return iter(())

    def _end(self, both: np.ndarray) -> np.ndarray:
        """When each row goes."""
        _, _, at, given, first = both
        return np.where(given == 1, at, np.where(first == OPEN, at + self.width, first))

    def _wake(self, both: np.ndarray) -> int | None:
        return int(self._end(both).min()) if both.shape[1] else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        both = self.held.load()[1]
        gone = self._end(both) < timerValues.getCurrentWatermarkInMs() * 1000
        left = both[:, ~gone]
        self.held.store(None, self._wake(left), left)
        none, case, at, _, first = both[:, gone & (both[3] == 0)]
        if len(at):
            whole = lambda v, null: pd.Series(v, dtype="Int64").mask(null)
            yield pd.DataFrame({"case_id": whole(case, none == 1), "requested": at, "confirmed": whole(first, first == OPEN)})


def gate_stream(requests: DataFrame, confirmations: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """The same over two streams: exactly one row for each case and time of a request, with its first confirmation or null.

    Rows may come in any order, the two streams by up to `late` behind each other; what comes later is left out. A
    row goes out when the watermark has passed the confirmation or the end of the gate. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    a = requests.select("case_id", F.lit(0).alias("given"), F.col("requested").cast("timestamp").alias("at"))
    # null is no case, so nothing confirms it
    b = confirmations.where(F.col("case_id").isNotNull()).select("case_id", F.lit(1).alias("given"), F.col("confirmed").cast("timestamp").alias("at"))
    both = a.unionByName(b).withWatermark("at", late).withColumn("us", F.unix_micros("at")).where(F.col("us").isNotNull())
    both = both.withColumn("none", F.col("case_id").isNull().cast("int")).withColumn("case_id", F.coalesce(F.col("case_id").cast("long"), F.lit(0)))
    found = both.withColumn("bucket", bucket("case_id")).groupBy("bucket").transformWithStateInPandas(Gate(days), "case_id long, requested long, confirmed long", "Append", "EventTime")
    return found.select("case_id", F.timestamp_micros("requested").alias("requested"), F.timestamp_micros("confirmed").alias("confirmed"))


def subscriptions(events: DataFrame) -> DataFrame:
    """user_id and status after the last of its subscription events (user_id, kind, at, event_id)."""
    status = F.create_map(*[F.lit(x) for p in (("checkout", "active"), ("updated", "active"), ("deleted", "canceled"), ("failed", "past_due")) for x in p])
    known = events.withColumn("status", status[F.col("kind")]).where(F.col("status").isNotNull())
    return known.groupBy("user_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"))


def final_status(current: Column, outcome: Column) -> Column:
    """The stage after a failure: an idle or completed case keeps its stage."""
    return F.when(current.isin("idle", "completato"), current).otherwise(outcome)
