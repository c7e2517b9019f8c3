"""State of many keys as columns: keys are dealt to buckets by a hash, and a bucket's rows are held as arrays in one value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

#: Keys share as many states; a state grows with the open rows of its keys (fixed value, as states are found by it).
BUCKETS = 4096


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def taken(rows, *names: str) -> tuple[np.ndarray, ...]:
    """Columns of long or boolean values of all frames of a bucket, as longs."""
    frames = [[f[n].to_numpy(np.int64) for n in names] for f in rows]
    return tuple(np.concatenate(c) for c in zip(*frames, strict=True)) if frames else tuple(np.zeros(0, np.int64) for _ in names)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it, in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Held:
    """The rows of a bucket, columns of longs, and the one timer that is set for it."""

    def __init__(self, handle: StatefulProcessorHandle, width: int) -> None:
        self.handle, self.width = handle, width
        self.value = handle.getValueState("held", "wake long, data binary")

    def load(self) -> tuple[int | None, np.ndarray]:
        found = self.value.get()
        if found is None:
            return None, np.zeros((self.width, 0), np.int64)
        return int(found[0]), np.frombuffer(bytes(found[1]), "<i8").reshape(self.width, -1)

    def store(self, before: int | None, wake: int | None, rows: np.ndarray) -> None:
        """Hold rows until the watermark has passed `wake` (microseconds); `before` is the timer that is set already, if any."""
        if wake is None:
            self.value.clear()
            return
        at = wake // 1000 + 1
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        self.value.update((at, np.ascontiguousarray(rows, "<i8").tobytes()))

