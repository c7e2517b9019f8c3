"""Column functions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that are added up together by `sums_before`.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it: sums of blocks first, then within each block."""

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        whole = F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), F.lit(0), lambda s, x: s + x))
        first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"))
        starts = F.aggregate(whole, first, lambda s, x: F.struct(F.array_append(s["starts"], s["at"] + x).alias("starts"), (s["at"] + x).alias("at")), lambda s: s["starts"])

        def place(at: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                return F.get(at, b) + F.aggregate(F.slice(v, b * BLOCK + 1, i % BLOCK), F.lit(0), lambda s, y: s + y)

            return F.transform(v, one)

        return let(starts, place)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast("array<int>"))


def has_repeated(values: Column, times: int) -> Column:
    """Whether some value is in an array `times` times and more."""

    def of(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(v) - times)
        return F.when(F.size(v) >= times, F.exists(places, lambda i: F.get(v, i) == F.get(v, i + times - 1))).otherwise(F.lit(False))

    return let(F.array_sort(values), of)
