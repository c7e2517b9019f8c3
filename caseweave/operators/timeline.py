"""Event timelines: the order of a case's events and what windows over it give.

A timeline has case_id, event_id, event_date, event_type, type_rank (place of the type in its declared order) and,
once numbered, order_number. Every function keeps one partitioning by case, so they chain without more shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order() -> Window:
    return Window.partitionBy("case_id").orderBy("order_number")


def whole_case() -> Window:
    return Window.partitionBy("case_id")


def days_ahead(first: int, last: int | None = None):
    """Events of the case dated `first` to `last` days after the row's own (no end if None).

    Without an end the days are taken backwards, so that the frame only grows from row to row.
    """
    by = Window.partitionBy("case_id")
    if last is None:
        return by.orderBy(F.unix_date("event_date").desc()).rangeBetween(Window.unboundedPreceding, -first)
    return by.orderBy(F.unix_date("event_date")).rangeBetween(first, last)


def numbered(events: DataFrame) -> DataFrame:
    """Add order_number: by date, declared order of types, then event_id; from 1 within each case."""
    by = Window.partitionBy("case_id").orderBy("event_date", "type_rank", "event_id")
    return events.withColumn("order_number", F.row_number().over(by))


def undated(date: str | Column = "event_date") -> Column:
    """Whether a date is the placeholder for a missing one (any in 1900)."""
    return F.year(date) == 1900


def days_between(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.datediff(b, a)).cast("long")


def first_of(condition: Column, *columns: str) -> Column:
    """The first event in order that fulfils `condition`, as a struct of order_number and columns, over a window or group."""
    return F.min(F.when(condition, F.struct("order_number", *columns)))


def last_of(condition: Column, *columns: str) -> Column:
    return F.max(F.when(condition, F.struct("order_number", *columns)))


def first_and_last(timeline: DataFrame) -> DataFrame:
    """The events at the first and last place of each case and the days between."""
    ends = timeline.groupBy("case_id").agg(F.count("*").alias("events"), F.min_by("event_date", "order_number").alias("first_date"), F.max_by("event_date", "order_number").alias("last_date"))
    return ends.withColumn("days", days_between("first_date", "last_date"))


def intervals(timeline: DataFrame, event_type: str) -> DataFrame:
    """Days between consecutive events of one type, numbered from 1."""
    some = timeline.where(F.col("event_type") == event_type)
    found = some.withColumn("next_date", F.lead("event_date").over(in_order())).withColumn("interval", F.row_number().over(in_order()))
    return found.where(F.col("next_date").isNotNull()).select("case_id", "interval", "event_date", "next_date", days_between("event_date", "next_date").alias("days"))


def neighbour_swap(timeline: DataFrame, moved: Column) -> DataFrame:
    """Swap each event marked by `moved` with the next one of its case (marks must not be neighbours): event_id and new_order."""
    mark = F.coalesce(moved, F.lit(False))
    before = F.coalesce(F.lag(mark).over(in_order()), F.lit(False))
    last = F.lead("order_number").over(in_order()).isNull()
    shift = F.when(mark & ~last, 1).when(before, -1).otherwise(0)
    return timeline.select("case_id", "event_id", (F.col("order_number") + shift).alias("new_order"))


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Number new events (case_id, event_id, event_date, type_rank) after the existing ones of their case."""
    most = existing.groupBy("case_id").agg(F.max("order_number").alias("_most"))
    by = Window.partitionBy("case_id").orderBy("event_date", "type_rank", "event_id")
    counted = new.join(most, "case_id", "left").withColumn("order_number", F.coalesce("_most", F.lit(0)) + F.row_number().over(by))
    return counted.drop("_most")


def page_chunks(documents: DataFrame, size: int = 10) -> DataFrame:
    """Ranges of `size` pages of each document (document_id, n_pages): chunk from 0, first_page, last_page."""
    starts = documents.where(F.col("n_pages") > 0).select("document_id", "n_pages", F.posexplode(F.sequence(F.lit(1), F.col("n_pages"), F.lit(size))).alias("chunk", "first_page"))
    return starts.select("document_id", "chunk", "first_page", F.least(F.col("first_page") + size - 1, "n_pages").alias("last_page"))
