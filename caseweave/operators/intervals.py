"""Intervals over texts: greedy choice, union and complement. Intervals have doc_id, start and end (end excluded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The union of the intervals of each key; touching ones become one."""
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def uncovered(union: DataFrame, totals: DataFrame, least: int = 200, key: str = "doc_id") -> DataFrame:
    """What `union` (from merged) leaves of each text (key, length), from `least` characters on."""
    ends = totals.select(key, F.col("length").alias("start"), F.col("length").alias("end"))
    by = Window.partitionBy(key).orderBy("start", "end")
    both = union.select(key, "start", "end").join(totals.select(key), key, "left_semi").unionByName(ends)
    gaps = both.select(key, F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"), F.col("start").alias("to"))
    return gaps.where(F.col("to") - F.col("from") >= least).select(key, F.col("from").alias("start"), F.col("to").alias("end"))


def greedy(spans: Column) -> Column:
    """Of an array of structs with start and end those kept when taken by start, the longer first, each if it begins where the last kept one ended or later."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    none = F.filter(spans, lambda x: F.lit(False))
    return F.aggregate(ordered, none, lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["end"]), F.array_append(kept, x)).otherwise(kept))
