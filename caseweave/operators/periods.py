"""Periods of a case: stays, spans, intervals, disability. Each gives case_id, label, days, start_date and end_date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.timeline import days_ahead, days_between, first_and_last, first_of, intervals, last_of, whole_case


def _period(rows: DataFrame, label, start: str, end: str) -> DataFrame:
    days = days_between(start, end)
    return rows.select("case_id", (F.lit(label) if isinstance(label, str) else label).alias("label"), days.alias("days"), F.col(start).alias("start_date"), F.col(end).alias("end_date"))


def discharge():
    """Whether an event speaks of a discharge."""
    return F.lower("title").contains("dimission") | F.lower("description").contains("dimission")


def stays(t: DataFrame) -> DataFrame:
    """From each admission to the first event in order that is dated later and speaks of a discharge; admission_order tells stays apart."""
    rows = t.withColumn("_out", first_of(discharge(), "event_date").over(days_ahead(1))).where((F.col("event_type") == "ricovero") & F.col("_out").isNotNull())
    return rows.select("case_id", F.lit("ricovero").alias("label"), days_between("event_date", "_out.event_date").alias("days"), F.col("event_date").alias("start_date"), F.col("_out.event_date").alias("end_date"), F.col("order_number").alias("admission_order"))


def spans(t: DataFrame) -> DataFrame:
    return _period(first_and_last(t), "malattia", "first_date", "last_date")


def surgery_intervals(t: DataFrame) -> DataFrame:
    return _period(intervals(t, "intervento"), F.concat(F.lit("interventi "), F.col("interval").cast("string")), "event_date", "next_date")


def diagnosis_to_treatment(t: DataFrame) -> DataFrame:
    """From each diagnosis to the first treatment in order dated the same day or later, if days lie between."""
    treated = first_of(F.col("event_type").isin("intervento", "terapia"), "event_date").over(days_ahead(0))
    rows = t.withColumn("_t", treated).where((F.col("event_type") == "diagnosi") & F.col("_t").isNotNull()).withColumn("_end", F.col("_t.event_date"))
    return _period(rows, "diagnosi-trattamento", "event_date", "_end").where(F.col("days") > 0)


def total_disability(t: DataFrame) -> DataFrame:
    """The sum of the days of all stays (overlapping ones count twice)."""
    found = stays(t).groupBy("case_id").agg(F.sum("days").alias("days"), F.min_by("start_date", "admission_order").alias("start_date"), F.max_by("end_date", "admission_order").alias("end_date"))
    return found.select("case_id", F.lit("ITT").alias("label"), "days", "start_date", "end_date").where(F.col("days") > 0)


def partial_disability(t: DataFrame) -> DataFrame:
    """From the last discharge in order to the last control in order (a follow-up, or a visit dated after that discharge; any visit where there is none), if it is later."""
    rows = t.withColumn("_out", last_of(discharge(), "event_date").over(whole_case()))
    control = (F.col("event_type") == "follow-up") | ((F.col("event_type") == "visita") & F.coalesce(F.col("event_date") > F.col("_out.event_date"), F.lit(True)))
    ends = rows.groupBy("case_id").agg(F.first("_out").alias("_out"), last_of(control, "event_date").alias("_in"))
    ends = ends.select("case_id", F.col("_out.event_date").alias("a"), F.col("_in.event_date").alias("b")).where(F.col("b") > F.col("a"))
    return _period(ends, "ITP", "a", "b")


def all_periods(t: DataFrame) -> DataFrame:
    parts = [stays(t).drop("admission_order"), spans(t), surgery_intervals(t), diagnosis_to_treatment(t), total_disability(t), partial_disability(t)]
    return reduce(DataFrame.unionByName, parts).where(F.col("days").isNotNull())
