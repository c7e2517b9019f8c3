"""Column functions on dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_date(text: Column) -> Column:
    """An ISO date text as DD/MM/YYYY; other texts as they are."""
    parts = F.split(text, "-")
    shown = F.concat_ws("/", parts[2], parts[1], parts[0])
    return F.when(F.coalesce(text, F.lit("")) == "", "Data non disponibile").when(text == "1900-01-01", "Data non documentata").when(F.size(parts) != 3, text).otherwise(shown)


def months(days: Column) -> Column:
    """Whole months of 30 days, halves upward."""
    return F.floor(days / 30.0 + 0.5).cast("long")


def duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def time_ago(seconds: Column) -> Column:
    """How long ago a number of whole seconds is, in the largest whole unit of seconds, minutes, hours or days; it may be longer than timestamps reach back."""
    s = seconds.cast("long")
    whole = lambda unit, name: F.concat(F.call_function("div", s, F.lit(unit)).cast("string"), F.lit(name))
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, whole(60, "m")).when(s < 86400, whole(3600, "h")).otherwise(whole(86400, "g"))
    return F.concat(text, F.lit(" fa"))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding by the floor of x + 0.5 at the last digit."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale
