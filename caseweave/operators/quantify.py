"""Table-based quantities: damage amounts, interpolated amounts, combined and residual percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import packs
from caseweave.functions.dates import half_up


def _at(values: list[float], place: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, values)), place.cast("int"))


def _whole(x: Column) -> Column:
    return x == F.floor(x)


def damage_amount(percent: Column, age: Column) -> Column:
    """Amount for a percentage: small ones by coefficient and a reduction with age, large ones by two tables; null out of range. An age of 0 counts as unknown."""
    p, known = percent.cast("double"), age.isNotNull() & (age != 0)
    small = F.when(_whole(p), F.coalesce(_at(packs.MICRO, p), F.lit(1.0))).otherwise(1.0)
    reduction = F.when(known & (age > 10), F.greatest(1 - 0.005 * (age - 10), F.lit(0.1))).otherwise(1.0)
    large = F.when(_whole(p), _at(packs.MACRO, p - 9))
    years = F.greatest(F.least(age, F.lit(100)), F.lit(1))
    by_age = F.when(known, F.when(_whole(years), F.coalesce(_at(packs.AGES, years), F.lit(0.8))).otherwise(0.8)).otherwise(0.856)
    amount = F.when((p >= 1) & (p <= 9), packs.POINT * small * p * reduction).when((p > 9) & (p <= 100), packs.POINT * large * by_age * p)
    return half_up(amount, 2)


def _between(anchors: list[tuple[float, float]], x: Column, digits: int) -> Column:
    """The value at x, on a line between neighbouring anchors, rounded; the anchors' own values are exact."""
    found = F.lit(None).cast("double")
    for (a, u), (b, v) in zip(anchors, anchors[1:], strict=False):
        line = half_up(F.lit(float(u)) + (x - float(a)) / float(b - a) * float(v - u), digits)
        found = F.when((x > a) & (x < b), line).otherwise(found)
    for a, u in anchors:
        found = F.when(x == a, float(u)).otherwise(found)
    return found


def interpolated_amount(percent: Column, age: Column) -> Column:
    """amount, multiplier and per_point for 10 to 100 per cent (zeros outside), by lines between anchors."""
    p = half_up(percent)
    years = F.greatest(F.least(F.greatest(age.cast("double"), F.lit(0.0)), F.lit(100.0)), F.lit(1.0))
    multiplier = _between(packs.AGE_ANCHORS, years, 4)
    amount = half_up(_between(packs.AMOUNT_ANCHORS, p, 0) * multiplier)
    inside = (p >= 10) & (p <= 100)
    zero = F.lit(0.0)
    return F.struct(F.when(inside, amount).otherwise(zero).alias("amount"), F.when(inside, multiplier).otherwise(zero).alias("multiplier"), F.when(inside, half_up(amount / p, 2)).otherwise(zero).alias("per_point"))


def combined(percentages: Column) -> Column:
    """Percentages combined one after the other, each of what the others leave."""
    left = F.aggregate(F.sort_array(percentages.cast("array<double>"), asc=False), F.lit(0.0), lambda t, p: t + p - t * p / 100)
    return half_up(left, 2)


def residual(total: Column, before: Column) -> Column:
    """The share of what was left before that the total takes away; null for impossible pairs."""
    fine = total.between(0, 100) & (before >= 0) & (before < 100) & (total >= before)
    return F.when(fine, F.when(before == 0, total.cast("double")).otherwise(half_up((total - before) / (100 - before) * 100, 2)))


def psychic(assessments: DataFrame) -> DataFrame:
    """case_id and combined percentage of assessments (case_id, domain, severity 1 to 4): 0 if any domain is unknown."""
    most = F.create_map(*[F.lit(x) for d, n in packs.BPCA_DOMAINS.items() for x in (d, float(n))])[F.col("domain")]
    score = half_up(most * _at(packs.BPCA_SEVERITY, F.col("severity")), 2)
    found = assessments.withColumn("score", score).groupBy("case_id").agg(F.collect_list("score").alias("scores"), F.bool_or(F.col("score").isNull()).alias("odd"))
    return found.select("case_id", F.when(F.col("odd"), 0.0).otherwise(combined(F.col("scores"))).alias("combined"))


def damage_ranges(t: DataFrame) -> DataFrame:
    """The range of each case by its type, narrowed by what happened, with amounts at its middle by both tables. Needs case_type."""
    kinds = packs.DAMAGE_RANGES
    low = F.create_map(*[F.lit(x) for k, (a, _) in kinds.items() for x in (k, a)])[F.col("case_type")]
    high = F.create_map(*[F.lit(x) for k, (_, b) in kinds.items() for x in (k, b)])[F.col("case_type")]
    rows = t.groupBy("case_id", "case_type").agg(F.count_if(F.col("event_type") == "intervento").alias("surgeries"), F.bool_or(F.col("event_type") == "complicanza").alias("complication"))
    rows = rows.withColumns({"low": low, "high": high}).where(F.col("low").isNotNull())
    rows = rows.withColumn("low", F.when(F.col("surgeries") > 1, F.least(F.col("low") + 5, F.col("high"))).otherwise(F.col("low")))
    rows = rows.withColumn("low", F.when(F.col("complication"), F.least(F.col("low") + 3, F.col("high"))).otherwise(F.col("low")))
    cap = F.when(F.col("surgeries") == 0, F.when(F.col("case_type") == "ortopedica", 15).when(F.col("case_type") == "rc_auto", 9))
    rows = rows.withColumn("high", F.least(F.col("high"), cap)).withColumn("middle", half_up((F.col("low") + F.col("high")) / 2))
    other = F.when(F.col("middle") >= 10, interpolated_amount(F.col("middle"), F.lit(35)))
    return rows.select("case_id", "case_type", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("middle").cast("long").alias("middle"), damage_amount(F.col("middle"), F.lit(None).cast("int")).alias("amount"), other["amount"].alias("other_amount"), (F.col("surgeries") >= 2).alias("concurrent"))
