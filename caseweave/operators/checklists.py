"""Documents and contents that a case of a given type should have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave import packs


def _flags():
    text = F.lower(F.concat_ws(" ", "title", "description"))
    kind = F.col("event_type")
    return {
        "consenso": (kind == "consenso") | text.contains("consenso informato"),
        "anestesia": text.contains("anestesi") | text.contains("asa score"),
        "operatoria": (kind == "intervento") | text.contains("descrizione operatoria") | text.contains("verbale operatorio"),
        "dimissione": text.contains("dimissione"),
        "follow_up": (kind == "follow-up") | text.contains("follow-up") | text.contains("controllo post"),
        "pre_operatori": text.contains("pre-operatori") | text.contains("preoperatori"),
        "diario": text.contains("diario clinico") | text.contains("diario medico") | text.contains("diario infermieristico") | text.contains("cartella clinica"),
    }


def missing_documents(t: DataFrame) -> DataFrame:
    """case_id and document of those expected of the case's type whose sign no event shows. An exam before an operation is a sign of its own. Needs case_type."""
    first_exam = F.min(F.when(F.col("event_type") == "esame", F.col("event_date")))
    last_surgery = F.max(F.when(F.col("event_type") == "intervento", F.col("event_date")))
    found = t.groupBy("case_id", "case_type").agg(*(F.bool_or(v).alias(k) for k, v in _flags().items()), first_exam.alias("_e"), last_surgery.alias("_s"))
    found = found.withColumn("pre_operatori", F.col("pre_operatori") | F.coalesce(F.col("_e") < F.col("_s"), F.lit(False)))
    expected = F.create_map(*[x for k, rows in packs.EXPECTED.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(d).alias("document"), F.lit(f).alias("flag")) for d, f in rows)))])
    rows = found.select("case_id", F.create_map(*[x for k in packs.FLAGS for x in (F.lit(k), F.col(k))]).alias("_f"), F.explode(expected[F.col("case_type")]).alias("x"))
    return rows.where(~F.col("_f")[F.col("x.flag")]).select("case_id", "x.document")


def completeness(t: DataFrame) -> DataFrame:
    """case_id, requirement and met for each requirement of the case's type: whether any event holds one of its keywords (any case)."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    tests = [F.bool_or(F.lit(False) if not words else sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int")) > 0).alias(f"r{k}") for k, (_, _, words) in enumerate(packs.REQUIREMENTS)]
    found = t.groupBy("case_id", "case_type").agg(*tests)
    items = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("requirement"), F.col(f"r{k}").alias("met")) for k, (kind, name, _) in enumerate(packs.REQUIREMENTS)))
    rows = found.select("case_id", "case_type", F.explode(items).alias("x")).where(F.col("x.kind") == F.col("case_type"))
    return rows.select("case_id", "x.requirement", "x.met")


def completeness_rate(t: DataFrame) -> DataFrame:
    """The rounded percentage of requirements that a case meets."""
    return completeness(t).groupBy("case_id").agg(F.floor(100.0 * F.count_if("met") / F.count("*") + 0.5).cast("long").alias("percent"))
