"""Rules over timelines. Each gives case_id, anomaly_type, severity, order_a, order_b and days (null where they don't apply)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave import packs
from caseweave.functions.text import long_words
from caseweave.operators.timeline import days_ahead, days_between, first_of, in_order, undated, whole_case

FINDING = ["case_id", "anomaly_type", "severity", "order_a", "order_b", "days"]


KINDS = "array<struct<anomaly_type:string,severity:string,order_a:long,order_b:long,days:long>>"


def _finding(kind: str, severity: Column, a: Column, b: Column | None = None, days: Column | None = None) -> Column:
    none = F.lit(None).cast("long")
    columns = [F.lit(kind), severity, a.cast("long"), none if b is None else b.cast("long"), none if days is None else days.cast("long")]
    return F.struct(*(c.alias(n) for c, n in zip(columns, FINDING[1:], strict=True)))


def _listed(rows: DataFrame, finding: Column) -> DataFrame:
    return rows.select("case_id", finding.alias("_f")).select("case_id", "_f.*")


#: What a rule needs of the timeline beside its own row, as windows by name; they share one partitioning, and one sort an order.
WINDOWS: dict[str, Callable[[], Column]] = {
    "_n": lambda: F.count("*").over(whole_case()),
    "_documents": lambda: F.size(F.collect_set("document_id").over(whole_case())),
    "_next": lambda: F.lead(F.struct("order_number", "event_date")).over(in_order()),
    "_visit": lambda: first_of((F.col("event_type") == "visita") & ~undated("event_date"), "event_date").over(whole_case()),
    "_surgery": lambda: F.min(F.when(F.col("event_type") == "intervento", F.col("order_number"))).over(whole_case()),
    "_consents": lambda: F.count_if(F.col("event_type") == "consenso").over(whole_case()),
    "_control": lambda: first_of(F.col("event_type").isin(packs.CONTROLS) & ~undated("event_date"), "event_date").over(days_ahead(1)),
    "_later": lambda: F.count("*").over(days_ahead(1)),
    "_treated": lambda: F.max(F.when(F.col("event_type").isin(packs.TREATMENTS), F.col("order_number"))).over(days_ahead(0, packs.COMPLICATION_DAYS)),
    "_controls": lambda: F.count_if(F.col("event_type").isin(packs.CONTROLS)).over(days_ahead(1, packs.THERAPY_DAYS)),
}


def _gap() -> Column:
    """Over 180 days between neighbours, both dated, in cases of five events or more."""
    days = days_between("event_date", "_next.event_date")
    fits = (F.col("_n") >= packs.GAP_EVENTS) & ~undated("event_date") & ~undated("_next.event_date") & (days > packs.GAP_DAYS)
    return F.when(fits, _finding("gap_documentale", F.when(days > packs.LONG_GAP_DAYS, "alta").otherwise("media"), F.col("order_number"), F.col("_next.order_number"), days))


def _no_follow_up() -> Column:
    """Surgery whose first later control is over 60 days off, or that has none though later events exist."""
    days = days_between("event_date", "_control.event_date")
    fits = (F.col("event_type") == "intervento") & ~undated("event_date") & ((days > packs.SURGERY_DAYS) | (F.col("_control").isNull() & (F.col("_later") > 0)))
    return F.when(fits, _finding("gap_post_chirurgico", F.when(days > packs.SURGERY_ALTA, "alta").otherwise("media"), F.col("order_number"), F.col("_control.order_number"), days))


def _unmanaged() -> Column:
    """A complication without a treatment further on in order within 14 days."""
    fits = (F.col("event_type") == "complicanza") & ~undated("event_date") & F.coalesce(F.col("_treated") <= F.col("order_number"), F.lit(True))
    return F.when(fits, _finding("complicanza_non_gestita", F.lit("alta"), F.col("order_number")))


def _no_consent() -> Column:
    """Surgery but no consent in cases of more than one document; the first surgery is named."""
    fits = (F.col("order_number") == F.col("_surgery")) & (F.col("_documents") > 1) & (F.col("_consents") == 0)
    return F.when(fits, _finding("consenso_non_documentato", F.lit("media"), F.col("order_number")))


def _uncontrolled() -> Column:
    """Therapy without a control within 30 days though later events exist, in cases of more than one document."""
    fits = (F.col("event_type") == "terapia") & ~undated("event_date") & (F.col("_controls") == 0) & (F.col("_later") > 0) & (F.col("_documents") > 1)
    return F.when(fits, _finding("terapia_senza_followup", F.lit("bassa"), F.col("order_number")))


#: Rules on single rows, and the windows that they need.
ROW_RULES: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "documentation_gaps": (_gap, ("_n", "_next")),
    "late_follow_up": (_no_follow_up, ("_control", "_later")),
    "unmanaged_complication": (_unmanaged, ("_treated",)),
    "missing_consent": (_no_consent, ("_surgery", "_consents", "_documents")),
    "uncontrolled_therapy": (_uncontrolled, ("_controls", "_later", "_documents")),
}


def by_row(t: DataFrame, *names: str) -> DataFrame:
    """The findings of several rules on single rows, in one pass over the timeline."""
    windows = dict.fromkeys(w for n in names for w in ROW_RULES[n][1])
    rows = t.withColumns({w: WINDOWS[w]() for w in windows})
    found = F.array_compact(F.array(*(ROW_RULES[n][0]() for n in names))).cast(KINDS)
    return rows.select("case_id", F.explode(found).alias("_f")).select("case_id", "_f.*")


def documentation_gaps(t: DataFrame) -> DataFrame:
    return by_row(t, "documentation_gaps")


def late_follow_up(t: DataFrame) -> DataFrame:
    return by_row(t, "late_follow_up")


def unmanaged_complication(t: DataFrame) -> DataFrame:
    return by_row(t, "unmanaged_complication")


def missing_consent(t: DataFrame) -> DataFrame:
    return by_row(t, "missing_consent")


def uncontrolled_therapy(t: DataFrame) -> DataFrame:
    return by_row(t, "uncontrolled_therapy")


def late_diagnosis(t: DataFrame) -> DataFrame:
    """Over 90 days from the first visit to the first diagnosis on or after it."""
    dated = t.where(~undated("event_date") & F.col("event_type").isin("visita", "diagnosi"))
    rows = dated.withColumn("visit", WINDOWS["_visit"]())
    rows = rows.where((F.col("event_type") == "diagnosi") & (F.col("event_date") >= F.col("visit.event_date")))
    rows = rows.groupBy("case_id").agg(F.first("visit").alias("visit"), F.min(F.struct("order_number", "event_date")).alias("found"))
    rows = rows.withColumn("days", days_between("visit.event_date", "found.event_date")).where(F.col("days") > packs.DIAGNOSIS_DAYS)
    severity = F.when(F.col("days") > packs.DIAGNOSIS_CRITICA, "critica").when(F.col("days") > packs.DIAGNOSIS_ALTA, "alta").otherwise("media")
    return _listed(rows, _finding("ritardo_diagnostico", severity, F.col("visit.order_number"), F.col("found.order_number"), F.col("days")))


def contradictory_diagnoses(t: DataFrame) -> DataFrame:
    """Pairs of the first 20 diagnoses of a case, within 60 days, that share at most a fifth of their longer words."""
    some = t.where((F.length("diagnosis") > 10) & ~undated("event_date"))
    some = some.withColumn("rank", F.row_number().over(in_order())).where(F.col("rank") <= packs.CONTRADICTION_MOST)
    text = F.trim(F.lower("diagnosis"))
    some = some.select("case_id", F.struct("order_number", "event_date", text.alias("text"), F.array_distinct(long_words(text, 3)).alias("words")).alias("x")).where(F.size("x.words") >= 3)
    listed = some.groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # 20 at most
    later = F.slice("xs", F.col("at") + 2, F.size("xs"))
    rows = listed.select("case_id", "xs", F.posexplode("xs").alias("at", "a")).select("case_id", "a", F.explode(later).alias("b"))
    days = days_between("a.event_date", "b.event_date")
    shared, most = F.size(F.array_intersect("a.words", "b.words")), F.greatest(F.size("a.words"), F.size("b.words"))
    rows = rows.where((days <= packs.CONTRADICTION_DAYS) & (F.col("a.text") != F.col("b.text")) & (shared / most <= 0.2))
    return _listed(rows, _finding("diagnosi_contraddittoria", F.lit("media"), F.col("a.order_number"), F.col("b.order_number"), days))


def clinical_values(t: DataFrame) -> DataFrame:
    """case_id, order_number, event_date, measure, value and severity of values outside the critical range: the first match of each measure in an event, the same value once a day."""
    rows = t.select("case_id", "order_number", "event_date", F.concat_ws(" ", "title", "description").alias("_t")).withColumn("_low", F.lower("_t"))

    def measure(name: str, pattern: str, least: float, most: float) -> Column:
        raw = F.regexp_replace(F.regexp_extract("_t", "(?i)" + pattern, 1), ",", ".")
        may = reduce(Column.__or__, (F.col("_low").contains(x) for x in packs.CLINICAL_STEMS.get(name, ("",))))
        return F.when(may, F.struct(F.lit(name).alias("measure"), raw.alias("raw"), F.lit(least).alias("least"), F.lit(most).alias("most")))

    measures = F.array_compact(F.array(*(measure(*m) for m in packs.CLINICAL)))
    rows = rows.select("case_id", "order_number", "event_date", F.explode(measures).alias("m")).select("case_id", "order_number", "event_date", "m.measure", F.expr("try_cast(m.raw AS double)").alias("value"), "m.least", "m.most")
    rows = rows.where((F.col("value") < F.col("least")) | (F.col("value") > F.col("most")))
    once = Window.partitionBy("case_id", "measure", "event_date", "value").orderBy("order_number")
    rows = rows.withColumn("_k", F.row_number().over(once)).where(F.col("_k") == 1)
    severity = F.when((F.col("value") < F.col("least") * 0.8) | (F.col("value") > F.col("most") * 1.2), "critica").otherwise("alta")
    return rows.select("case_id", "order_number", "event_date", "measure", "value", severity.alias("severity"))


def sequence_violations(t: DataFrame) -> DataFrame:
    """Events that lack a predecessor their rule asks for (in cases of three events or more), or come too long after the first one. Needs case_type."""
    rules = []
    for name, before, after, most, kinds, severity in packs.SEQUENCES:
        first = first_of(F.col("event_type").isin(before), "event_date").over(whole_case())
        applies = F.col("event_type").isin(after) & (F.lit(True) if kinds is None else F.col("case_type").isin(kinds))
        rules.append(F.when(applies, F.struct(F.lit(name).alias("rule"), first.alias("before"), F.lit(most).cast("long").alias("most"), F.lit(severity).alias("severity"))))
    rows = t.select("case_id", "order_number", "event_date", F.count("*").over(whole_case()).alias("n"), F.array_compact(F.array(*rules)).alias("_rules"))
    rows = rows.select("case_id", "order_number", "event_date", "n", F.explode("_rules").alias("r")).select("*", "r.*")
    early = F.coalesce(F.col("before.event_date") <= F.col("event_date"), F.lit(False))
    days = F.when(early, days_between("before.event_date", "event_date"))
    rows = rows.withColumns({"days": days, "early": early}).where((~F.col("early") & (F.col("n") >= 3)) | (F.col("early") & (F.col("n") >= 2) & (F.col("days") > F.col("most"))))
    return rows.select("case_id", "rule", "severity", F.col("order_number").cast("long").alias("order_a"), F.when(F.col("early"), F.col("before.order_number")).cast("long").alias("order_b"), "days")


def anomalies(t: DataFrame) -> DataFrame:
    """All rules over cases of two events or more, clinical values and sequences included; findings that are the same but for later events count once."""
    cases = t.withColumn("_n", F.count("*").over(whole_case())).where(F.col("_n") >= 2).drop("_n")
    values = _listed(clinical_values(cases), _finding("valore_clinico_critico", F.col("severity"), F.col("order_number")))
    sequences = _listed(sequence_violations(cases), _finding("sequenza_temporale_violata", F.col("severity"), F.col("order_a"), F.col("order_b"), F.col("days")))
    found = [by_row(cases, *ROW_RULES), late_diagnosis(cases), contradictory_diagnoses(cases), values, sequences]
    return reduce(DataFrame.unionByName, found).dropDuplicates(FINDING)


#: Severities in order.
SEVERITIES = ["critica", "alta", "media", "bassa"]


def severity_rank(severity: Column) -> Column:
    """0 for the gravest to 3, 4 for any other."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1
    return F.when(place >= 0, place).otherwise(4)


def gravest(found: DataFrame, most: int = 10) -> DataFrame:
    """Of each case the `most` gravest findings, earlier events first among equals, with their rank."""
    by = Window.partitionBy("case_id").orderBy(severity_rank(F.col("severity")), "order_a", "anomaly_type", "order_b", "days")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def surgeries_without_consent(t: DataFrame, most: int = 3) -> DataFrame:
    """case_id, surgeries and listed (the numbers of the first `most`, in order) of cases with surgery and no consent: what the finding of a missing consent tells."""
    surgery = t.where(F.col("event_type") == "intervento")
    counted = t.groupBy("case_id").agg(F.count_if(F.col("event_type") == "consenso").alias("_c"), F.count_if(F.col("event_type") == "intervento").alias("surgeries")).where((F.col("_c") == 0) & (F.col("surgeries") > 0))
    first = surgery.withColumn("_k", F.row_number().over(in_order())).where(F.col("_k") <= most).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("order_number")), lambda n: n.cast("string")), ",").alias("listed"))
    return counted.join(first, "case_id").select("case_id", "surgeries", "listed")
