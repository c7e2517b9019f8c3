"""Smaller operators on timelines, uploads, reports and their context, and consolidation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.dates import shown_date
from caseweave.functions.text import SPACE, reliability, same_event
from caseweave.operators.links import not_yet_known
from caseweave.operators.timeline import in_order


def to_verify() -> Column:
    """Whether an event awaits verification: marked so, or without a date."""
    return F.coalesce(F.col("requires_verification"), F.lit(False)) | F.col("event_date").isNull()


def shown_events(t: DataFrame, only_open: bool = False, kind: str | None = None) -> DataFrame:
    """The events of a view (only those to verify, else those of one type, else all), with `open`, the group that each is in."""
    rows = t.withColumn("open", to_verify())
    return rows.where("open") if only_open else rows.where(F.col("event_type") == kind) if kind else rows


def fresh_uploads(offered: DataFrame, held: DataFrame) -> DataFrame:
    """Offered files (name, size, at) that are not among the held ones by name and size; of equal ones the first."""
    once = Window.partitionBy("name", "size").orderBy("at")
    new = offered.join(held.select("name", "size"), ["name", "size"], "left_anti")
    return new.withColumn("_k", F.row_number().over(once)).where(F.col("_k") == 1).drop("_k")


def jaccard_of_plain(a: Column, b: Column) -> Column:
    """Similarity of two texts by words of more than 3 characters, after all but letters, digits, underscores, spaces and àèéìòù is taken out: 1 if both have none, 0 if one has none."""
    plain = lambda t: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(t), r"[^A-Za-z0-9_àèéìòù\s]", ""), SPACE + "+"), lambda w: F.length(w) > 3))
    x, y = plain(a), plain(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared))


#: An image of the recognised pages in a text: its alternative text and path (fixed pattern).
PLACEHOLDER = r"!\[([^\]]*)\]\(ocr-image:([^)]+)\)"


def image_paths(text: Column) -> Column:
    """The paths of the images in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(2)))


def with_image_addresses(text: Column, case_id: Column) -> Column:
    """The text with its images at the address that serves them; paths are percent-encoded."""
    between = F.split(text, PLACEHOLDER, -1)
    names, paths = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(2))
    coded = lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
    shown = F.transform(names, lambda n, k: F.concat(F.lit("!["), n, F.lit("](/api/cases/"), case_id.cast("string"), F.lit("/images?path="), coded(F.get(paths, k)), F.lit(")"), F.get(between, k + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(shown, ""))


def classifier_input(name: Column, text: Column, most: int = 3000) -> Column:
    """What a classifier is asked: the name on one line (100 characters) and the first `most` characters of the text. The limits are the feature's."""
    begin = F.substring(F.coalesce(text, F.lit("")), 1, most)
    return F.concat(F.lit("Nome file: "), F.substring(F.regexp_replace(name, "[\n\r]", " "), 1, 100), F.lit("\n\nTesto documento (prime "), F.length(begin).cast("string"), F.lit(" caratteri):\n"), begin)


def section_context(t: DataFrame, most: int = 30) -> DataFrame:
    """case_id, events and context: lines of the first `most` events of a case, shorter where it has more, and a line on how many are left out."""
    rows = t.withColumns({"_k": F.row_number().over(in_order()), "_n": F.count("*").over(Window.partitionBy("case_id"))}).where(F.col("_k") <= most)
    told = F.substring("description", F.lit(1), F.when(F.col("_n") > most, 200).otherwise(300))
    line = F.concat(shown_date(F.date_format("event_date", "yyyy-MM-dd")), F.lit(" | "), "event_type", F.lit(": "), "title", F.lit(" — "), told)
    listed = F.array_sort(F.collect_list(F.struct("_k", line.alias("line"))))
    joined = rows.groupBy("case_id", F.col("_n").alias("events")).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))
    rest = F.when(F.col("events") > most, F.concat(F.lit("\n... ("), (F.col("events") - most).cast("string"), F.lit(" altri eventi)"))).otherwise("")
    return joined.select("case_id", "events", F.concat("lines", rest).alias("context"))


def report_excerpt(text: Column, most: int = 4000) -> Column:
    """What a rewrite sees of the whole report: its first `most` characters, and a mark if it goes on. The limit is the feature's."""
    held = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(held, 1, most), F.when(F.length(held) > most, "\n...(troncato)").otherwise(""))


def question_lines(t: DataFrame) -> DataFrame:
    """case_id and a line for each event in order: number, date, type, title, the first 200 characters of the description and the diagnosis."""
    diagnosis = F.when(F.coalesce(F.col("diagnosis"), F.lit("")) != "", F.concat(F.lit(" | Diagnosi: "), "diagnosis")).otherwise("")
    line = F.concat(F.lit("#"), F.col("order_number").cast("string"), F.lit(" "), F.date_format("event_date", "yyyy-MM-dd"), F.lit(" ["), "event_type", F.lit("] "), "title", F.lit(": "), F.substring("description", 1, 200), diagnosis)
    listed = F.array_sort(F.collect_list(F.struct("order_number", line.alias("line"))))
    return t.groupBy("case_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))


def progress(documents: DataFrame, steps: list[str]) -> DataFrame:
    """case_id, the earliest start of its documents in work or done, and the lowest step (place in `steps`) that any of them is at."""
    place = F.array_position(F.array(*map(F.lit, steps)), F.col("status")) - 1
    return documents.groupBy("case_id").agg(F.min(F.when(place > 0, F.col("started"))).alias("started"), F.min(F.when(place >= 0, place)).cast("long").alias("step"))


def provisional_number(first_page: Column, place: Column) -> Column:
    """The number of an event before consolidation: by the first page of its chunk and its place in it, from 0."""
    return (first_page - 1) * 100 + place + 1


def single(rows: DataFrame, *keys: str, optional: bool = False) -> DataFrame:
    """rows if each key has one; a key with several rows, or with one of nulls alone (as an outer join gives it, unless `optional`), ends the job with an error."""
    values = [c for c in rows.columns if c not in keys]
    n = F.count("*").over(Window.partitionBy(*keys))
    empty = F.lit(bool(values) and not optional) & (F.coalesce(*(F.col(c).cast("string") for c in values)).isNull() if values else F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("expected one row for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return rows.withColumn("_n", n).where(F.when((F.col("_n") == 1) & ~empty, F.lit(True)).otherwise(wrong.cast("boolean"))).drop("_n")


def combined_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """key and sections, in order, of several case types together. wanted: key, types (array, the first is the primary one); sections: case_type, place, section_id.

    Each section once, the primary type's first; what other types add stands before `elementi_rilievo`, or at the end.
    """
    typed = wanted.select("key", F.posexplode("types").alias("_t", "case_type")).join(sections, "case_type")
    once = Window.partitionBy("key", "section_id").orderBy("_t", "place")
    rows = typed.withColumn("_k", F.row_number().over(once)).where(F.col("_k") == 1)
    last = F.min(F.when((F.col("section_id") == "elementi_rilievo") & (F.col("_t") == 0), F.col("place"))).over(Window.partitionBy("key"))
    group = F.when(F.col("section_id") == "elementi_rilievo", 2).when(F.col("_t") > 0, 1).when(F.col("place") > F.col("_last"), 3).otherwise(0)
    placed = rows.withColumn("_last", last).select("key", F.struct(group.alias("g"), "_t", "place", "section_id").alias("x"))
    return placed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["section_id"]).alias("sections"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows (user_id, action, at) to the log at path."""
    rows.select("user_id", "action", "at").write.mode("append").parquet(path)


#: What a report says of days, by measure (fixed patterns), and the days that it may be off.
NUMBERS = [("ITT", r"(?i)ITT[:\s]+(\d+)\s*giorn"), ("ITT", r"(?i)invalidità\s+temporanea\s+totale[:\s]+(\d+)\s*giorn"), ("ITP", r"(?i)ITP[:\s]+(\d+)\s*giorn"), ("ITP", r"(?i)invalidità\s+temporanea\s+parziale[:\s]+(\d+)\s*giorn"), ("Giorni ricovero", r"(?i)giorni\s+(?:di\s+)?ricovero[:\s]+(\d+)"), ("Giorni ricovero", r"(?i)ricovero[:\s]+(\d+)\s*giorn")]
DAYS_OFF = 2


def number_mismatches(reports: DataFrame, calculated: DataFrame) -> DataFrame:
    """case_id, measure, told and days where a report (case_id, synthesis) is over two days off what is calculated (case_id, label, days; of one measure the last label counts)."""
    low = F.lower("label")
    measure = F.when(low.contains("invalidità temporanea totale") | (low == "itt"), "ITT").when(low.contains("invalidità temporanea parziale") | (low == "itp"), "ITP").when(low.contains("ricovero"), "Giorni ricovero")
    known = calculated.where(F.col("days").isNotNull()).select("case_id", measure.alias("measure"), "label", "days").where(F.col("measure").isNotNull())
    known = known.groupBy("case_id", "measure").agg(F.max_by("days", "label").alias("days"))
    told = F.array(*(F.struct(F.lit(m).alias("measure"), F.regexp_extract("synthesis", p, 1).try_cast("bigint").alias("told")) for m, p in NUMBERS))
    rows = reports.select("case_id", F.explode(told).alias("x")).select("case_id", "x.*").where(F.col("told").isNotNull())
    return rows.join(known, ["case_id", "measure"]).where(F.abs(F.col("told") - F.col("days")) > DAYS_OFF)


def checked_values(raw: DataFrame) -> DataFrame:
    """Of extracted events (event_id, date as text, confidence): issue (a date that is none), confidence held to 0 to 100, and whether the event awaits verification."""
    fine = F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    held = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("confidence").cast("double")))
    return raw.select("event_id", F.when(~fine, "invalid_date").alias("issue"), held.alias("confidence"), (held != F.col("confidence")).alias("clamped"), (~fine).alias("requires_verification"))


def cross_notes(t: DataFrame) -> DataFrame:
    """case_id, order_number and note of events that other documents tell of too: differing diagnoses and doctors in order of the others, or first that sources agree. Needs source_type and doctor."""
    key = ["case_id", "event_date", "event_type"]
    facts = ["order_number", "document_id", "title", "description", "diagnosis", "doctor", "source_type"]
    one, two = (t.select(*key, *(F.col(c).alias(f"{c}{x}") for c in facts)) for x in ("_a", "_b"))
    both = one.join(two, key).where((F.col("document_id_a") != F.col("document_id_b")) & (F.col("order_number_a") != F.col("order_number_b")))
    both = both.where(same_event(F.col("title_a"), F.col("title_b"), F.col("description_a"), F.col("description_b")))
    (ra, _), (rb, _) = reliability(F.col("source_type_a")), reliability(F.col("source_type_b"))
    differs = lambda c: F.coalesce((F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "") & (F.col(f"{c}_a") != F.col(f"{c}_b")), F.lit(False))
    preferred = F.concat(F.lit("diagnosi discordante: "), F.when(ra >= rb, F.col("source_type_a")).otherwise(F.col("source_type_b")), F.lit(" ("), F.greatest(ra, rb).cast("string"), F.lit(")"))
    notes = F.array_compact(F.array(F.when(differs("diagnosis"), preferred), F.when(differs("doctor"), F.concat(F.lit("medico diverso: "), "doctor_b"))))
    rows = both.select("case_id", F.col("order_number_a").alias("order_number"), F.struct(F.col("order_number_b").alias("b"), notes.alias("notes")).alias("x"))
    listed = rows.groupBy("case_id", "order_number").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["notes"]).alias("_n"))
    agree = F.when(F.size(F.get("_n", F.lit(0))) == 0, F.array(F.lit("fonti concordi"))).otherwise(F.array().cast("array<string>"))
    return listed.select("case_id", "order_number", F.array_join(F.concat(agree, F.flatten("_n")), "; ").alias("note"))


def consolidated(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The events of a case after new ones came: those like an existing one go, the others are numbered after the last number; `place` is the order by date, type and title in the whole case.

    New events are put in order by date (none first), type, title and event_id, and marked where documents among them disagree (`note`, if they
    have source_type and doctor), before any goes: a mark stays though the event it speaks of was known already.
    """
    by_title = Window.partitionBy("case_id").orderBy("event_date", "event_type", "title", "event_id")
    fresh = new.withColumn("order_number", F.row_number().over(by_title))
    if {"source_type", "doctor"} <= set(new.columns):
        fresh = fresh.join(cross_notes(fresh), ["case_id", "order_number"], "left")
    most = existing.groupBy("case_id").agg(F.max("order_number").alias("_most"))
    left = not_yet_known(fresh, existing).join(most, "case_id", "left")
    added = left.withColumn("order_number", F.coalesce("_most", F.lit(0)) + F.row_number().over(in_order())).drop("_most")
    both = existing.withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)), allowMissingColumns=True)
    by = Window.partitionBy("case_id").orderBy("event_date", "event_type", "title", "order_number")
    return both.withColumn("place", F.row_number().over(by))
