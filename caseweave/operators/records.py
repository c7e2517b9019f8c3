"""Model answers and record states: resilient JSON, normalised events, grounding, prompt lines, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.dates import half_up, shown_date
from caseweave.functions.json_repair import repaired_json
from caseweave.functions.text import SPACE, reliability

#: Patterns of placeholder values, critical event types, image keywords, error messages in order.
PLACEHOLDERS = "(?i)PLACEHOLDER|NON_COPIARE|ESEMPIO_FITTIZIO|NOME_ESEMPIO"
CRITICAL_TYPES = ["intervento", "diagnosi", "complicanza", "ricovero", "dimissione", "decesso", "consenso", "trasfusione"]
IMAGE_KEYWORDS = {"radiografia": ["rx", "radiografia", "radiograph", "x-ray"], "tac": ["tac", "tc", "ct", "tomografia"], "risonanza": ["rm", "rmn", "risonanza", "mri"], "ecografia": ["ecografia", "ecografica", "ultrasound"], "endoscopia": ["endoscopia", "endoscopica"]}
ERRORS = [
    ("ocr_failed", "All documents failed OCR"), ("ocr_timeout", "OCR.*(?:timeout|timed out)"), ("rate", "rate.?limit|429|Too many requests|Troppe richieste"), ("network", "network|ECONNREFUSED|ENOTFOUND|fetch failed"),
    ("session", "auth|autenticato|401|unauthorized"), ("permission", "permission|forbidden|403"), ("missing", "not found|404|non trovato"), ("size", "file.*(?:too large|size|grande)"), ("format", "invalid.*(?:format|tipo|type)"),
    ("extraction", "extraction.*fail|estrazione.*fallita"), ("synthesis", "synthesis.*fail|sintesi.*fallita"), ("unavailable", "circuit.?breaker|service unavailable|503"), ("internal", "500|internal.*error|errore interno"),
]

EVENT = "struct<eventDate:string,event_date:string,datePrecision:string,date_precision:string,eventType:string,event_type:string,title:string,description:string,sourceType:string,source_type:string,diagnosis:string,doctor:string,facility:string,confidence:double,requiresVerification:boolean,requires_verification:boolean,sourceText:string,source_text:string,sourcePages:array<int>,source_pages:array<int>>"
KEYS = ["events", "Events", "eventi", "EVENTS"]


def answer_events(raw: Column) -> Column:
    """The array of events in a model's answer: parsed whole; else repaired; else up to the last whole object of its events; empty if nothing helps."""
    start = F.regexp_instr(raw, F.lit(r'"events"\s*:\s*\['))
    tail = F.substring(raw, start, F.length(raw))
    upto = F.length(tail) - F.instr(F.reverse(tail), "}") + 1
    attempts = [repaired_json(raw), F.when(start > 0, F.concat(F.lit("{"), F.substring(tail, F.lit(1), upto), F.lit("]}")))]
    fine = F.coalesce(*(F.when(F.try_parse_json(a).isNotNull(), a) for a in attempts))
    return F.coalesce(*(F.from_json(F.get_json_object(fine, f"$.{k}"), f"array<{EVENT}>") for k in KEYS), F.array().cast(f"array<{EVENT}>"))


def normalised(e: Column) -> Column:
    """One event of an answer with its defaults: a missing date becomes the placeholder and asks for verification, placeholder texts become null, confidence is held between 0 and 100 (70 if none)."""
    date = F.coalesce(e["eventDate"], e["event_date"], F.lit(""))
    missing = date.isin("", "1900-01-01", "null", "undefined")

    def real(c: Column) -> Column:
        return F.when(~c.rlike(PLACEHOLDERS), c)

    return F.struct(
        F.when(missing, "1900-01-01").otherwise(date).alias("event_date"),
        F.when(missing, "sconosciuta").otherwise(F.coalesce(e["datePrecision"], e["date_precision"], F.lit("sconosciuta"))).alias("date_precision"),
        F.coalesce(e["eventType"], e["event_type"], F.lit("altro")).alias("event_type"),
        F.coalesce(e["title"], F.lit("Evento clinico")).alias("title"),
        F.coalesce(e["description"], F.lit("")).alias("description"),
        F.coalesce(e["sourceType"], e["source_type"], F.lit("altro")).alias("source_type"),
        real(e["diagnosis"]).alias("diagnosis"),
        real(e["doctor"]).alias("doctor"),
        real(e["facility"]).alias("facility"),
        F.when(e["confidence"].isNull(), 70.0).otherwise(F.least(F.greatest(e["confidence"], F.lit(0.0)), F.lit(100.0))).alias("confidence"),
        (missing | F.coalesce(e["requiresVerification"], e["requires_verification"], F.lit(False))).alias("requires_verification"),
        F.coalesce(e["sourceText"], e["source_text"], F.lit("")).alias("source_text"),
        F.coalesce(e["sourcePages"], e["source_pages"], F.array(F.lit(1))).alias("source_pages"),
    )


def extracted(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """key, number (from 0) and the fields of each event of the answers; events with neither title nor description are left out."""
    events = F.filter(answer_events(F.col(raw)), lambda e: e["title"].isNotNull() | e["description"].isNotNull())
    return answers.select(key, F.posexplode(events).alias("number", "_e")).select(key, "number", normalised(F.col("_e")).alias("_n")).select(key, "number", "_n.*")


def grounding(events: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, quote_id and flag: short (under 10 characters), absent (the first 60 characters aren't in the text), critical ones marked, or fine."""
    joined = events.join(texts.select(key, F.regexp_replace(F.lower("text"), SPACE + "+", " ").alias("_t")), key)
    quote = F.coalesce("quote", F.lit(""))
    start = F.trim(F.regexp_replace(F.lower(F.substring(quote, 1, 60)), SPACE + "+", " "))
    flag = F.when(F.length(quote) < 10, "short").when((F.length(start) >= 10) & ~F.col("_t").contains(start), "absent").otherwise("fine")
    marked = F.when((flag != "fine") & F.col("event_type").isin(CRITICAL_TYPES), F.concat(F.lit("critical_"), flag)).otherwise(flag)
    return joined.select(key, "quote_id", marked.alias("flag"))


def handwriting(text: Column) -> tuple[Column, Column]:
    """Whether a page is handwritten (yes, partial or null) and how surely, by its marks of about 200 characters each."""
    marks = F.regexp_count(text, F.lit(r"(?i)\[MANOSCRITTO\]"))
    ratio = F.least(marks * 200 / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))
    return F.when(marks > 0, F.when(ratio > 0.5, "yes").otherwise("partial")), F.when(marks > 0, F.when(ratio > 0.5, 60).otherwise(70))


def image_type(raw: Column) -> Column:
    """A known kind of image by the first keyword its name holds; other and altro are altro, the rest stays."""
    low = F.lower(raw)
    found = F.when(low.isin("altro", "other"), "altro").otherwise(raw)
    for kind, words in reversed(IMAGE_KEYWORDS.items()):
        for word in words:
            found = F.when(low.contains(word), kind).otherwise(found)
    return found


def error_kind(message: Column) -> Column:
    """The kind of an error by the first pattern that its message holds."""
    found = F.lit("other")
    for kind, pattern in reversed(ERRORS):
        found = F.when(message.rlike("(?i)" + pattern), kind).otherwise(found)
    return found


def wizard_step(stage: Column, has_report: Column, has_events: Column, has_work: Column) -> Column:
    """The step that a case is shown at, by its stage, or by what it has where it failed or never began."""
    rest = F.when(has_report, 5).when(has_events, 4)
    return F.when(stage.isin("completato", "generazione_report"), 5).when(stage == "revisione_anomalie", 4).when(stage.isin("revisione_classificazione", "elaborazione"), 3).when(stage == "errore", F.coalesce(rest, F.lit(3))).otherwise(F.coalesce(rest, F.when(has_work, 3), F.lit(1)))


def servable(paths: DataFrame, documents: DataFrame) -> DataFrame:
    """Image paths (case_id, image_path) below ocr-images/, without "..", whose document belongs to the case (documents: case_id, document_id)."""
    fine = paths.where(F.col("image_path").startswith("ocr-images/") & ~F.col("image_path").contains(".."))
    own = documents.select("case_id", F.col("document_id").cast("string").alias("_doc"))
    return fine.withColumn("_doc", F.split_part("image_path", F.lit("/"), F.lit(2))).join(own, ["case_id", "_doc"], "left_semi").drop("_doc")


def event_lines(t: DataFrame, most: int = 30, width: int = 300, short: int = 200) -> DataFrame:
    """case_id and the lines of its first events for a prompt: place, date, type, source's reliability, title and text, shortened further in cases of over `most` events."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    rows = t.withColumn("_n", n).where(F.col("order_number") <= most)
    score, label = reliability(F.col("source_type"))
    body = F.substring("description", 1, width)
    line = F.concat(F.lit("#"), F.col("order_number").cast("string"), F.lit(" "), shown_date(F.date_format("event_date", "yyyy-MM-dd")), F.lit(" ["), F.upper("event_type"), F.lit("] ("), label, F.lit(" "), score.cast("string"), F.lit(") "), "title", F.lit(": "), F.when(F.col("_n") > most, F.substring("description", 1, short)).otherwise(body), F.when(F.col("diagnosis").isNotNull(), F.concat(F.lit(" | "), "diagnosis")).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("order_number", line.alias("line"))))
    return rows.groupBy("case_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"), F.max("_n").alias("events"))


def split_needed(t: DataFrame, most: int = 40_000) -> DataFrame:
    """case_id, characters of its events and whether a report must be written in parts."""
    return t.groupBy("case_id").agg(F.sum(F.length(F.concat_ws(" ", "title", "description"))).alias("characters")).withColumn("split", F.col("characters") > most)


def anomaly_references(found: DataFrame, t: DataFrame, documents: DataFrame) -> DataFrame:
    """case_id, order_number and the words that refer to an event of a finding: its title, and its document and pages where known."""
    involved = found.select("case_id", F.explode(F.array_compact(F.array("order_a", "order_b"))).alias("order_number")).distinct()
    rows = involved.join(t.select("case_id", "order_number", "title", "document_id", "source_pages"), ["case_id", "order_number"], "left").join(documents.select("document_id", "file_name"), "document_id", "left")
    pages = F.when(F.size("source_pages") > 0, F.concat(F.lit(", pag. "), F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ", "))).otherwise("")
    place = F.when(F.col("file_name").isNotNull(), F.concat(F.lit(" — Doc: "), "file_name", pages)).otherwise("")
    return rows.select("case_id", "order_number", F.concat(F.lit("Evento #"), F.col("order_number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), place).alias("reference"))


def ocr_context(wanted: DataFrame, pages: DataFrame, most: int = 5000) -> DataFrame:
    """key and the text of its pages (wanted: key, document_id, page_number) in order, each under a header, until `most` characters are reached; a header may stand over the rest."""
    rows = wanted.distinct().join(pages, ["document_id", "page_number"])
    listed = F.array_sort(F.collect_list(F.struct("document_id", "page_number", "ocr_text")))

    def add(all: Column, p: Column) -> Column:
        head = F.concat(F.lit("\n--- Pagina "), p["document_id"].cast("string"), F.lit(":"), p["page_number"].cast("string"), F.lit(" ---\n"))
        return F.when(F.length(all) >= most, all).otherwise(F.concat(all, head, F.substring(p["ocr_text"], F.lit(1), most - F.length(all))))

    return rows.groupBy("key").agg(F.trim(F.aggregate(listed, F.lit(""), add)).alias("context"))


def resolved(answers: DataFrame) -> DataFrame:
    """Whether a model's verdict on a finding (resolved, confidence, evidence) is accepted: resolved and surely enough; texts are cut at 500 characters."""
    sure = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    return answers.select("id", (F.col("resolved") & (sure >= 0.8)).alias("accepted"), sure.alias("confidence"), F.substring("evidence", 1, 500).alias("evidence"))


def filled(parts: list[Column]) -> Column:
    """The rounded percentage of the parts that are there."""
    return half_up(100.0 * sum(p.cast("int") for p in parts) / len(parts)).cast("long")


def references(text: Column) -> Column:
    """The numbers that a report refers to, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[Ev\.(\d+)\]"), F.lit(1)), lambda x: x.cast("long")))
