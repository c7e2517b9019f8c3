"""Readers and sinks of case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.functions.dates import shown_date
from caseweave.functions.text import escaped

#: Columns of the CSV file in order (fixed values).
CSV_COLUMNS = ["Ordine", "Data", "Precisione Data", "Tipo", "Titolo", "Descrizione", "Fonte", "Diagnosi", "Medico", "Struttura", "Confidenza", "Richiede Verifica"]


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their content, of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def ocr_pages(answers: DataFrame) -> DataFrame:
    """document_id, page_number, ocr_text and mean confidence (rounded) from answers (document_id, pages: array of markdown, tables, confidence); tables stand between markers."""
    rows = answers.select("document_id", F.posexplode("pages").alias("_k", "p"))
    tables = F.transform(F.coalesce("p.tables", F.array().cast("array<string>")), lambda t: F.concat(F.lit("\n[TABLE_HTML_START]\n"), t, F.lit("\n[TABLE_HTML_END]")))
    return rows.select("document_id", (F.col("_k") + 1).alias("page_number"), F.concat(F.coalesce("p.markdown", F.lit("")), F.array_join(tables, "")).alias("ocr_text"), F.floor(F.col("p.confidence") + 0.5).cast("long").alias("confidence"))


def csv_line(*columns: Column) -> Column:
    """One line of the CSV file: parted by ;, quoted where a value holds ;, quotes or line feeds; null is empty."""
    quoted = [F.when(c.rlike('[;"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns]
    return F.concat_ws(";", *(F.coalesce(q, F.lit("")) for q in quoted))


def csv_lines(events: DataFrame) -> DataFrame:
    """case_id, order_number and line of each event."""
    day = shown_date(F.date_format("event_date", "yyyy-MM-dd"))
    values = ["order_number", day, "date_precision", "event_type", "title", "description", "source_type", "diagnosis", "doctor", "facility", "confidence", F.when(F.col("requires_verification"), "Si").otherwise("No")]
    columns = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return events.select("case_id", "order_number", csv_line(*columns).alias("line"))


def write_csv(events: DataFrame, path: str) -> None:
    """A text file for each case below path, with a byte order mark and the header, its lines in order."""
    lines = csv_lines(events).select("case_id", F.col("order_number").alias("n"), "line")
    heads = lines.select("case_id").distinct().select("case_id", F.lit(0).alias("n"), F.lit("﻿" + ";".join(CSV_COLUMNS)).alias("line"))
    ordered = heads.unionByName(lines).repartition("case_id").sortWithinPartitions("case_id", "n")
    ordered.select("case_id", "line").write.partitionBy("case_id").text(path)


def filing_xml(cases: DataFrame) -> DataFrame:
    """case_id and the XML of its court filing; texts are escaped, null fields are left out."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), escaped(F.col(c).cast("string")), F.lit(f"</{c}>"))) for c in cases.columns if c != "case_id"]
    return cases.select("case_id", F.concat(F.lit("<deposito>"), F.concat_ws("", *fields), F.lit("</deposito>")).alias("xml"))


def subject_access(profiles: DataFrame, parts: dict[str, DataFrame], most_audit: int = 500) -> DataFrame:
    """user_id and the JSON of all that is stored of a user: the profile and, for each part (with user_id, at), its rows, the last `most_audit` of the part "audit"."""
    out = profiles.select("user_id", F.to_json(F.struct(*[c for c in profiles.columns if c != "user_id"])).alias("profile"))
    for name, rows in parts.items():
        said = rows.select("user_id", "at", F.to_json(F.struct(*[c for c in rows.columns if c not in ("user_id", "at")])).alias("row"))
        if name == "audit":  # cut before the rows of a user are gathered
            last = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("row"))
            said = said.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= most_audit)
        texts = F.transform(F.sort_array(F.collect_list(F.struct("at", "row")), asc=False), lambda x: x["row"])
        grouped = said.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias(name))
        out = out.join(grouped, "user_id", "left").withColumn(name, F.coalesce(name, F.lit("[]")))
    pairs = [x for n in ["profile", *parts] for x in (F.lit(f'"{n}":'), F.col(n), F.lit(","))][:-1]
    return out.select("user_id", F.concat(F.lit("{"), *pairs, F.lit("}")).alias("json"))


def demo_cases(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """The demonstration case, if no code of `existing` (code) begins with DEMO-."""
    demo = spark.createDataFrame([("DEMO-001", "M.R.", "ortopedica", "bozza")], "code string, patient_initials string, case_type string, status string")
    taken = existing.where(F.col("code").startswith("DEMO-")).select(F.lit(True).alias("_t")).limit(1)
    return demo.join(taken, F.lit(True), "left_anti")
