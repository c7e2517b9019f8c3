"""Personal data in texts: detection in passes, consistent pseudonyms, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.arrays import let, sums_before
from caseweave.operators.intervals import greedy
from caseweave.sources.shared import fresh_folder

#: Passes in order (category, pattern, group of the find). Words end at ASCII letters.
PASSES = [
    ("nome", r"(?:Dott\.?(?:ssa|\.ssa)?|Prof\.?(?:ssa|\.ssa)?|Sig\.?(?:ra|\.ra)?|Avv\.?|Ing\.?)\s+[A-Z][a-zàèéìòù]+(?:\s+[A-Z][a-zàèéìòù]+){0,2}", 0),
    ("nome", r"(?:sig\.?\s|signor[ae]?\s|paziente\s|parte\s|figlio di\s|figlia di\s|nat[oa]\s)([A-Z][a-zà-ú]+\s+[A-Z][a-zà-ú]+(?:\s+[A-Z][a-zà-ú]+)?)", 1),
    ("nome", r"(?:figlio|figlia|nat[oa])\s+(?:di|da)\s+([A-Z][a-zà-ú]+(?:\s+[A-Z][a-zà-ú]+)?)", 1),
    ("codice_fiscale", r"(?i)(?<![A-Za-z0-9_])[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?![A-Za-z0-9_])", 0),
    ("data", r"(?<![A-Za-z0-9_])(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)\d{2}(?![A-Za-z0-9_])", 0),
    ("data", r"(?i)(?<![A-Za-z0-9_])(?:0?[1-9]|[12]\d|3[01])\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+(?:19|20)\d{2}(?![A-Za-z0-9_])", 0),
    ("indirizzo", r"(?:Via|Piazza|Corso|Viale|Largo|Vicolo|Piazzale|Piazzetta|Strada|Lungotevere|Lungomare)\s+[A-ZÀ-Ü][a-zà-ü]+(?:\s+[A-ZÀ-Ü][a-zà-ü]+)*(?:\s*[,]?\s*(?:n\.?\s*)?\d{1,5}(?:\s*[/][A-Za-z])?)?", 0),
    ("struttura", r"(?:Ospedale|ASST|ASL|ATS|Policlinico|Clinica|Istituto|Casa di Cura)\s+[A-Z][^.,;:\n]{2,40}", 0),
    ("riferimento_giudiziario", r"R\.?G\.?\s*n?\.?\s*\d{1,6}/\d{2,4}", 0),
    ("telefono", r"(?:\+39\s?)?(?:0\d{1,4}[\s.-]?\d{4,8}|3\d{2}[\s.-]?\d{3}[\s.-]?\d{4})", 0),
    ("email", r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])", 0),
]
LABELS = {"nome": "PERSONA", "codice_fiscale": "CF", "data": "DATA", "indirizzo": "INDIRIZZO", "struttura": "STRUTTURA", "riferimento_giudiziario": "RIF_GIUD", "telefono": "TELEFONO", "email": "EMAIL"}


def _finds(text: Column, number: int, category: str, pattern: str, group: int) -> Column:
    """Array of (pass, start, end, found, category): starts are sums of what stands before, by splitting at the finds."""
    none = F.array().cast("array<struct<pass:int,start:int,end:int,found:string,category:string>>")

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        sizes = let(between, lambda b: F.transform(found, lambda x, i: F.struct(F.length(F.get(b, i)).alias("gap"), (F.length(F.get(b, i)) + F.length(x)).alias("both"))))

        def spans(z: Column) -> Column:
            def find(before: Column) -> Column:
                def one(whole: Column, i: Column) -> Column:
                    part = whole if group == 0 else F.regexp_extract(whole, pattern, group)
                    start = F.get(before, i) + F.get(z, i)["gap"] + (0 if group == 0 else F.instr(whole, part) - 1)
                    return F.struct(F.lit(number).alias("pass"), start.alias("start"), (start + F.length(part)).alias("end"), part.alias("found"), F.lit(category).alias("category"))

                return F.transform(found, one)

            return let(sums_before(F.transform(z, lambda x: x["both"])), find)

        return F.when(F.size(found) > 0, let(sizes, spans)).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return found if group == 0 else F.filter(found, lambda x: F.length(x["found"]) >= 3)


def detected(docs: DataFrame, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """docs with `finds` (all passes, names of parties first, the longest first) and `kept` (without overlaps)."""
    from re import escape

    passes = [("nome", "(?i)" + escape(n), 0) for n in sorted((n for n in names or [] if len(n) > 2), key=len, reverse=True)] + PASSES
    column = F.coalesce(F.col(text), F.lit(""))
    finds = F.concat(*(_finds(column, k, *p) for k, p in enumerate(passes)))
    return docs.withColumn("finds", finds).withColumn("kept", greedy(F.col("finds")))


def counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many finds of each category are kept in a document, 0 included."""

    def number(category: str) -> Column:
        return F.size(F.filter("kept", lambda x: x["category"] == category)).cast("long").alias(category)

    return found.select(key, *map(number, LABELS))


def pseudonyms(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lower-cased find and placeholder: numbered in each category of a document by first sight, in the order of passes, finds dropped for overlaps included."""
    finds = found.select(key, F.explode("finds").alias("x")).select(key, F.lower("x.found").alias("find"), "x.pass", "x.start", "x.category")
    first = finds.groupBy(key, "find").agg(F.min_by(F.struct("pass", "start", "category"), F.struct("pass", "start")).alias("f")).select(key, "find", "f.*")
    number = F.row_number().over(Window.partitionBy(key, "category").orderBy("pass", "start"))
    label = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[F.col("category")]
    return first.select(key, "find", F.concat(F.lit("["), label, F.lit("_"), number.cast("string"), F.lit("]")).alias("placeholder"))


def masked(found: DataFrame, key: str = "doc_id", text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """key, masked text and how many finds were replaced. One row a key. Finds are needed twice, so they are written to the shared folder first."""
    folder = fresh_folder(found.sparkSession, "finds")
    found.select(key, text, "finds", "kept").write.parquet(folder)
    found = found.sparkSession.read.schema(found.select(key, text, "finds", "kept").schema).parquet(folder)
    names = pseudonyms(found, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("find", "placeholder"))).alias("_names"))
    chosen = F.filter("kept", lambda x: x["category"].isin(categories or list(LABELS)))
    joined = found.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), chosen.alias("_kept")).join(names, key, "left")
    last = lambda i: F.when(i > 0, F.get("_kept", i - 1)["end"]).otherwise(0)
    pieces = F.transform("_kept", lambda x, i: F.concat(F.substring("_t", last(i) + 1, x["start"] - last(i)), F.col("_names")[F.lower(x["found"])]))
    rest = F.coalesce(F.get("_kept", F.size("_kept") - 1)["end"], F.lit(0))
    step = F.concat(F.array_join(pieces, ""), F.substring("_t", rest + 1, F.length("_t")))
    return joined.select(key, step.alias("masked"), F.size("_kept").cast("long").alias("replaced"))
