"""Joins between events, documents, pages, images and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions.text import same_event


def with_name(rows: DataFrame, names: DataFrame, key: str, name: str, absent: str = "N/A") -> DataFrame:
    """Left join of a name; `absent` where there is none."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(absent)))


def with_count(rows: DataFrame, many: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows of `many` each row has, 0 for none; the counts are made before the join."""
    counts = many.groupBy(key).agg(F.count("*").alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def coverage(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each document (document_id, status) by its events: completato with and without, in errore, in attesa."""
    counted = with_count(documents, events, "document_id", "events")
    state = F.when(F.col("status") == "errore", "errore").when(F.col("status") != "completato", "in_attesa").when(F.col("events") > 0, "coperto").otherwise("senza_eventi")
    return counted.withColumn("coverage", state)


def image_links(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each event, source page and image of that page. events: event_id, document_id, source_pages; pages: document_id, page_number, image_path (parted by ;)."""
    wanted = events.select("event_id", "document_id", F.explode("source_pages").alias("page_number"))
    images = pages.select("document_id", "page_number", F.explode(F.filter(F.split("image_path", ";"), lambda p: p != "")).alias("image_path"))
    return wanted.join(images, ["document_id", "page_number"]).select("event_id", "page_number", "image_path")


def images_or_documents(events: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """event_id and how many images it shows: its own links, or where it has none all images of its document."""
    own = links.groupBy("event_id").agg(F.count("*").alias("_own"))
    images = pages.groupBy("document_id").agg(F.sum(F.size(F.filter(F.split("image_path", ";"), lambda p: p != ""))).alias("_all"))
    joined = events.join(own, "event_id", "left").join(images, "document_id", "left")
    return joined.select("event_id", F.coalesce("_own", "_all", F.lit(0)).cast("long").alias("images"), F.col("_own").isNotNull().alias("direct"))


def section_links(sections: DataFrame, events: DataFrame) -> DataFrame:
    """case_id, section, order_number, kind and confidence of the best link: a reference [Ev.n], the event's date, or its title of four words or more.

    sections: case_id, section, content; events: case_id, order_number, event_date, title.
    """
    refs = sections.select("case_id", "section", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[Ev\.(\d+)\]"), F.lit(1)))).alias("_n"))
    explicit = refs.withColumn("order_number", F.expr("try_cast(_n AS int)")).join(events, ["case_id", "order_number"]).select("case_id", "section", "order_number", F.lit(1).alias("rank"))
    dates = sections.select("case_id", "section", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\d{2}[./]\d{2}[./]\d{4})"), F.lit(1)))).alias("_d"))
    dated = dates.withColumn("event_date", F.coalesce(F.try_to_date(F.translate("_d", ".", "/"), "dd/MM/yyyy"))).join(events, ["case_id", "event_date"]).select("case_id", "section", "order_number", F.lit(2).alias("rank"))
    long = events.where(F.size(F.split("title", r"\s+")) >= 4)
    titled = sections.join(long, "case_id").where(F.lower("content").contains(F.lower("title"))).select("case_id", "section", "order_number", F.lit(3).alias("rank"))
    best = explicit.unionByName(dated).unionByName(titled).groupBy("case_id", "section", "order_number").agg(F.min("rank").alias("rank"))
    return best.select("case_id", "section", "order_number", F.element_at(F.array(F.lit("explicit"), F.lit("date"), F.lit("title")), F.col("rank")).alias("kind"), F.element_at(F.array(F.lit(1.0), F.lit(0.8), F.lit(0.6)), F.col("rank")).alias("confidence"))


def same_event_pairs(t: DataFrame) -> DataFrame:
    """Pairs of events of a case with one date and type in different documents, the earlier in order first; like: whether their texts tell of the same."""
    key = ["case_id", "event_date", "event_type"]
    one = t.select(*key, *(F.col(c).alias(f"{c}_a") for c in ("order_number", "document_id", "title", "description")))
    two = t.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("order_number", "document_id", "title", "description")))
    both = one.join(two, key).where((F.col("order_number_a") < F.col("order_number_b")) & (F.col("document_id_a") != F.col("document_id_b")))
    like = same_event(F.col("title_a"), F.col("title_b"), F.col("description_a"), F.col("description_b"))
    return both.select(*key, "order_number_a", "order_number_b", like.alias("like"))


def not_yet_known(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New events that are like no existing event of the same case, date and type."""
    key = ["case_id", "event_date", "event_type"]
    old = existing.select(*(F.col(c).alias(f"_{c}") for c in [*key, "title", "description"]))
    equal = (F.col("case_id") == F.col("_case_id")) & (F.col("event_date") == F.col("_event_date")) & (F.col("event_type") == F.col("_event_type"))
    like = same_event(F.col("title"), F.col("_title"), F.col("description"), F.col("_description"))
    return new.join(old, equal & like, "left_anti")


def discrepancies(t: DataFrame) -> DataFrame:
    """case_id, order_number and note of events whose diagnosis differs from that of like events in other documents: the partner with the more reliable source is named, ties to the event's own. Needs source_type."""
    from caseweave.functions.text import reliability

    pairs = same_event_pairs(t).where("like")
    facts = t.select("case_id", "order_number", "diagnosis", "source_type")
    one = facts.select("case_id", F.col("order_number").alias("order_number_a"), F.col("diagnosis").alias("da"), F.col("source_type").alias("sa"))
    two = facts.select("case_id", F.col("order_number").alias("order_number_b"), F.col("diagnosis").alias("db"), F.col("source_type").alias("sb"))
    joined = pairs.join(one, ["case_id", "order_number_a"]).join(two, ["case_id", "order_number_b"]).where(F.col("da").isNotNull() & F.col("db").isNotNull() & (F.col("da") != F.col("db")))
    (ra, _), (rb, _) = reliability(F.col("sa")), reliability(F.col("sb"))
    note = F.concat(F.lit("diagnosi discordante: "), F.when(ra >= rb, F.col("sa")).otherwise(F.col("sb")), F.lit(" ("), F.greatest(ra, rb).cast("string"), F.lit(")"))
    notes = joined.select("case_id", "order_number_a", "order_number_b", note.alias("note"))
    listed = F.array_sort(F.collect_list(F.struct("order_number_b", "note")))
    return notes.groupBy("case_id", F.col("order_number_a").alias("order_number")).agg(F.concat_ws("; ", F.transform(listed, lambda x: x["note"])).alias("note"))


def by_preference(wanted: DataFrame, offers: DataFrame, first: list[str], second: list[str], value: str) -> DataFrame:
    """The offer under the first key, else under the second, else null."""
    a = offers.select(*first, F.col(value).alias("_first")).dropDuplicates(first)
    b = offers.groupBy(*second).agg(F.min(value).alias("_second"))
    return wanted.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")


def exact_duplicates(t: DataFrame) -> DataFrame:
    """case_id, order_number and how many earlier events have the same date, title and description."""
    by = Window.partitionBy("case_id", "event_date", "title", "description").orderBy("order_number")
    return t.withColumn("earlier", (F.row_number().over(by) - 1).cast("long")).where(F.col("earlier") > 0).select("case_id", "order_number", "earlier")
