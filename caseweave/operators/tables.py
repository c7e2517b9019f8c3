"""Filters, aggregates, top rows and upkeep of case tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, cases: DataFrame, viewers: DataFrame) -> DataFrame:
    """Rows of cases that belong to one of the viewers (user_id), by two semi joins."""
    own = cases.join(viewers.select("user_id"), "user_id", "left_semi").select("case_id")
    return rows.join(own, "case_id", "left_semi")


def allowed(status: Column, plan: Column, feature: Column) -> Column:
    """Whether a feature is open: nothing for lapsed subscriptions, all for paying ones, processing for the rest."""
    lapsed = F.coalesce(status, F.lit("trial")).isin("canceled", "past_due")
    paying = F.coalesce(plan, F.lit("trial")).isin("pro", "enterprise") & status.isin("active", "trialing")
    return ~lapsed & (F.coalesce(paying, F.lit(False)) | (feature == "processing"))


def may_change(old: Column, new: Column) -> Column:
    """Files may be archived at any time, and reopened as drafts only from the archive."""
    return (new == "archiviato") | ((old == "archiviato") & (new == "bozza"))


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()))


def per_day(rows: DataFrame, at: str, since: str) -> DataFrame:
    return rows.where(F.col(at) >= F.lit(since).cast("timestamp")).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def success_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """100 x done / (done + failed), 0 if there is neither."""
    done, failed = F.count_if(F.col("status") == "completato"), F.count_if(F.col("status") == "errore")
    return rows.groupBy(*keys).agg(done.alias("done"), failed.alias("failed")).withColumn("rate", F.when(F.col("done") + F.col("failed") > 0, F.round(100.0 * F.col("done") / (F.col("done") + F.col("failed")), 6)).otherwise(0.0))


def mean_minutes(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Mean of durations over 0 and under 60 minutes; null if a group has none."""
    minutes = (F.unix_micros(end) - F.unix_micros(start)) / 60e6
    return rows.groupBy(key).agg(F.round(F.avg(F.when((minutes > 0) & (minutes < 60), minutes)), 6).alias("minutes"))


def top_messages(rows: DataFrame, text: str, most: int = 5, prefix: int = 100) -> DataFrame:
    """The most frequent beginnings of a text, ties by the text."""
    return rows.groupBy(F.substring(text, 1, prefix).alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(most)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of rows with the exact total and the number of pages."""
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return chosen.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_k", F.row_number().over(by)).where(F.col("_k") == 1).drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old and new, the new one where both have a key; within new the one of the greatest `at`, then value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [F.col(c) for c in old.columns if c not in keys]
    return latest(both, keys, [F.col("_new"), *others]).drop("_new")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of their patch (one row a key)."""
    names = [c for c in patch.columns if c != key]
    joined = rows.join(patch.select(key, *(F.col(c).alias(f"_{c}") for c in names)), key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*(f"_{c}" for c in names)).select(rows.columns)


def expired(cases: DataFrame, profiles: DataFrame, as_of: str) -> DataFrame:
    """Archived cases whose owner's retention (null: for ever) has run out by `as_of`."""
    joined = cases.where(F.col("status") == "archiviato").join(profiles.select("user_id", "retention_days").where(F.col("retention_days").isNotNull()), "user_id")
    return joined.where(F.col("updated_on") < F.date_sub(F.lit(as_of).cast("date"), F.col("retention_days"))).select("case_id", "user_id", "updated_on")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


#: Rows of a task to which keys deal narrow rows.
TASK_ROWS = 1 << 20


def many_without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`without` for many narrow rows, which are dealt by key to as many tasks as their number asks for: Spark goes by bytes, and they pack so well that a task would sort many millions.

    A left join, as an anti join is pushed below what deals the rows out.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-rows.count() // TASK_ROWS))
    keys = gone.select(key).repartition(tasks, key).distinct()  # else the rows are dealt anew to as many tasks as distinct() takes
    return rows.repartition(tasks, key).join(keys.withColumn("_gone", F.lit(True)), key, "left").where(F.col("_gone").isNull()).drop("_gone")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """How many rows refer to no parent (null references are fine), and how many there are."""
    known = parents.select(F.col(parent_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    joined = rows.select(key).join(known, key, "left")
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNotNull() & F.col("_known").isNull()).alias("orphans"))


def next_codes(new: DataFrame, codes: DataFrame, prefix: Column) -> DataFrame:
    """Codes for new rows (id, year): prefix, year and the next numbers of the year, of three digits at least. codes: year, number."""
    most = codes.groupBy("year").agg(F.max("number").alias("_most"))
    number = F.coalesce("_most", F.lit(0)) + F.row_number().over(Window.partitionBy("year").orderBy("id"))
    joined = new.join(most, "year", "left").withColumn("number", number)
    digits = F.greatest(F.length(F.col("number").cast("string")), F.lit(3))
    return joined.select("id", F.concat(prefix, F.lit("-"), F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("number").cast("string"), digits, F.lit("0"))).alias("code"))


def repeated_edges(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """document_id and edge text (lower case) of headers that stand on half of a document's pages or more, if it has three pages and the text is over 5 characters."""
    total = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    seen = pages.where(F.length("header") > 5).groupBy("document_id", F.lower("header").alias("header")).agg(F.count("*").alias("n"))
    joined = seen.join(total, "document_id").where((F.col("pages") >= least_pages) & (F.col("n") >= F.col("pages") * 0.5))
    return joined.select("document_id", "header", "n", "pages")


def search(parts: dict[str, tuple[DataFrame, str, list[str]]], query: str, each: int = 10, most: int = 20) -> DataFrame:
    """kind, id, excerpt and total: rows whose texts hold the query (any case), `each` of a kind at most, in the order of kinds.

    parts: kind -> (table, id column, text columns). Every kind is ranked by a top-k of its own.
    """
    from caseweave.functions.text import excerpt, search_term

    term = search_term(query) or ""
    found = []
    for place, (kind, (table, key, texts)) in enumerate(parts.items()):
        hit = reduce(lambda a, b: a | b, (F.lower(c).contains(term.lower()) for c in texts)) if term else F.lit(False)
        text = F.coalesce(*(F.when(F.lower(c).contains(term.lower()), F.col(c)) for c in texts)) if term else F.lit("")
        rows = table.where(F.coalesce(hit, F.lit(False))).orderBy(key).limit(each)
        found.append(rows.select(F.lit(place).alias("_place"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), excerpt(F.regexp_replace(text, "<[^>]+>", ""), term).alias("excerpt")))
    both = reduce(DataFrame.unionByName, found)
    ranked = both.orderBy("_place", "id").limit(most)
    return ranked.crossJoin(F.broadcast(both.agg(F.count("*").alias("total")))).drop("_place")
