"""Checks of stored tables against a contract: columns and types, nulls, enums, unique keys, references."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Column:
    """What a contract says of a column: its type (simple name, any if none), whether it may be null, is unique, has one of some labels, refers to a column (table, column)."""

    table: str
    name: str
    kind: str | None = None
    required: bool = False
    unique: bool = False
    labels: tuple[str, ...] = ()
    refers: tuple[str, str] | None = None


REPORT = "table_name string, column_name string, rule string, fine boolean, violations long, detail string"


def schema_rows(tables: dict[str, DataFrame], contract: list[Column]) -> list[tuple]:
    """A row for each column of the contract: whether it is there and of its type. From the tables' footers alone."""
    out = []
    for c in contract:
        kinds = dict(tables[c.table].dtypes) if c.table in tables else {}
        found = kinds.get(c.name)
        fine = found is not None and c.kind in (None, found)
        out.append((c.table, c.name, "present", fine, int(not fine), found or ("no table" if c.table not in tables else "no column")))
    return out


def row_checks(name: str, table: DataFrame, columns: list[Column]) -> DataFrame | None:
    """Nulls and values outside the labels of all columns of a table, in one pass; detail is the least label that is not in the contract."""
    wanted = [(c, rule) for c in columns for rule in (("required",) if c.required else ()) + (("labels",) if c.labels else ())]
    if not wanted:
        return None
    bad = {"required": lambda c: F.col(c.name).isNull(), "labels": lambda c: F.col(c.name).isNotNull() & ~F.col(c.name).cast("string").isin(*c.labels)}
    sums = [F.count_if(bad[rule](c)).alias(f"n{k}") for k, (c, rule) in enumerate(wanted)]
    others = [F.min(F.when(bad["labels"](c), F.col(c.name).cast("string"))) for c, rule in wanted if rule == "labels"]
    names = [k for k, (_, rule) in enumerate(wanted) if rule == "labels"]
    one = table.agg(*sums, *(o.alias(f"d{k}") for k, o in zip(names, others, strict=True)))
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(c.name).alias("column_name"), F.lit(rule).alias("rule"), (F.col(f"n{k}") == 0).alias("fine"), F.col(f"n{k}").alias("violations"), (F.col(f"d{k}") if rule == "labels" else F.lit(None).cast("string")).alias("detail")) for k, (c, rule) in enumerate(wanted)]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def key_checks(name: str, tables: dict[str, DataFrame], column: Column) -> list[DataFrame]:
    """Rows whose value is there more than once, and rows that refer to nothing; both by one count of the column's values."""
    values = tables[name].where(F.col(column.name).isNotNull()).groupBy(F.col(column.name).alias("_v")).agg(F.count("*").alias("_n"))
    out = []

    def row(rule: str, found: DataFrame, least: str) -> DataFrame:
        bad = found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"), F.expr(least).cast("string").alias("detail"))
        return bad.select(F.lit(name).alias("table_name"), F.lit(column.name).alias("column_name"), F.lit(rule).alias("rule"), (F.col("violations") == 0).alias("fine"), "violations", "detail")

    if column.unique:
        out.append(row("unique", values.where(F.col("_n") > 1), "min(_v)"))
    if column.refers:
        parent, key = column.refers
        known = tables[parent].select(F.col(key).alias("_v")).distinct()
        out.append(row("refers", values.join(known, "_v", "left_anti"), "min(_v)"))
    return out


def contract_report(spark: SparkSession, tables: dict[str, DataFrame], contract: list[Column]) -> DataFrame:
    """table_name, column_name, rule, fine, violations and detail (the found type, or the least offending value) of every rule of a contract, for the tables by name.

    Rules: present (with its type), required, labels, unique (all rows of a value that is there again), refers (rows without a
    parent; null refers to nothing). Columns that are missing have the first row alone.
    """
    schema = schema_rows(tables, contract)
    there = {(t, c) for t, c, _, _, _, found in schema if not found.startswith("no ")}
    known = [c for c in contract if (c.table, c.name) in there]
    parts = [spark.createDataFrame(schema, REPORT)]
    for name in dict.fromkeys(c.table for c in known):
        mine = [c for c in known if c.table == name]
        parts += [p for p in [row_checks(name, tables[name], mine)] if p is not None]
        for c in mine:
            if c.unique or c.refers and c.refers in {(t, k) for t in tables for k in tables[t].columns}:
                parts += key_checks(name, tables, c)
    return reduce(DataFrame.unionByName, parts).select([x.split()[0] for x in REPORT.split(", ")])


def label_sets(table: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and the labels it holds, in order; for columns of few values."""
    flat = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("label")) for c in columns))).alias("_x")).select("_x.*")
    return flat.where(F.col("label").isNotNull()).distinct().groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
