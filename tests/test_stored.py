"""Versions of stored tables: untouched files stay, readers of old versions go on, breaks leave the version before."""

import pytest
from pyspark.sql import functions as F

from caseweave.operators import contracts
from caseweave.sources.versions import Conflict, VersionedTable


def made(spark, tmp_path, n=200, buckets=8):
    table = VersionedTable(spark, str(tmp_path / "t"), "case_id", buckets)
    table.create(spark.range(n).select(F.col("id").alias("case_id"), F.concat(F.lit("r"), "id").alias("text"), F.lit(None).cast("int").alias("mark")))
    return table


def rows(df):
    return {r.case_id: (r.text, r.mark) for r in df.collect()}


def files(table, version):
    return {b: sorted(p.name for p in __import__("pathlib").Path(f).glob("*.parquet")) for b, f in table.listed(version).items()}


def test_only_touched_buckets_get_new_files(spark, tmp_path):
    table = made(spark, tmp_path)
    before, old = files(table, 0), table.read(0)
    new = spark.createDataFrame([(3, "new", 1), (1000, "added", 2)], "case_id long, text string, mark int")
    assert table.upsert(new, ["case_id"]) == 1
    after, touched = files(table, 1), set(table._touched(new))
    assert len(touched) <= 2 and {b for b in before if before[b] != after.get(b)} == touched
    assert rows(table.read())[3] == ("new", 1) and rows(table.read())[1000] == ("added", 2) and len(rows(table.read())) == 201
    assert rows(old) == rows(table.read(0)) == {k: (f"r{k}", None) for k in range(200)}
    part = table.read(keys=new)
    assert {3, 1000} <= set(rows(part)) and len(rows(part)) < 201


def test_patch_delete_and_empty_changes(spark, tmp_path):
    table = made(spark, tmp_path)
    table.patch(spark.createDataFrame([(1, None, 5), (2, "two", None), (999, "none", 1)], "case_id long, text string, mark int"), "case_id")
    found = rows(table.read())
    assert found[1] == ("r1", 5) and found[2] == ("two", None) and 999 not in found
    table.delete(spark.createDataFrame([(1,), (2,), (5000,)], "case_id long"), "case_id")
    assert set(rows(table.read())) == set(range(200)) - {1, 2}
    assert table.upsert(table.read().limit(0), ["case_id"]) == 2 and table.versions() == [0, 1, 2]
    with pytest.raises(ValueError):
        table.read(7)


def test_a_break_between_delete_and_write_leaves_old_rows(spark, tmp_path):
    """Re-processing replaces a case's rows as a whole: broken anywhere it leaves the old ones, run again it gives the new ones."""
    table = made(spark, tmp_path)
    cases = spark.createDataFrame([(7,), (8,)], "case_id long")
    new = spark.createDataFrame([(7, "a", 1), (7, "b", 1), (9, "not asked for", 1)], "case_id long, text string, mark int")
    broken = new.withColumn("mark", F.when(F.col("text") == "b", F.raise_error("executor lost").cast("int")).otherwise(F.col("mark")))
    with pytest.raises(Exception, match="executor lost"):
        table.replace(cases, broken)
    assert rows(table.read()) == {k: (f"r{k}", None) for k in range(200)} and table.versions() == [0]
    write, table._fs = table._fs, lambda path: (_ for _ in ()).throw(OSError("driver lost")) if "/versions/1" in path else VersionedTable._fs(table, path)
    with pytest.raises(OSError):
        table.replace(cases, new)
    table._fs = write
    assert rows(table.read()) == {k: (f"r{k}", None) for k in range(200)}
    assert table.replace(cases, new) == 1
    found = table.read().where("case_id IN (7, 8, 9)").collect()
    assert sorted((r.case_id, r.text) for r in found) == [(7, "a"), (7, "b"), (9, "r9")]


def test_two_writers_of_one_version(spark, tmp_path):
    table = made(spark, tmp_path)
    one = spark.createDataFrame([(1, "one", 1)], "case_id long, text string, mark int")

    def meanwhile(old):
        VersionedTable(spark, table.folder, "case_id", 8).upsert(one, ["case_id"])
        return old

    with pytest.raises(Conflict):
        table.change(one, meanwhile)
    assert rows(table.read())[1] == ("one", 1) and table.versions() == [0, 1]
    with pytest.raises(Conflict):
        table.create(one)


def test_forgotten_versions(spark, tmp_path):
    table = made(spark, tmp_path)
    for k in range(3):
        table.upsert(spark.createDataFrame([(k, f"v{k}", k)], "case_id long, text string, mark int"), ["case_id"])
    want = rows(table.read())
    table.forget(3)
    assert table.versions() == [3] and rows(table.read()) == want


def test_planted_violations_are_found(spark):
    a = spark.createDataFrame([(1, "x", "F"), (1, None, "Q"), (None, "y", None), (2, "z", "A")], "id long, name string, label string")
    b = spark.createDataFrame([(1,), (7,), (7,), (None,)], "a_id long")
    contract = [
        contracts.Column("a", "id", "bigint", required=True, unique=True), contracts.Column("a", "name", "int", required=True), contracts.Column("a", "label", "string", labels=("F", "O")),
        contracts.Column("a", "gone"), contracts.Column("b", "a_id", refers=("a", "id")), contracts.Column("c", "id"),
    ]
    got = {(r.table_name, r.column_name, r.rule): (r.fine, r.violations, r.detail) for r in contracts.contract_report(spark, {"a": a, "b": b}, contract).collect()}
    assert got == {
        ("a", "id", "present"): (True, 0, "bigint"), ("a", "name", "present"): (False, 1, "string"), ("a", "label", "present"): (True, 0, "string"), ("a", "gone", "present"): (False, 1, "no column"), ("b", "a_id", "present"): (True, 0, "bigint"), ("c", "id", "present"): (False, 1, "no table"),
        ("a", "id", "required"): (False, 1, None), ("a", "name", "required"): (False, 1, None), ("a", "label", "labels"): (False, 2, "A"), ("a", "id", "unique"): (False, 2, "1"), ("b", "a_id", "refers"): (False, 2, "7"),
    }
    assert contracts.contract_report(spark, {"a": a.limit(0)}, contract[:1]).where("NOT fine").count() == 0
