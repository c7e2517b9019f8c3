"""The sink of batches: sizes, failures, repeated attempts."""

import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from caseweave.plans import registry
from caseweave.sources.batches import BatchWriter, FolderStore, insert, inserted

KIND = "id long, text string, v array<float>, s struct<a:int>"


def test_rows_go_in_by_fifty_and_come_back(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(230, numPartitions=2).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("è\n\""), "id")).alias("text"), F.array(F.lit(0.1).cast("float"), F.col("id").cast("float")).alias("v"), F.struct(F.lit(1).alias("a")).alias("s"))
    insert(rows, path)
    sizes = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "store/rows").rglob("*.json"))
    assert sizes == [15, 15, 50, 50, 50, 50]
    got = inserted(spark, path, KIND)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    insert(rows.where("id < 3"), path, 2)
    assert inserted(spark, path, KIND).count() == 233


def test_a_failed_task_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    bad = spark.range(400, numPartitions=4).select(F.when(F.col("id") == 399, F.raise_error("task lost").cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="task lost"):
        insert(bad, path)
    assert inserted(spark, path, "id long").count() == 0
    insert(spark.range(5), path)
    time.sleep(1)  # tasks that were stopped may have gone on for a moment
    FolderStore(path).sweep()
    assert len(list((tmp_path / "store/rows").iterdir())) == 1
    assert inserted(spark, path, "id long").count() == 5


def test_a_task_that_is_run_again_gives_no_doubles(spark, tmp_path):
    """The attempt that the driver is told of counts, once, however often the commit is repeated."""
    path = str(tmp_path / "store")
    writer = BatchWriter(path, 50)
    part = [Row(id=k) for k in range(120)]
    writer.write(iter(part))  # lost after its inserts
    again = writer.write(iter(part))
    empty = writer.write(iter([]))
    writer.commit([again, empty, None])
    writer.commit([again, empty])
    writer.abort([again])  # too late to take anything back
    got = inserted(spark, path, "id long")
    assert sorted(r.id for r in got.collect()) == list(range(120)) and (again.rows, again.batches) == (120, 3)
    assert [json.loads(x)["attempt"] for x in next((tmp_path / "store/commits").iterdir()).read_text().splitlines()] == [again.attempt]


def test_stored_guidelines_equal_the_ingested(spark):
    sf = "/root/testdata/sf0.001"
    key = lambda r: (r.doc_id, r.chunk, r.content, r.tokens, tuple(r.embedding))
    assert sorted(map(key, registry.QUERIES["guideline_store"](spark, sf).collect())) == sorted(map(key, registry.QUERIES["guideline_ingest"](spark, sf).collect()))
