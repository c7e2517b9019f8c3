"""The pipeline, the queries' columns and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from caseweave.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bad = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(bad)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= before
        assert docs.where(F.col("doc_id") >= 10**6).count() == 0
    texts = docs.select("text").distinct().count()
    assert texts == docs.count() > 0.7 * before
    assert docs.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.col("n_chars") != F.length("text")).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    most = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2048


def test_stages_keep_columns_with_the_names_of_results(spark):
    names = ["score", "held_out", "lang_pred", "_text", "n_words", "n_removed", "kept_text", "kept_sha256", "_bucket", "_row", "_none", "_h1", "_h2", "_id", "node", "label", "item_id", "_w", "piece", "length"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in names}).withColumn("text_", F.col("text"))
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        for c in names:
            assert docs.where(F.col(c).isNull() | (F.col(c) != c)).count() == 0
    assert docs.count() > 100 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 100


def test_pipeline_takes_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


CONTRACT = {
    "op1_": "page_id:bigint url:string text:string n_chars:bigint",
    "op4_": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op5_": "page_id:bigint host:string path:string rule:string verdict:string",
    "op6_": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op7_": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op8_": "doc_id:bigint fingerprint:string component_id:bigint",
    "op9_": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op10_": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op11_": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op12_": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
    "op13_": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
}


@pytest.mark.parametrize("prefix", CONTRACT)
def test_queries_return_the_columns_asked_for(spark, prefix):
    (name,) = [n for n in __spark_entry__.queries() if n.startswith(prefix)]
    df = __spark_entry__.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for column in CONTRACT[prefix].split():
        field, kind = column.split(":")
        assert kinds[field] == kind
    table = "pages" if prefix in ("op1_", "op5_") else "documents"
    if prefix == "op12_":
        assert df.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    elif prefix == "op13_":
        assert df.count() == 16 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif prefix != "op6_":
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_workers_get_small_batches_and_give_memory_back(spark):
    """Long texts come in batches of bounded bytes, and what holds them is under malloc's thresholds."""

    def looked(batches):
        import os

        import pyarrow as pa

        sizes = [(batch.nbytes, batch.num_rows) for batch in batches]
        found = max(sizes)[0], sum(n for _, n in sizes), pa.default_memory_pool().backend_name, int(os.environ.get("MALLOC_MMAP_THRESHOLD_", 0)), int(os.environ.get("MALLOC_TRIM_THRESHOLD_", 0))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], names=["most", "rows", "pool", "mapped", "trimmed"])

    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    row = texts.mapInArrow(looked, "most long, rows long, pool string, mapped long, trimmed long").first()
    assert row["rows"] == 4000 and row["most"] <= 9 << 20
    assert row["pool"] == "system" and row["mapped"] == 4 << 20 and row["trimmed"] == 16 << 20
