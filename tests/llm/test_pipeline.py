"""Each stage takes effect on what its predecessor kept."""

import corpus_pipeline
from riskloom.llm import decontam, minhash, suffix

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontamination":
            assert decontam.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == before and out.where("n_tokens != size(ids)").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
    assert suffix.repeated_spans(spark.read.parquet(f"{DATA}/documents.parquet").limit(0)).count() == 0


def test_columns_in_the_way_and_ids_of_two_texts(spark):
    """Columns named as what stages make for themselves do no harm; another text of the same id isn't dropped."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "1 AS y", "2 AS h", "3 AS kept", "4 AS n_bytes", "5 AS n_removed", "6 AS n_spans", "7 AS _spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, DATA).columns == docs.columns, name
    two = spark.createDataFrame([(5, "one two three four five six", "en", "s", 1), (5, "six five four three two one", "en", "s", 1)] * 2, docs.schema)
    assert corpus_pipeline.drop_near_duplicates(spark, two, DATA).count() == 2
