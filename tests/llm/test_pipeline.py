import corpus_pipeline
from strataspark.llm import jaccard_join


def test_stages_on_a_small_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    assert jaccard_join.jaccard_classes(docs).where("n_links > 0").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_untrained_classifiers_keep_all(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(k, f"text {k}", "en", "a", 6) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, str(tmp_path)).count() == 5


def test_stages_on_odd_documents(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
