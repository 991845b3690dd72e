import corpus_pipeline


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, data).cache()
        assert sorted(rows.columns) == sorted(docs.columns), name
        if name != "mixing sources":
            assert 0.5 * before < rows.count() <= before
            before = rows.count()
    out = corpus_pipeline.STAGES[-1][1](spark, rows, data)
    assert out.count() == rows.count() and out.where("length(ids) <> 4 * n_tokens").count() == 0
