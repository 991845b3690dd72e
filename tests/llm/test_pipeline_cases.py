"""Each stage of the pipeline on nulls, empty and very long texts, repeated rows, an empty table and clashing columns."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _id string, _hash long, _label int, copies int"


def rows():
    text = " ".join(f"word{i}" for i in range(80))
    own = [(1, text), (2, text), (3, text + " more"), (None, text), (None, None), (5, None), (6, ""), (7, "  "), (7, "  "), (8, "x" * 300_000), (9, "long " * 100_000)]
    own += [(100 + i, f"quite another text number {i} with words of its own such as {i * 7} and {i * 13} here") for i in range(40)]
    return [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", 1, k, "x", k, k, k) for k, (i, t) in enumerate(own)]


def labelled(spark, tmp_path):
    labels = [(100 + i, 1, int(i % 2)) for i in range(40)] + [(None, 0, 0), (1, None, None), (100, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_odd_rows(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "-"))
        made.write.parquet(path)
        if name == "exact dedup":
            kept = spark.read.parquet(path)
            # of the four equal texts the least id stays; the blank ones are one group but for the null's own spaces
            assert kept.where("text like 'word0 word1 %' and text not like '%more'").count() == 1
        docs = spark.read.parquet(path)
    near = spark.read.parquet(str(tmp_path / "n-gram-Jaccard-join"))
    assert near.where("text like 'word0 word1 %'").count() == 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and out.where("n_tokens is null or ids_sha256 is null").count() == 0


def test_empty_table(spark, tmp_path):
    folder = labelled(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
