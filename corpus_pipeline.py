"""The corpus pipeline: toxic documents out, copies out, near copies out, sources mixed, texts to ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of `documents`. Between stages the rows are written as Parquet in the shared folder and read
again, so that a lost executor costs the running stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm.common import remove, scratch, table
from meshwright.llm.exact_dedup import DigestIndex, exact_dedup
from meshwright.llm.jaccard import near_distinct
from meshwright.llm.mixing import mixed
from meshwright.llm.queries import tokenizer_path
from meshwright.llm.sentencepiece_codec import piece_digests
from meshwright.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by models of the documents at hand."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    index = DigestIndex.temporary(spark)
    kept = exact_dedup(docs, index)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return near_distinct(docs, words=5, share=(80, 100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that the mix takes, with digests of them and of what they decode to."""
    return piece_digests(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixing),
    ("SentencePiece", pieces),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, used)
        used.append(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
