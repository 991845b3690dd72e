"""The queries of this subpackage, each over its whole table, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm.chat import preference_format, swapped_answers
from meshwright.llm.common import table
from meshwright.llm.exact_dedup import DigestIndex
from meshwright.llm.jaccard import jaccard_components
from meshwright.llm.mixing import mix_sources
from meshwright.llm.quality import fit_quality, score_quality
from meshwright.llm.sentencepiece_codec import piece_digests
from meshwright.llm.sharding import shard_by_bytes
from meshwright.llm.token_output import token_round_trip
from meshwright.llm.toxicity import fit_toxicity, score_toxicity
from meshwright.llm.topk import exact_top_k


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are one batch for a new index; the digest column is the index's own."""
    from pyspark.sql import functions as F

    index = DigestIndex.temporary(spark)
    decided = index.admit(table(spark, sf_dir, "documents"))
    index.drop()
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op6_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last answer."""
    made = preference_format(swapped_answers(table(spark, sf_dir, "conversations")))
    return made.drop("chosen", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, share=(90, 100))


def op10_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_quality": op3_quality,
    "op4_token_output": op4_token_output,
    "op5_topk": op5_topk,
    "op6_preference_chat": op6_preference_chat,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_kk_sharding": op10_kk_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[][] WHEN len(words) < 3 THEN [words]
                ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2])) END AS grams FROM w),
        e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT o.a, o.b FROM o JOIN s x ON x.doc_id = o.a JOIN s y ON y.doc_id = o.b
              WHERE 100 * o.both >= 90 * (len(x.grams) + len(y.grams) - o.both)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
        SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, m.component_id
        FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
    """,
}
