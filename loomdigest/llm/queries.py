"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, mixing, pieces, quality, simhash, token_file, topk, toxicity, licenses
from .common import remainder, table

END_ID = 1


def public(name: str) -> str:
    """A public tokenizer's file, in the folder that LOOMDIGEST_TOKENIZERS names or as the installed package has it."""
    folder = os.environ.get("LOOMDIGEST_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_pieces(model_file: str) -> list[str]:
    """The texts of a sentencepiece vocabulary's ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.fresh_path(spark)
    token_file.write(table(spark, sf_dir, "documents"), path, public("word_bpe_49k.json"), END_ID)
    return token_file.summary(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return _judged(toxicity.score(docs, net), 5, 0, 0.5)


def _judged(scored: DataFrame, modulus: int, left_out: int, threshold: float) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), modulus) == left_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return _judged(quality.score(docs, model), 4, 2, 0.7)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), width=4, radius=4)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, vocabulary_pieces(public("piece_bpe_32k.model")), remainder(F.col("doc_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_toxicity, op3_mixing, op4_top_k, op5_pieces, op6_quality, op8_simhash, op9_langid, op10_exact_dedup)}

SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_top_k": """
        WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES["op7_license_scan"] = op7_license_scan
SQL |= {"op7_license_scan": licenses.SQL, "op3_mixing": mixing.SQL}
